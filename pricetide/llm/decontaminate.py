"""Benchmark decontamination by spaced seeds.

A seed hashes the words that a fixed mask selects from a stretch of words, so a replaced word spoils only
the seeds whose mask looks at it. Seeds of all benchmark items are joined with seeds of all documents;
a hit fixes how document and item lie against each other, and both are compared word by word around it,
without gaps: the stretch with the best score (1 a match, `MISMATCH` a substitution) must have
`MIN_MATCHED` equal words, or 0.8 of a shorter item. Words are compared with A-Z lowered.

Document seeds are first held against a bitmap of the benchmark's seeds. Its size is fixed
(2 ** BITMAP bits, at most 2 ** (BITMAP - 6) words reach the driver), so it may be sent to every task; it
only saves work, as what passes is joined exactly, by a shuffle. Documents with hits go on as word
hashes, the others are read once and dropped. A passage met in a third of all documents gives a row a
document and seed, never pairs of documents.

Nulls: null texts and items are empty and match nothing; a null id is an ordinary one. Items shorter than
the masks are found by the short mask, items of fewer than four words not at all. Rows with equal id and
text count once. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import id_and_text, mixed, utf8, word_hashes
from pricetide.session import cut_lineage

#: Masks for items of at least their length, and the one for shorter items. For every distance of 3 to 9
#: some mask ignores two words that far apart, so even words replaced at regular distances leave hits.
MASKS = ("110110110110", "111011101110", "111101111011", "101101110101")
SHORT_MASK = "1111"
MIN_MATCHED, MISMATCH = 13, -2
BITMAP = 24
_FACTOR = np.random.default_rng(6).integers(0, 2**63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """Of each mask, the seeds at all places where it fits: a sum of the words it selects, each times the
    odd factor of its place, which all masks share."""
    span = len(masks[0])
    many = max(0, len(words) - span + 1)
    terms = [words[k : k + many] * _FACTOR[k] for k in range(span)]
    return [mixed(sum((t for t, wanted in zip(terms, mask) if wanted == "1"), np.full(many, _FACTOR[-1 - i]))) for i, mask in enumerate(masks)]


def _item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = seeds(words, MASKS if len(words) >= len(MASKS[0]) else (SHORT_MASK,))
    return np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])


def _places(seed: Column | str) -> Column:
    """The two bits of a seed in the bitmap."""
    size = F.lit(1 << BITMAP).cast("long")
    return F.array(F.pmod(seed, size), F.pmod(F.shiftrightunsigned(seed, 32), size))


def _bitmap(bench: DataFrame) -> np.ndarray:
    bit = bench.select(F.explode(_places("seed")).alias("bit"))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    rows = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(value).alias("bits")).collect()
    out = np.zeros(1 << BITMAP - 6, np.int64)
    for row in rows:
        out[row["at"]] = row["bits"]
    return out.view(np.uint64)


def _in_bitmap(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    last, held = np.uint64((1 << BITMAP) - 1), np.ones(len(found), bool)
    for bit in (found & last, found >> np.uint64(32) & last):
        held &= (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held


def _benchmark(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Item words, and item seeds with their places."""
    rows = id_and_text(items, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(text) for text in utf8(batch.column("text"))]
            cut = [_item_seeds(w) for w in words]
            columns = [
                pa.array([w.tobytes() for w in words], pa.binary()),
                pa.array([s.astype(np.int64) for s, _ in cut], pa.list_(pa.int64())),
                pa.array([p for _, p in cut], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *columns], ["item_id", "item_words", "seeds", "places"])

    schema = f"item_id {kind}, item_words binary, seeds array<long>, places array<long>"
    found = cut_lineage(rows.mapInArrow(run, schema).distinct())
    zipped = F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("place")))
    key = F.xxhash64("item_id", "item_words").alias("item_key")
    return found.select(key, "item_id", "item_words"), found.select(key, zipped).distinct()


def _hits(docs: DataFrame, bitmap: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Documents with at least one seed in the bitmap: their words, and these seeds with their places."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_key", "doc_id", "doc_words", "seeds", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, size = [], [], 0
            for row, text in enumerate(utf8(batch.column("text"))):
                rows.append(row)
                words.append(word_hashes(text))
                size += len(words[-1])
                if size > 1 << 16:
                    yield found(batch, rows, words)
                    rows, words, size = [], [], 0
            if rows:
                yield found(batch, rows, words)

    def found(batch: pa.RecordBatch, rows: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
        """Hits in some documents at a time; seeds that span two of them do not count."""
        together = np.concatenate(words)
        ends = np.cumsum([len(w) for w in words])
        hits = []
        for masks in (MASKS, (SHORT_MASK,)):
            for own in seeds(together, masks):
                at = np.flatnonzero(_in_bitmap(sent.value, own))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + len(masks[0]) <= ends[doc]
                hits.append((doc[inside], at[inside], own[at[inside]]))
        doc, at, seed = (np.concatenate(c) for c in zip(*hits))
        order = np.argsort(doc, kind="stable")
        doc, at, seed = doc[order], at[order], seed[order].view(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else [0]
        picked = [int(doc[a]) for a in edges[:-1]]
        cuts = list(zip(edges, edges[1:]))
        kept = [batch.column(n).take(pa.array([rows[d] for d in picked], pa.int64())) for n in ("doc_key", "doc_id")]
        columns = [
            pa.array([words[d].tobytes() for d in picked], pa.binary()),
            pa.array([seed[a:b] for a, b in cuts], pa.list_(pa.int64())),
            pa.array([at[a:b] - (ends[d] - len(words[d])) for d, (a, b) in zip(picked, cuts)], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([*kept, *columns], names)

    schema = f"doc_key long, doc_id {kind}, doc_words binary, seeds array<long>, places array<long>"
    return rows.mapInArrow(run, schema)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Start in the document, length and equal words of the best stretch when item word 0 lies at `shift`."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    if low >= high:
        return low, 0, 0
    same = doc[low:high] == item[low - shift : high - shift]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    begin = int(np.flatnonzero(score[: end + 1] == score[end] - gain[end])[-1])
    return low + begin, end - begin, int(same[begin:end].sum())


def _verified(candidates: DataFrame, doc_kind: str, item_kind: str) -> DataFrame:
    names = ["doc_key", "doc_id", "item_id", "start", "n_span", "n_matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, out = [], ([], [], [])
            columns = (batch.column(n).to_pylist() for n in ("doc_words", "item_words", "shifts"))
            for row, (doc, item, shifts) in enumerate(zip(*columns)):
                doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
                best = max((overlap(doc, item, s) for s in sorted(shifts)), key=lambda b: (b[2], -b[0]))
                if best[2] >= min(MIN_MATCHED, -(-8 * len(item) // 10)):
                    picked.append(row)
                    for column, value in zip(out, best):
                        column.append(value)
            kept = [batch.column(n).take(pa.array(picked, pa.int64())) for n in names[:3]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in out)], names)

    return candidates.mapInArrow(
        run, f"doc_key long, doc_id {doc_kind}, item_id {item_kind}, start long, n_span long, n_matched long"
    )


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_key, doc_id, item_id, start, n_span, n_matched of every document and item that overlap."""
    words, bench = _benchmark(items, item_id_col, item_text_col)
    hits = cut_lineage(_hits(docs, _bitmap(bench), id_col, text_col))
    each = hits.select("doc_key", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("at")))).distinct()
    shifts = (
        each.join(bench, "seed")
        .groupBy("doc_key", "item_key")
        .agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    )
    rows = hits.select("doc_key", "doc_id", "doc_words").dropDuplicates(["doc_key"])
    candidates = shifts.join(words, "item_key").join(rows, "doc_key")
    return _verified(candidates, rows.schema["doc_id"].dataType.simpleString(), words.schema["item_id"].dataType.simpleString())


def contaminated(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The best overlap of every document id and item id that overlap."""
    best = F.max(F.struct("n_matched", F.negative("start").alias("back"), "n_span")).alias("b")
    found = overlaps(docs, items, **columns).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", F.negative("b.back").alias("start"), "b.n_span", "b.n_matched")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns."""
    bad = overlaps(docs, items, id_col, text_col).select(F.col("doc_key").alias("__key")).distinct()
    on = F.xxhash64(F.col(id_col), F.col(text_col).cast("string")) == F.col("__key")
    return docs.join(bad, on, "left_anti")
