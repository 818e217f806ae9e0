"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, over a whole corpus.

Two tokenizers cut the same bytes at different places. Places where both cut divide a text into groups,
and every token of one is linked with every token of the other in its group. An id pair's count is the
number of documents that hold it linked; a link is best if its pair has the highest count of its first id.

How. Documents are taken in chunks of bounded bytes. In a chunk, everything is an Arrow array: list
flattening with parent indices, cumulative sums of token lengths within each list, a hash join on the
ends, grouped counts. Each chunk sends its distinct id pairs, each once with the number of its documents;
Spark sums them, and only the sums of its own pairs return to a chunk. So what is shuffled grows with the
distinct pairs of chunks, never with links, and no group of any id is ever gathered.

Nulls: a null or empty text has no tokens, nor has one whose tokens of either side, put together, differ
from its bytes; such rows hold zeros and empty groups. Ids may be null or repeat: each row is a document of its own.
Other columns are not read. An empty table gives an empty one. A text is never split over chunks; one
longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm import pieces as P
from pricetide.llm.common import id_and_text
from pricetide.session import cut_lineage

#: Bytes of text in a chunk: larger ones send fewer pairs, smaller ones need less memory.
CHUNK_BYTES = 4 << 20
#: Pieces whose ids a worker remembers from chunk to chunk.
REMEMBERED = 800_000

_SPACE = "▁".encode()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others in order for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


#: Bytes of pieces that go through a tokenizer in a row.
_ROW = 1 << 12


class _Side:
    """A tokenizer: ids of many pieces, and the bytes of each id."""

    def __init__(self, encode, token_bytes: list[bytes]) -> None:
        self.encode = encode
        self.bytes = pa.array(token_bytes, pa.binary())
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.size = len(token_bytes)

    def ids(self, pieces: pa.Array) -> P.Made:
        """Ids of all pieces, and how many each has. Spaced words go in a row and are told apart by their ends; others go one by one."""
        rows = P.joinable(pieces) & ~np.asarray(pc.match_substring(pieces, _SPACE))
        places = np.flatnonzero(rows)
        offsets, data = P.buffers(pc.take(pieces, pa.array(places)))
        parts, alone, at = [], [np.flatnonzero(~rows)], 0
        while at < len(places):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _ROW, "right")) - 1)
            text = data[offsets[at] : offsets[stop]].tobytes().decode()
            ids = np.array(self.encode([text])[0], np.int32)
            ends = np.cumsum(self.lengths[ids])
            last = np.searchsorted(ends, offsets[at + 1 : stop + 1] - offsets[at])
            if len(ends) and ends[-1] == offsets[stop] - offsets[at] and (ends[last] == offsets[at + 1 : stop + 1] - offsets[at]).all():
                parts.append((places[at:stop], np.diff(last, prepend=-1), ids))
            else:  # a token reaches over an end, or its bytes are not the text's
                alone.append(places[at:stop])
            at = stop
        alone = np.concatenate(alone)
        texts = pc.take(pieces, pa.array(alone)).cast(pa.string()).to_pylist()
        for at in range(0, len(texts), 4096):
            found = self.encode(texts[at : at + 4096])
            own = np.fromiter(map(len, found), np.int64, len(found))
            parts.append((alone[at : at + 4096], own, np.concatenate([np.array(ids, np.int32) for ids in found])))
        return P.in_order(parts, len(pieces))


def byte_level(file: bytes) -> _Side:
    """A byte-level BPE of the tokenizers library; special tokens in a text are plain text."""
    tokenizer = Tokenizer.from_buffer(file)
    tokenizer.encode_special_tokens = True
    letters = _byte_letters()
    size = tokenizer.get_vocab_size()
    tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
    plain = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
    return _Side(lambda some: [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)], plain)


def byte_fallback(file: bytes) -> _Side:
    """A sentencepiece BPE with byte fallback, which itself adds the space that each piece begins with.

    Pieces may be encoded alone since no token has its space sign after another letter.
    """
    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    size = model.get_piece_size()
    tokens = [model.id_to_piece(i) for i in range(size)]
    if any("▁" in t.lstrip("▁") for t in tokens):
        raise ValueError("tokens of this model reach over a space; its pieces can't be encoded alone")
    plain = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.encode().replace(_SPACE, b" ") for i, t in enumerate(tokens)]
    return _Side(lambda some: model.encode([s[1:] for s in some], num_threads=1), plain)


class _Pair:
    """Both tokenizers, with the ids of pieces that were met lately."""

    def __init__(self, a: _Side, b: _Side) -> None:
        self.a, self.b = a, b
        self.memory = P.Memory(REMEMBERED)

    def _made(self, pieces: pa.Array) -> P.Made:
        """Per piece the number of its first ids, those, and its second ids."""
        (a, ca), (b, cb) = self.a.ids(pieces), self.b.ids(pieces)
        own = 1 + ca + cb
        starts = np.cumsum(own) - own
        out = np.zeros(int(own.sum()), np.int32)
        out[starts] = ca
        out[P.ragged(starts + 1, ca)] = a
        out[P.ragged(starts + 1 + ca, cb)] = b
        return out, own

    def lists(self, pieces: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        numbers, starts, counts = self.memory.values(pieces, self._made)
        ca = numbers[starts].astype(np.int64)
        cb = counts - 1 - ca

        def lists(starts: np.ndarray, own: np.ndarray) -> pa.ListArray:
            offsets = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[P.ragged(starts, own)]))

        return lists(starts + 1, ca), lists(starts + 1 + ca, cb)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists, and the list each belongs to."""
    return np.asarray(pc.list_flatten(lists)), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)


def _lossless(distinct: pa.Array, side: _Side, ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which pieces the bytes of their tokens give again."""
    offsets, data = P.buffers(distinct)
    ends = np.searchsorted(parent, np.arange(len(distinct) + 1))
    same = P.run_sums(side.lengths[ids], ends) == np.diff(offsets)
    _, joined = P.buffers(pc.take(side.bytes, pa.array(ids[same[parent]])))
    mask = np.repeat(same, np.diff(offsets))
    wrong = np.flatnonzero(joined != data[mask])
    same[np.repeat(np.arange(len(distinct)), np.diff(offsets))[mask][wrong]] = False
    return same


def _ends(side: _Side, ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """List and byte offset where each token ends, as one key: a cumulative sum that starts anew in each list."""
    total = np.asarray(pc.cumulative_sum(pa.array(side.lengths[ids]))) if len(ids) else np.zeros(0, np.int64)
    first = np.searchsorted(parent, parent)  # of each token's list
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    return parent << 32 | (total - before)


def _counted(columns: dict[str, np.ndarray], add: str | None = None) -> pa.Table:
    """Rows grouped by all columns, counted, or with the sum of one of them."""
    keys = [c for c in columns if c != add]
    table = pa.table({c: pa.array(v) for c, v in columns.items()}).group_by(keys, use_threads=False)
    return table.aggregate([(add, "sum")] if add else [([], "count_all")])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Pieces:
    """Distinct pieces of a chunk, aligned: their token, group and link counts, id pairs and group texts."""

    def __init__(self, distinct: pa.Array, pair: _Pair) -> None:
        n, a, b = len(distinct), pair.a, pair.b
        (ia, pa_), (ib, pb) = map(_flat, pair.lists(distinct))
        self.ok = _lossless(distinct, a, ia, pa_) & _lossless(distinct, b, ib, pb)
        ka, kb = self.ok[pa_], self.ok[pb]
        ia, pa_, ib, pb = ia[ka], pa_[ka], ib[kb], pb[kb]
        left = pa.table({"key": _ends(a, ia, pa_), "a": np.arange(len(ia))})
        right = pa.table({"key": _ends(b, ib, pb), "b": np.arange(len(ib))})
        both = left.join(right, "key", join_type="inner", use_threads=False)
        last_a, last_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        last_a[_column(both, "a")] = 1
        last_b[_column(both, "b")] = 1
        ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        piece_of = pa_[last_a == 1]
        # each side's ids of a group are counted before they meet, so repeats never pair up
        ca, cb = _counted({"g": ga, "a": ia}), _counted({"g": gb, "b": ib})
        met = ca.rename_columns(["g", "a", "m"]).join(
            cb.rename_columns(["g", "b", "k"]), "g", join_type="inner", use_threads=False
        )
        key = _column(met, "a").astype(np.int64) << 32 | _column(met, "b")
        times = _column(met, "m") * _column(met, "k")
        self.pairs = _counted({"piece": piece_of[_column(met, "g")], "key": key, "m": times}, "m")
        self.n_a, self.n_b = np.bincount(pa_, minlength=n), np.bincount(pb, minlength=n)
        self.n_groups = np.bincount(piece_of, minlength=n)
        order = np.argsort(_column(self.pairs, "piece"), kind="stable")
        at = np.searchsorted(_column(self.pairs, "piece")[order], np.arange(n + 1))
        self.n_links = P.run_sums(_column(self.pairs, "m_sum")[order], at)
        self.texts = self._group_texts(a, b, (ia, ga, last_a), (ib, gb, last_b))

    def _group_texts(self, a: _Side, b: _Side, ours, theirs) -> pa.Array:
        """`a1,a2|b1;` for each group of a piece, groups one after another."""
        (ia, ga, la), (ib, gb, lb) = ours, theirs
        names = P.loaded(f"names {a.size} {b.size}", b"", lambda _: _signs(a.size, b.size))
        codes = np.concatenate([ia + a.size * la, 2 * a.size + ib + b.size * lb])
        order = np.argsort(np.concatenate([ga, gb]), kind="stable")
        offsets, data = P.buffers(pc.take(names, pa.array(codes[order])))
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return P.binary_array(offsets[tokens], data)


def _signs(a: int, b: int) -> pa.Array:
    """Ids as text with what may follow them: more of the group, the other side, the next group."""
    return pa.array([f"{i}{end}".encode() for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)], pa.binary())


def _chunk(texts: pa.Array, tokenizers: _Pair) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns of a chunk's documents, and its distinct pairs with the number of documents that hold each."""
    blank = np.asarray(pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0))
    given = pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar(""))
    distinct, places, offsets = P.spaced(given)
    aligned = _Pieces(distinct, tokenizers)
    n = len(texts)
    good = ~blank & (P.run_sums(~aligned.ok[places], offsets) == 0)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = good[doc]
    places, doc = places[keep].astype(np.int64), doc[keep]
    offsets = np.searchsorted(doc, np.arange(n + 1))
    held = _counted({"doc": doc, "piece": places}).rename_columns(["doc", "piece", "k"])
    met = held.join(aligned.pairs, "piece", join_type="inner", use_threads=False)
    links = _counted({"doc": _column(met, "doc"), "key": _column(met, "key"), "m": _column(met, "k") * _column(met, "m_sum")}, "m")
    in_doc = _counted({"key": _column(links, "key")})
    order = np.argsort(_column(in_doc, "key"))
    keys, docs = _column(in_doc, "key")[order], _column(in_doc, "count_all")[order]
    order = np.argsort(_column(links, "doc"), kind="stable")
    at = np.searchsorted(_column(links, "doc")[order], np.arange(n + 1))
    pair = np.searchsorted(keys, _column(links, "key")[order]).astype("<i4")
    times = _column(links, "m_sum")[order].astype("<i8")
    texts_at, data = P.buffers(pc.take(aligned.texts, pa.array(places)))
    columns = {name: pa.array(P.run_sums(getattr(aligned, name)[places], offsets)) for name in ("n_a", "n_b", "n_groups", "n_links")}
    groups = pc.utf8_rtrim(P.binary_array(texts_at[offsets], data, pa.string()), ";")
    columns |= {"groups": groups, "pair": P.binary_array(at * 4, pair.view(np.uint8)), "times": P.binary_array(at * 8, times.view(np.uint8))}
    return columns, keys, docs


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Per document its counts and groups, and per chunk (`row` -1) its id pairs.

    `groups` reads `a1,a2|b1;a3|b2,b3`: ids of the first side, a bar, ids of the second. `pair` and
    `times` are packed: places in the chunk's pairs (32 bits) and links of each (64 bits). In a chunk's
    row, `keys` are its pairs in order (first id times 2**32 plus second) and `held` its documents of each.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    a_file, b_file = (context.broadcast(open(path, "rb").read()) for path in (a_path, b_path))
    counts = ", ".join(f"{n} long" for n in _COUNTS)
    schema = f"chunk long, row int, doc_id {id_type}, {counts}, groups string, pair binary, times binary, keys array<long>, held array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda _: _Pair(byte_level(a_file.value), byte_fallback(b_file.value))
        tokenizers = P.loaded("pair", a_file.value + b_file.value, load)
        chunk = TaskContext.get().partitionId() << 32
        for table in P.sized(batches, "text", chunk_bytes):
            n = table.num_rows
            columns, keys, docs = _chunk(P.whole(table.column("text"), pa.string()), tokenizers)
            ids = table.column("doc_id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            none = lambda k: pa.nulls(k, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk] * n, pa.int64()), "row": pa.array(range(n), pa.int32()), "doc_id": ids, **columns}
                | {"keys": none(n), "held": none(n)}
            )
            own = {c: pa.nulls(1, v.type) for c, v in columns.items()}
            packed = {c: pa.ListArray.from_arrays([0, len(v)], pa.array(v, pa.int64())) for c, v in (("keys", keys), ("held", docs))}
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk]), "row": pa.array([-1], pa.int32()), "doc_id": pa.nulls(1, ids.type), **own, **packed}
            )
            chunk += 1
            del columns, own
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def _asked(rows: DataFrame) -> DataFrame:
    """The pairs of each chunk: chunk, key, documents of the chunk that hold it."""
    return rows.where("row = -1").select("chunk", F.inline(F.arrays_zip("keys", "held"))).withColumnRenamed("keys", "key")


def _rated(asked: DataFrame) -> DataFrame:
    """Corpus-wide count of each pair, and whether it is the highest of its first id."""
    counts = asked.groupBy("key").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("key", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """Id pairs of the corpus: a_id, b_id, documents that hold them linked, and whether none of a_id is in more."""
    rated = _rated(_asked(aligned(docs, a_path, b_path, **options)))
    return rated.select(
        F.shiftright("key", 32).cast("int").alias("a_id"),
        F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"),
        F.col("n").alias("documents"),
        "best",
    )


def alignments(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True, **options) -> DataFrame:
    """Per document: doc_id, its counts, groups (and their digest), best links and the sum of all links' counts.

    Chunks are written once; their documents meet the counts of their own pairs in one group per chunk,
    which is bounded by `chunk_bytes`.
    """
    rows = aligned(docs, a_path, b_path, **options)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    dropped = () if keep_groups else ("groups",)
    rows = cut_lineage(rows.select("*", digest).drop(*dropped))
    asked = _asked(rows)
    answers = asked.join(_rated(asked), "key").select(F.col("chunk").alias("asker"), "key", "n", "best")
    told = [c for c in rows.columns if c in ("doc_id", *_COUNTS, "groups", "groups_sha256")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in told) + ", n_best long, count_sum long"

    def join(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("key")
        n, best = _column(theirs, "n"), theirs.column("best").to_numpy()
        at, pair = P.buffers(P.whole(mine.column("pair"), pa.binary()))
        _, times = P.buffers(P.whole(mine.column("times"), pa.binary()))
        pair, times = np.frombuffer(pair.tobytes(), "<i4"), np.frombuffer(times.tobytes(), "<i8")
        out = mine.select(told)
        out = out.append_column("n_best", pa.array(P.run_sums(times * best[pair], at // 4)))
        return out.append_column("count_sum", pa.array(P.run_sums(times * n[pair], at // 4)))

    documents = rows.where("row >= 0").drop("keys", "held", "row")
    return documents.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(join, schema)
