"""Spelling variant grouping: words one edit apart, found through Bloom-guided neighbourhoods.

Each word of the vocabulary generates its edits as 64-bit hashes: every deletion of one letter, and every
replacement of a letter by a later one of the vocabulary's letters (the other direction is found from the
other word). The hashes are probed against blocked Bloom filters of all words, one for each length. Only
hits become strings and are shuffled to an exact join with the vocabulary, which removes false ones.

The filters are broadcast. Their size is bounded by `filter_bytes` whatever the vocabulary: beyond
it they have fewer bits a word and let more false hits through to the join; results stay the same.

Nulls: a null text has no words. Null document ids count as an empty one where ids matter. Repeated rows
count each. Other columns are not read. An empty table gives an empty one; with a single word,
nothing is near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import LOWER, UPPER, id_and_text, mixed
from pricetide.session import cut_lineage, discard

#: Letters of a word: runs of these.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Bits of the filters for a word, and bytes of all filters at most.
BITS_A_WORD, FILTER_BYTES = 20, 32 << 20
#: 64-bit blocks in a segment of a filter, and words probed at once.
_SEGMENT, _STEP = 1 << 13, 2048
_WORDS_A_TASK = 50_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: Column, word: Column) -> Column:
    """The word, without one letter where a checksum of document and word is divisible by 31."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word)
    h = F.crc32(key.cast("binary"))
    gone = (h % F.length(word)).cast("int")
    short = F.concat(F.substring(word, F.lit(1), gone), F.substring(word, gone + 2, F.length(word)))
    return F.when(h % 31 == 0, short).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of whole texts, A-Z in lower case, counted over all documents.

    Runs that are too short already can't give a word; the count combines before its shuffle.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{min_letters},}})"), F.lit(1))
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL").select("doc_id", F.explode(runs).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = rows.withColumn("run", lower).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.full(length, _PRIME, np.uint64))


def _letter(code: np.ndarray) -> np.ndarray:
    """A letter's value in a word's hash; the hash is a sum, so an edit changes it by a difference."""
    return mixed(code + np.uint64(0x51ED27))


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (_letter(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the four bits it has there."""
    h = mixed(hashes)
    block = (h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    one, bits = np.uint64(1), np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= one << (h >> np.uint64(6 * k) & np.uint64(63))
    return block.astype(np.int64), bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each length, a few thousand at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        for at in range(0, len(places), _STEP):
            yield length, places[at : at + _STEP]


def filters(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> dict[int, np.ndarray]:
    """A blocked Bloom filter for each word length.

    Words are dealt by segments of the filters, each of which one task builds whole; what reaches the
    driver is the filters themselves, at most `filter_bytes` and a segment for each length.
    """
    sizes = dict(words.groupBy(F.length("word")).count().collect())
    total = sum(sizes.values())
    bits = min(BITS_A_WORD, 8 * filter_bytes / max(total, 1))
    blocks = {length: max(1, int(n * bits) // 64) for length, n in sizes.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, places in _by_length(words):
                block, bits = _bits(_hashes(_codes([words[p] for p in places.tolist()], length)), blocks[length])
                columns = [np.full(len(block), length, np.int32), (block // _SEGMENT).astype(np.int32), (block % _SEGMENT).astype(np.int32), bits.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "segment", "block", "bits"])

    def built(table: pa.Table) -> pa.Table:
        part = np.zeros(_SEGMENT, np.int64)
        np.bitwise_or.at(part, table.column("block").to_numpy(), table.column("bits").to_numpy())
        length, segment = table.column("length")[0].as_py(), table.column("segment")[0].as_py()
        return pa.table({"length": pa.array([length], pa.int32()), "segment": pa.array([segment], pa.int32()), "part": pa.array([part.tobytes()])})

    out = {length: np.zeros(-(-n // _SEGMENT) * _SEGMENT, np.uint64) for length, n in blocks.items()}
    set_bits = words.select("word").mapInArrow(placed, "length int, segment int, block int, bits long")
    merged = set_bits.groupBy("length", "segment", "block").agg(F.bit_or("bits").alias("bits"))
    parts = merged.groupBy("length", "segment").applyInArrow(built, "length int, segment int, part binary")
    for length, segment, part in parts.toLocalIterator():
        out[length][segment * _SEGMENT : (segment + 1) * _SEGMENT] = np.frombuffer(part, np.uint64)
    return {length: out[length][: blocks[length]].copy() for length in blocks}


def _edits(codes: np.ndarray, letters: np.ndarray, shards: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, int | None]]:
    """Words (by place) whose edit hits the filter of its length: which position, and the letter put there (None: deleted)."""
    n, length = codes.shape
    powers, values = _powers(length + 1), _letter(codes)
    own = values * powers[:length]
    total = own.sum(axis=1, dtype=np.uint64)

    def hit(hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        block, bits = _bits(hashes, len(shard))
        return shard[block] & bits == bits

    if length in shards:
        marks = _letter(letters)[:, None] * powers  # of each letter at each position
        for at in range(length):
            rest = total - own[:, at]
            for letter, changed in zip(letters.tolist(), marks):
                later = np.flatnonzero(codes[:, at] < letter)
                if len(later):
                    yield later[hit(rest[later] + changed[at], shards[length])], at, letter
    if length - 1 in shards:
        before = np.zeros(n, np.uint64)
        after = (values[:, 1:] * powers[: length - 1]).sum(axis=1, dtype=np.uint64)
        for at in range(length):
            # of a run of equal letters only the first one: the others give the same word
            new = np.flatnonzero(codes[:, at] != codes[:, at - 1]) if at else np.arange(n)
            yield new[hit(before[new] + after[new], shards[length - 1])], at, None
            before = before + own[:, at]
            if at + 1 < length:
                after = after - values[:, at + 1] * powers[at]


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Pairs of words one edit apart, each in both directions: word, n, near, near_n. `words` should be a written table."""
    spark = words.sparkSession
    shards = spark.sparkContext.broadcast(filters(words, filter_bytes))
    # no more than the pattern's 90 letters, whatever the input
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()
    letters = spark.sparkContext.broadcast(np.array(sorted(ord(r.letter) for r in used if r.letter), np.uint64))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for length, places in _by_length(words):
                some = [words[p] for p in places.tolist()]
                rows = []
                for hits, at, letter in _edits(_codes(some, length), letters.value, shards.value):
                    put = "" if letter is None else chr(letter)
                    rows += [(some[k], counts[places[k]], some[k][:at] + put + some[k][at + 1 :]) for k in hits.tolist()]
                word, n, near = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    # a word makes hundreds of probes: a few thousand words are a task, however small their table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words.count() // _WORDS_A_TASK)
    guessed = words.repartition(tasks).mapInArrow(probed, "word string, n long, near string")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = guessed.join(known, "near").select("word", "n", "near", "near_n")
    both = F.array(*(F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(x).alias("near"), F.col(m).alias("near_n"))
                     for w, n, x, m in (("word", "n", "near", "near_n"), ("near", "near_n", "word", "n"))))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form, by doubling: each round follows twice as many steps.

    A form's count is `RATIO` times its word's at least, so chains are short and never return.
    """
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        discard(roots)
        if longer.where("_moved").limit(1).count() == 0:
            return longer.drop("_moved")
        roots = longer.drop("_moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word: form (its most frequent near word, if `ratio` times as frequent), root, n, n_near, form_n."""
    words = cut_lineage(vocabulary(docs, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    rated = cut_lineage(
        words.join(near, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    discard(words)
    roots = _roots(rated.where("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
