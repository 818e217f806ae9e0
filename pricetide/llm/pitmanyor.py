"""Language-model scoring with a hierarchical Pitman-Yor model.

Two levels of restaurants over a uniform base. A token sits in the restaurant of its context, the class of
the word before it (words hash into `CONTEXTS` classes; common words have one nearly to themselves); the
tables of all context restaurants are the customers of the one parent they share. In a Gibbs sweep the
customers of each dish leave their restaurant and are seated again one after another, given the tables of
all others as the sweep before left them; predictive probabilities are averaged over the sweeps after
`BURN`. Seating draws how many customers go by until the next new table (a Beta draw, then a geometric
one), so a pair that occurs a billion times costs as much as it has tables.

Layout: documents are dealt into chunks of about `CHUNK_BYTES`. A chunk sends its distinct (word, context)
pairs with their training counts to buckets of words, where each word's counts meet; a bucket holds whole
words, so the parent's seating is local to it, and only the table counts of the `CONTEXTS` restaurants and
four totals pass through the driver between sweeps. Buckets answer each chunk in the order in which it
asked, and the chunk scores its documents. A pair goes out once a chunk however often it occurs, chunks
and buckets grow in number with the corpus, and every count covers all training documents.

Nulls: a null text is empty and has the end token alone. A null id belongs to training. Repeated rows count
as often as they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import id_and_text, mixed, word_hashes
from pricetide.session import cut_lineage

CONTEXTS = 4096
SWEEPS, BURN = 3, 1
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
STRENGTH = 1.0
BASE_COUNT = 0.1
_START, _END = np.uint64(0x5AFE57A27), np.uint64(0x5AFEE2D)


class Pairs:
    """The distinct (word, context) pairs of some tokens, by bucket, word and context."""

    def __init__(self, texts: list[bytes], train: np.ndarray, buckets: int) -> None:
        found = [word_hashes(text) for text in texts]
        self.sizes = np.array([len(h) + 1 for h in found], np.int64)
        word = np.concatenate([x for h in found for x in (h, [_END])]).astype(np.uint64)
        before = np.concatenate([x for h in found for x in ([_START], h)]).astype(np.uint64)
        context = (mixed(before) % np.uint64(CONTEXTS)).astype(np.uint16)
        bucket = (word % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((context, word, bucket))
        w, r = word[order], context[order]
        new_word = np.concatenate([[True], w[1:] != w[:-1]])
        new_pair = new_word | np.concatenate([[True], r[1:] != r[:-1]])
        first = np.flatnonzero(new_pair)
        self.pair = np.empty(len(order), np.int64)  # of each token
        self.pair[order] = np.cumsum(new_pair) - 1
        self.word_of = np.cumsum(new_word)[first] - 1
        self.words = w[new_word]
        self.contexts = r[first]
        counted = np.repeat(train, self.sizes).astype(np.int64)
        self.counts = np.add.reduceat(counted[order], first)
        self.word_bucket = bucket[order][new_word]

    def by_bucket(self) -> Iterator[tuple[int, slice, slice]]:
        """Buckets with the slices of their words and pairs."""
        edges = np.flatnonzero(np.concatenate([[True], self.word_bucket[1:] != self.word_bucket[:-1], [True]]))
        pairs = np.searchsorted(self.word_of, edges)
        for a, b, c, d in zip(edges, edges[1:], pairs, pairs[1:]):
            yield int(self.word_bucket[a]), slice(a, b), slice(c, d)


class Bucket:
    """Whole words with the training counts of their pairs, merged over chunks, and their seating."""

    def __init__(self, number: int, row: dict) -> None:
        self.number = number
        self.chunks = row["chunks"]
        self.asked_words = [np.frombuffer(b, np.uint64) for b in row["words"]]
        many = [np.frombuffer(b, np.uint16) for b in row["many"]]
        self.asked = [len(np.frombuffer(b, np.uint16)) for b in row["contexts"]]
        word = np.concatenate([np.repeat(w, m) for w, m in zip(self.asked_words, many)])
        context = np.concatenate([np.frombuffer(b, np.uint16) for b in row["contexts"]])
        count = np.concatenate([np.frombuffer(b, np.uint32) for b in row["counts"]]).astype(np.int64)
        order = np.lexsort((context, word))
        w, r = word[order], context[order]
        new_word = np.concatenate([[True], w[1:] != w[:-1]])
        new_pair = new_word | np.concatenate([[True], r[1:] != r[:-1]])
        first = np.flatnonzero(new_pair)
        self.place = np.empty(len(order), np.int64)  # of each asked pair
        self.place[order] = np.cumsum(new_pair) - 1
        self.word_of = np.cumsum(new_word)[first] - 1
        self.words, self.context = w[new_word], r[first].astype(np.int64)
        self.count = np.add.reduceat(count[order], first)
        self.total = np.bincount(self.word_of, self.count, len(self.words)).astype(np.int64)
        self.tables = (self.count > 0).astype(np.int64)
        self.parents = (self.total > 0).astype(np.int64)

    def served(self) -> np.ndarray:
        return np.bincount(self.word_of, self.tables, len(self.words))

    def parent(self, model: dict) -> np.ndarray:
        """Probability of each word in the parent restaurant."""
        base = (STRENGTH + model["d0"] * model["S"]) / (model["V"] + 1)
        return (self.served() - model["d0"] * self.parents + base) / (STRENGTH + model["M"])

    def sweep(self, model: dict, number: int) -> None:
        rng = np.random.default_rng([self.number, number])
        open_pair = (STRENGTH + model["d1"] * model["T"][self.context]) * self.parent(model)[self.word_of]
        self.tables = seated(self.count, open_pair, model["d1"], rng)
        open_word = np.full(len(self.words), (STRENGTH + model["d0"] * model["S"]) / (model["V"] + 1))
        self.parents = seated(self.served().astype(np.int64), open_word, model["d0"], rng)

    def predictive(self, model: dict) -> np.ndarray:
        held, context = self.count - model["d1"] * self.tables, self.context
        back = (STRENGTH + model["d1"] * model["T"][context]) * self.parent(model)[self.word_of]
        return (held + back) / (STRENGTH + model["C"][context])


def seated(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating so many customers one after another, where a new table weighs `opening`."""
    tables = (customers > 0).astype(np.int64)
    left = np.flatnonzero(customers > 1)
    sat = np.ones(len(left), np.int64)
    while len(left):
        share = rng.beta(opening[left], sat - discount * tables[left])
        share = np.clip(share, 1e-300, 1 - 1e-16)
        wait = np.floor(np.log(rng.random(len(left))) / np.log1p(-share))
        at = sat + np.minimum(wait, customers[left]).astype(np.int64)
        on = at < customers[left]
        left, sat = left[on], at[on] + 1
        tables[left] += 1
        more = sat < customers[left]
        left, sat = left[more], sat[more]
    return tables


_ASK = "bucket long, chunk long, words binary, many binary, contexts binary, counts binary"
_HELD = "bucket long, chunks array<long>, words array<binary>, many array<binary>, contexts array<binary>, counts array<binary>"
_ANSWER = "chunk long, bucket long, known binary, chance binary"


def _frame(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    arrow = {
        "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()),
    }
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), arrow[k]) for c, k in zip(columns, kinds)], list(names))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key; they come sorted by it. A chunk or bucket of bounded size is held at a time."""
    now, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # few rows as Python objects at a time
            for row in batch.slice(at, 64).to_pylist():
                if rows and row[key] != now:
                    yield now, rows
                    rows = []
                now = row[key]
                rows.append(row)
    if rows:
        yield now, rows


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time; each holds a whole bucket."""
    for at in range(batch.num_rows):
        yield from batch.slice(at, 1).to_pylist()


def _ask(docs: DataFrame, chunks: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            pairs = Pairs([(r["text"] or "").encode() for r in rows], np.array([not r["held_out"] for r in rows]), buckets)
            many = np.bincount(pairs.word_of, minlength=len(pairs.words)).astype(np.uint16)
            out = []
            for bucket, words, own in pairs.by_bucket():
                parts = pairs.words[words], many[words], pairs.contexts[own], pairs.counts[own].astype(np.uint32)
                out.append((bucket, chunk, *(p.tobytes() for p in parts)))
            yield _frame(_ASK, out)

    # as many tasks as chunks, so that a task sorts and sends about one
    dealt = docs.repartition(chunks, "chunk").sortWithinPartitions("chunk", "doc_id", "text")
    return dealt.select("chunk", "held_out", "text").mapInArrow(run, _ASK)


def _gather(asked: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            yield _frame(_HELD, [(bucket, *([r[n] for r in rows] for n in ("chunk", "words", "many", "contexts", "counts")))])

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _HELD)


def _state(row: dict, models: list[dict]) -> Bucket:
    """A bucket after as many sweeps as there are models, each seated given the model before it."""
    bucket = Bucket(row["bucket"], row)
    for number, model in enumerate(models):
        bucket.sweep(model, number)
    return bucket


def _totals(held: DataFrame, models: list[dict]) -> dict[int, int]:
    """Sums over all buckets: tables of each context, and under negative keys what concerns all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                b = _state(row, models)
                out = {-1: b.parents.sum(), -2: b.total.sum(), -3: (b.total > 0).sum()}
                out |= {-4: (b.count == 1).sum(), -5: (b.count == 2).sum(), -6: (b.total == 1).sum(), -7: (b.total == 2).sum()}
                tables = np.bincount(b.context, b.tables, CONTEXTS).astype(np.int64)
                out |= {int(r): tables[r] for r in np.flatnonzero(tables)}
                if not models:
                    customers = np.bincount(b.context, b.count, CONTEXTS).astype(np.int64)
                    out |= {int(r) + CONTEXTS: customers[r] for r in np.flatnonzero(customers)}
                yield _frame("key long, value long", [(k, int(v)) for k, v in out.items()])

    sums = held.mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))
    return {row["key"]: row["value"] for row in sums.collect()}  # 2 * CONTEXTS + 7 rows at most


def _model(found: dict[int, int], first: dict | None) -> dict:
    tables = np.array([found.get(r, 0) for r in range(CONTEXTS)], np.float64)
    if first:
        return first | {"T": tables, "S": found.get(-1, 0), "M": float(tables.sum())}
    discount = lambda ones, twos: min(max(ones / max(1, ones + 2 * twos), 0.05), 0.95)
    return {
        "T": tables, "S": found.get(-1, 0), "M": float(tables.sum()), "N": found.get(-2, 0), "V": found.get(-3, 0),
        "C": np.array([found.get(r + CONTEXTS, 0) for r in range(CONTEXTS)], np.float64),
        "d1": discount(found.get(-4, 0), found.get(-5, 0)), "d0": discount(found.get(-6, 0), found.get(-7, 0)),
    }


def _answers(held: DataFrame, models: list[dict], burn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                bucket = Bucket(row["bucket"], row)
                chance, taken = np.zeros(len(bucket.count)), 0
                for number, model in enumerate(models[:-1]):
                    bucket.sweep(model, number)
                    if number >= burn:
                        chance, taken = chance + bucket.predictive(models[number + 1]), taken + 1
                value = (chance / taken)[bucket.place].astype(np.float32)
                ends = np.cumsum(bucket.asked)
                out = []
                for chunk, words, n, end in zip(bucket.chunks, bucket.asked_words, bucket.asked, ends):
                    known = bucket.total[np.searchsorted(bucket.words, words)]
                    out.append((chunk, bucket.number, known.astype(np.int64).tobytes(), value[end - n : end].tobytes()))
                yield _frame(_ANSWER, out)

    return held.mapInArrow(run, _ANSWER)


def _scored(docs: DataFrame, answers: DataFrame, model: dict, chunks: int, buckets: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scale = model["N"] + BASE_COUNT * (model["V"] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "chunk"):
            sent = {r["bucket"]: r for r in rows if r["bucket"] is not None}
            texts = [r for r in rows if r["bucket"] is None]
            pairs = Pairs([(r["text"] or "").encode() for r in texts], np.ones(len(texts), bool), buckets)
            known, chance = np.zeros(len(pairs.words), np.int64), np.zeros(len(pairs.contexts))
            for bucket, words, own in pairs.by_bucket():
                known[words] = np.frombuffer(sent[bucket]["known"], np.int64)
                chance[own] = np.frombuffer(sent[bucket]["chance"], np.float32)
            count = known[pairs.word_of][pairs.pair]
            begin = np.cumsum(pairs.sizes) - pairs.sizes
            base = np.add.reduceat(np.log10((count + BASE_COUNT) / scale), begin)
            score = np.add.reduceat(np.log10(chance)[pairs.pair], begin)
            seen = np.add.reduceat((count > 0).astype(np.int64), begin)
            yield _frame(schema, [
                (r["doc_id"], r["held_out"], int(n), int(k), float(b), float(s))
                for r, n, k, b, s in zip(texts, pairs.sizes, seen, base, score)
            ])

    none = lambda kind: F.lit(None).cast(kind)
    texts = docs.select("chunk", none("long").alias("bucket"), "doc_id", "held_out", "text", none("binary").alias("known"), none("binary").alias("chance"))
    replies = answers.select("chunk", "bucket", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"), "known", "chance")
    dealt = texts.unionByName(replies).repartition(chunks, "chunk").sortWithinPartitions("chunk", "bucket", "doc_id", "text")
    return dealt.mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """Per document: tokens, known tokens, the unigram base score and the model's log10 probability."""
    rows = id_and_text(docs, id_col, text_col)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = 1 + size // CHUNK_BYTES, 1 + size // BUCKET_BYTES
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long"))
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), chunk.alias("chunk"))
    held = cut_lineage(_gather(_ask(dealt, chunks, buckets), buckets))
    models = [_model(_totals(held, []), None)]
    for _ in range(sweeps):
        models.append(_model(_totals(held, models), models[0]))
    out = _scored(dealt, _answers(held, models, burn), models[0], chunks, buckets)
    per_token = F.when(F.col("n_tokens") > 0, F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(models[0]["N"]).cast("long").alias("train_tokens"), "base_score", "score",
        per_token.alias("perplexity"),
    )
