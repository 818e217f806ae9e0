"""Quality rules: repetition and symbol measures, and a hashed n-gram log-likelihood ratio.

Words and word pairs fall into `buckets` hash buckets. Two multinomials are counted over them: the raw one
over every document, with add-one smoothing, and the target one over trusted documents (labelled good and
not toxic), with the raw one as its prior, so that few trusted words cannot condemn what they lack. A document's score is the mean over its n-grams of log(target / raw), so it does
not depend on length; it is kept if the score reaches `threshold` and no base rule speaks against it.

The trusted set is a bounded sample of the labels (`trusted_limit` ids, by hash of the id); counts of
the corpus cover all documents. Only the bucket table, bounded by `buckets`, reaches the driver, and
only the sampled ids are broadcast. Scoring is part of the scan: one pass, no shuffle.

Nulls: a null text is empty, hence fails. Documents without n-grams score 0. Without trusted documents
both multinomials are equal and every score is 0; `weights=None` gives the base rules alone. Repeated rows count as often as they occur, null ids
are ordinary, an empty table gives an empty result. Other columns pass through `measured`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import WORD, id_and_text, spaced, words_of

BUCKETS = 1 << 14
#: Where the two labels separate: below it lie 9 of 10 labelled bad documents that the base rules pass, and next to
#: none of the good ones, also of those outside the trusted set.
THRESHOLD = -0.08
#: Weight, in n-grams, of the raw multinomial as the prior of the target one.
PRIOR = 100_000
TRUSTED_LIMIT = 20_000
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: The columns that `measured` adds, before it folds them into one.
_PARTS = "__quality_text __quality_words __quality_hashes __quality_keys".split()


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shifted(hashes: Column) -> Column:
    """The hashes from the second one on."""
    return F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most `limit` ids labelled good and not toxic, the same ones in every run."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ratio_weights(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    trusted_limit: int = TRUSTED_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[float]:
    """log(target / raw) of every bucket."""
    trusted = trusted_ids(labels, trusted_limit).withColumn("trusted", F.lit(1))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(trusted), "doc_id", "left")
    n = F.lit(buckets).cast("long")
    grams = (
        rows.select("trusted", _hashes(words_of(F.col("text"))).alias("h"))
        .select("trusted", F.inline(F.arrays_zip(F.col("h").alias("a"), _shifted(F.col("h")).alias("b"))).alias("a", "b"))
        .select("trusted", F.stack(F.lit(2), F.pmod("a", n), F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("a", "b"), n))).alias("bucket"))
        .where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    )
    raw, target = [1] * buckets, [0] * buckets
    for row in grams.collect():  # one row a bucket at most
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    every, trusted_grams = sum(raw), sum(target)
    return [math.log((t + PRIOR * r / every) / (trusted_grams + PRIOR) / (r / every)) for t, r in zip(target, raw)]


def _count_of(text: Column, characters: str) -> Column:
    """How often any of the characters occurs."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def _repeated_words(words: Column, keys: Column) -> Column:
    """Words inside windows that occur more than once in the text.

    Most texts have none: as many distinct window hashes as windows. Otherwise windows are sorted by
    hash, equal neighbours marked, and the union of the marked windows measured from their starts.
    """
    n = F.size(keys)
    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    starts = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates value once
    return F.when(n == F.size(F.array_distinct(keys)), F.lit(0).cast("long")).otherwise(
        once(pairs, lambda s: once(starts(s), covered))
    )


def measured(docs: DataFrame, weights: list[float] | None, threshold: float = THRESHOLD, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Add a struct of all measures, the score and the verdict to each row."""
    text, words, hashes, keys = (F.col(c) for c in _PARTS)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    n = F.size(words)
    h = hashes
    window = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
    starts = F.sequence(F.lit(0), n - WINDOW)
    staged = (
        docs.withColumn(_PARTS[0], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        .withColumn(_PARTS[1], words_of(text))
        .withColumn(_PARTS[2], _hashes(words))
        .withColumn(_PARTS[3], F.when(n >= WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>")))
    )
    if weights is None:
        score = F.lit(0.0)
    else:
        # one foldable literal; an array of single literals would take a call for each
        table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
        modulus = F.lit(len(weights)).cast("long")
        weight = lambda x: F.get(table, F.pmod(x, modulus).cast("int"))
        pair = lambda a, b: weight(a) + F.when(b.isNotNull(), weight(F.xxhash64(a, b))).otherwise(0.0)
        total = F.aggregate(F.zip_with(h, _shifted(h), pair), F.lit(0.0), lambda acc, x: acc + x)
        score = F.when(n > 0, total / F.greatest(2 * n - 1, F.lit(1))).otherwise(F.lit(0.0))
    values = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated_words(words, keys),
        "score": score,
    }
    # columns of their own, used more than once: the optimizer then computes each of them once
    named = {f"__quality_{k}": v for k, v in values.items()}
    out = staged.withColumns(named)
    v = {k: F.col(f"__quality_{k}") for k in values}
    failed = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > MAX_REPEATED_PERCENT * v["n_words"])
    return out.withColumn(
        out_col,
        F.struct(
            *(v[k].alias(k) for k in values if k != "score"),
            failed.alias("base_failed"),
            (~failed & (v["score"] >= threshold)).alias("kept"),
            v["score"].alias("score"),
        ),
    ).drop(*_PARTS, *named)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of measures for every row of docs."""
    weights = ratio_weights(docs, labels, id_col=id_col, text_col=text_col)
    rows = measured(id_and_text(docs, id_col, text_col), weights, threshold)
    return rows.select("doc_id", "quality.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    weights = ratio_weights(docs, labels, id_col=id_col, text_col=text_col)
    rows = measured(docs, weights, threshold, text_col, "__quality").withColumn("__quality_row", F.monotonically_increasing_id())
    # a filter does not sink below a row number: else it would repeat every measure underneath
    return rows.where(F.col("__quality")["kept"] & (F.col("__quality_row") >= 0)).drop("__quality", "__quality_row")
