"""Line dedup by winnowing over line hashes.

Only lines with a word take part; they are compared without outer blanks. The window at a line is the
shortest run of lines from there with at least `min_words` words, or `max_lines` lines if that comes
first. A window's fingerprint is its smallest line hash, so two equal runs that hold a whole window
share a fingerprint at the same place: none is missed. Fingerprints met more than once are joined back
to their windows. A window is repeated if an equal one begins earlier (smaller id, or same document,
earlier line); the lines of repeated windows are deleted.

Matches extend to both ends of a repeated run. At its start there is nothing to add: the window there
lies in the run, if any does. The lines after its last window fill no window of their own, so a window
also carries its tail, the lines up to where the window of the next line ends. A window with so many
lines of its tail is a run like any other, repeated if an equal one begins earlier, wherever that is.
Together these are the later copies of each maximal run that holds a window. `extend=False` stops at windows.

Work per line is constant and no pair of documents is ever listed: a window is held against the first
of its kind alone, found by an aggregate that combines before its shuffle, and joined back on a key
that Spark can split.

Nulls: a null text has no lines and stays null. Null ids come last in the order. Rows that agree in id
and text count as one document and are treated alike. Empty lines stay. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import WORD, id_and_text
from pricetide.session import cut_lineage

MIN_WORDS, MAX_LINES = 25, 8


def windows(docs: DataFrame, min_words: int, max_lines: int, id_col: str, text_col: str, extend: bool = True) -> DataFrame:
    """doc_id, text_key, start and fingerprint of every window, and its runs: content hash and lines (their indices).

    The first run is the window; each further one adds a line of the tail and names only that.
    """
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(F.trim(x)).alias("h")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    many = F.size("lines")

    def length(p):
        """Lines of the window at p, or null where the text ends before."""
        words, out = F.lit(0), F.when(F.lit(False), F.lit(0))
        for k in range(1, max_lines + 1):
            words = words + F.get(F.col("lines"), p + k - 1)["n"]
            enough = (words >= min_words) if k < max_lines else words.isNotNull()
            out = out.when(enough, F.lit(k))
        return out

    spans = F.transform(F.sequence(F.lit(0), many - 1), lambda p: F.struct(p.alias("p"), length(p).alias("k")))
    # the tail ends before the last line of the next window, or with the text
    after = lambda s: F.transform(s, lambda x, j: F.struct(x["p"].alias("p"), x["k"].alias("k"), F.coalesce(F.get(s, j + 1)["k"], many - x["p"]).alias("next")))
    tail = F.slice("lines", F.col("p") + F.col("k") + 1, F.greatest(F.col("next") - F.col("k"), F.lit(0))) if extend else None
    found = (
        rows.where(many > 0)
        .select("doc_id", "text_key", "lines", spans.alias("spans"))
        .select("doc_id", "text_key", "lines", F.inline(after(F.col("spans"))))
        .where("k IS NOT NULL")
        .withColumn("part", F.slice("lines", F.col("p") + 1, F.col("k")))
    )
    hashes = lambda part: F.transform(part, lambda x: x["h"])
    run = lambda content, lines: F.struct(content.alias("content"), lines.alias("lines"))
    runs = F.array(run(F.xxhash64(hashes("part")), F.transform("part", lambda x: x["i"])))
    if extend:
        found = found.withColumn("tail", tail)
        longer = F.transform("tail", lambda x, j: run(F.xxhash64(hashes("part"), hashes(F.slice("tail", 1, j + 1))), F.array(x["i"])))
        runs = F.concat(runs, longer)
    return found.select(
        "doc_id",
        "text_key",
        F.element_at("part", 1)["i"].alias("start"),
        F.array_min(hashes("part")).alias("fingerprint"),
        runs.alias("runs"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text", extend: bool = True) -> DataFrame:
    """doc_id, text_key and the sorted indices of the lines to delete, for documents that have any."""
    all_windows = cut_lineage(windows(docs, min_words, max_lines, id_col, text_col, extend))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "start")
    shared = all_windows.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("fingerprint")
    met = all_windows.join(shared, "fingerprint", "left_semi").select("doc_id", "text_key", "start", "fingerprint", F.inline("runs"))
    first = met.groupBy("fingerprint", "content").agg(F.min(place).alias("first"))
    later = met.join(first, ["fingerprint", "content"]).where(place > F.col("first"))
    return (
        later.select("doc_id", "text_key", F.explode("lines").alias("line"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("line")).alias("removed"))
    )


def marked(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text", extend: bool = True) -> DataFrame:
    """docs with `__removed`, the indices of the lines to delete (null: none)."""
    gone = repeated_lines(docs, min_words, max_lines, id_col, text_col, extend).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("removed").alias("__removed")
    )
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key"))
    return docs.join(gone, on, "left").drop("__id", "__key")


def kept_text(text, removed):
    """The text without the lines at the given indices."""
    lines = F.split(text, "\n")
    index = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(index, lambda i: F.get(lines, i)), "\n"))


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text", extend: bool = True) -> DataFrame:
    """docs without later copies of runs of lines; documents that lose all their words go."""
    out = marked(docs, min_words, max_lines, id_col, text_col, extend)
    out = out.withColumn(text_col, kept_text(F.col(text_col).cast("string"), F.col("__removed")))
    return out.where(F.col("__removed").isNull() | F.col(text_col).rlike(WORD)).drop("__removed")
