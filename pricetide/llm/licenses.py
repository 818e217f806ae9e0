"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a run of up to `RUN_LINES` lines that together hold no more than twice the words
of the longest template, as a notice broken over lines does. It matches a template if it holds at least `PERCENT` of
the template's distinct words. Words are put in one global order, rarest in the corpus first. Of a template of n words
that must share t, only the first n - t + 1 can be the first common word (prefix filter), likewise of the
block's words; a block of fewer than t template words cannot match (length filter); and the places of the
first common word in both bound what can still follow (positional filter). What is left is verified on
whole sets. Words that occur in no template can never be shared, so they take no part in the order.

The texts are passed over once: what that leaves is written, with those texts that hold enough words of a template
at all. The templates are a fixed table in this module, so the index of their prefixes may be broadcast whatever
the corpus; the driver gets one count for each word of the templates. Phrases of the base rule are
looked for by place, in the texts that hold all their words.

Nulls: a null text is empty. Null ids and repeated rows are ordinary. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import LOWER, UPPER, id_and_text
from pricetide.session import cut_lineage

PERCENT = 80
#: Lines of a run: at half of the usual 80 columns the longest template takes five.
RUN_LINES = 6
# fixed values: phrases of the base rule
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# fixed values: opening sentences of public licenses and usual notices
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
_SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_WORD = f"[^{_SEPARATORS}]+"
#: The same class by what it holds, commonest first, in Java's notation: Spark tests a letter several times faster than by all it is not.
_IN_WORD = r"[a-z0-9\x80-\x{10FFFF}]+"


def _template_words(text: str) -> list[str]:
    return sorted(set(re.findall(_WORD, text.translate(str.maketrans(UPPER, LOWER)))))


def needed(size: int, percent: int = PERCENT) -> int:
    """How many of a template's words a block must hold."""
    return -(-percent * size // 100)


def run_words(templates=TEMPLATES) -> int:
    """Words that a run of several lines may hold."""
    return 2 * max((len(re.findall(_WORD, text.translate(str.maketrans(UPPER, LOWER)))) for _, text in templates), default=0)


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _read_once(docs: DataFrame, templates, percent: int, id_col: str, text_col: str) -> DataFrame:
    """What one pass over the texts leaves, written: words, places of phrases, own words of templates, and the texts that can match.

    A text whose words, all lines together, fall short of every template has no block that matches one, so only the others are kept.
    """
    parts = [_template_words(text) for _, text in templates]
    known = sorted({w for words in parts for w in words} | {w for phrase, _ in PHRASES for w in phrase.split()})
    holds = lambda words, n: F.size(F.array_intersect("own", _strings(words))) >= n
    near, may = F.lit(False), F.lit(False)
    for words in filter(None, parts):
        near = near | holds(words, needed(len(words), percent))
    for phrase, _ in PHRASES:
        may = may | holds(sorted(set(phrase.split())), len(set(phrase.split())))
    # lowering beyond A-Z can only add candidates, and no word; the words of what is left are taken exactly
    rough = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_IN_WORD), F.lit(0))
    exact = F.regexp_extract_all(_lowered(F.col("text")), F.lit(_IN_WORD), F.lit(0))
    return cut_lineage(
        id_and_text(docs, id_col, text_col)
        .withColumn("rough", rough)
        .select("doc_id", "text", F.size("rough").cast("long").alias("n_words"), F.array_intersect("rough", _strings(known)).alias("own"))
        .withColumn("words", F.when(may, exact))
        .select(
            "doc_id",
            F.xxhash64("text").alias("text_key"),
            "n_words",
            F.when(F.col("words").isNotNull(), _phrase_places(F.col("words"))).alias("places"),
            "own",
            F.when(near, F.col("text")).alias("text"),
        )
    )


def vocabulary(read: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of the templates, those of the fewest texts first."""
    words = sorted({w for _, text in templates for w in _template_words(text)})
    counts = read.select(F.explode("own").alias("word")).groupBy("word").count()
    found = {row["word"]: row["count"] for row in counts.collect()}  # one row a word of templates or phrases at most
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def matches(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, first line and lines of the block, label, template (its place in the table) and containment of every match."""
    return _matches(_read_once(docs, templates, percent, id_col, text_col), templates, percent)


def _matches(read: DataFrame, templates, percent: int) -> DataFrame:
    order = vocabulary(read, templates)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for template, (label, text) in enumerate(templates):
        words = sorted(_template_words(text), key=rank.__getitem__)
        need = needed(len(words), percent)
        index += [(w, i, template, label, words, need) for i, w in enumerate(words[: len(words) - need + 1])]
    prefix = sorted({row[0] for row in index})
    schema = "word string, i int, template int, label string, words array<string>, need int"
    table = F.broadcast(read.sparkSession.createDataFrame(index, schema))  # fixed by `templates`, some hundred rows

    near = read.where(F.col("text").isNotNull() & F.arrays_overlap("own", _strings(prefix)))
    exact = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(_lowered(line), F.lit(_IN_WORD), F.lit(0)))
    kept = lambda words, i: F.struct(
        i.alias("i"), F.size(words).alias("n"), F.array_intersect(_strings(order), words).alias("own"), F.arrays_overlap(words, _strings(prefix)).alias("rare")
    )
    lines = near.select("doc_id", "text_key", F.transform(exact, kept).alias("lines"))
    # runs begin and end with a template word, since without that line they hold the same words, and hold one that can be the first common one
    at = lambda first, k: F.slice("lines", first + 1, k)
    ends = lambda run: (F.size(F.element_at(run, 1)["own"]) > 0) & (F.size(F.element_at(run, -1)["own"]) > 0)
    words_in = lambda run: F.aggregate(run, F.lit(0), lambda total, line: total + line["n"])
    good = lambda run: ends(run) & F.exists(run, lambda line: line["rare"]) & ((F.size(run) == 1) | (words_in(run) <= run_words(templates)))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("lines") - 1),
            lambda first: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN_LINES), F.size("lines") - first)), lambda k: F.struct(first.alias("line"), k.alias("n_lines"))),
        )
    )
    blocks = (
        lines.select("doc_id", "text_key", "lines", F.inline(F.filter(spans, lambda s: good(at(s["line"], s["n_lines"])))))
        .withColumn("own", F.flatten(F.transform(at(F.col("line"), F.col("n_lines")), lambda line: line["own"])))
        .select("doc_id", "text_key", "line", "n_lines", F.array_intersect(_strings(order), "own").alias("own"))
    )
    each = blocks.select("doc_id", "text_key", "line", "n_lines", "own", F.posexplode("own").alias("j", "word"))
    size, own, n = F.size("words"), F.size("own"), F.col("need")
    candidates = (
        each.where(F.col("word").isin(prefix))
        .join(table, "word")
        .where(own >= n)  # length
        .where(F.col("j") <= own - n)  # prefix of the block
        .where(1 + F.least(size - F.col("i") - 1, own - F.col("j") - 1) >= n)  # position
    )
    common = F.size(F.array_intersect("own", "words"))
    return (
        candidates.where(common >= n)
        .select("doc_id", "text_key", "line", "n_lines", "label", "template", (common / size).alias("containment"))
        .distinct()
    )


def _places_of(words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split()

    def here(i):
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return test

    starts = F.filter(F.sequence(F.lit(0), F.size(words)), here)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _phrase_places(words: Column) -> Column:
    """(start, label) of every place of a phrase, by start."""
    return F.sort_array(F.concat(*(_places_of(words, *pair) for pair in PHRASES)))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of the base phrases, labels and the best containment."""
    read = _read_once(docs, templates, percent, id_col, text_col)
    found = (
        _matches(read, templates, percent)
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    )
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("places", lambda p: p["label"]), none)
    start = lambda at: F.try_element_at("places", F.lit(at))["start"].cast("long")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return read.select("doc_id", "text_key", "n_words", "places").join(found, on, "left").select(
        "doc_id",
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        start(1).alias("first_word"),
        start(-1).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("found", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
