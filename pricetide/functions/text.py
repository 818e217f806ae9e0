"""Text folding, keyword flags and captured values."""

from __future__ import annotations

from itertools import chain
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from pricetide import config as C

# fixed values: accented letters and signs with their plain forms, one for one
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ²³¹ªº"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyaaaaaaeeeeiiiiooooouuuuncy231ao"


def fold(text: Column) -> Column:
    """Lower-case, accent-free ASCII with single spaces; NULL becomes ''."""
    plain = F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _PLAIN)
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


@F.pandas_udf(StringType())
def fold_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full compatibility decomposition for letters outside the Latin table."""
    for texts in batches:
        decomposed = texts.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
        yield decomposed.str.lower().str.split().str.join(" ")


def matches(text: Column, pattern: str) -> Column:
    """1 when the pattern occurs in the text, else 0."""
    return F.coalesce(F.regexp_like(text, F.lit(pattern)).cast("int"), F.lit(0))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A captured group, NULL when nothing matched."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def keyword_flags(folded: Column, patterns: dict[str, str], prefix: str = "kw_") -> dict[str, Column]:
    return {prefix + name: matches(folded, pattern) for name, pattern in patterns.items()}


def orientation(folded: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain(*C.ORIENTATION_NAMES.items())])
    return F.try_element_at(names, F.lower(capture(folded, C.ORIENTATION_PATTERN)))


def title_type(folded_title: Column) -> Column:
    """The kind of dwelling a title declares; the first listed kind wins."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(C.TITLE_TYPES.items()):
        found = F.when(folded_title.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def street_tokens(folded_title: Column) -> Column:
    """Sorted distinct words naming the street, empty when the title names none."""
    tail = F.regexp_extract(folded_title, rf"\b(?:{C.STREET_WORDS})\b\s+(.+?)(?:,|$)", 1)
    words = F.transform(F.split(tail, r"[^a-z0-9']+"), lambda w: F.regexp_replace(w, r"^'+|'+$", ""))
    kept = F.filter(
        words,
        lambda w: (F.length(w) > 1) & ~w.isin(*C.STREET_STOP_WORDS) & ~w.rlike(r"^[0-9]+$"),
    )
    return F.array_sort(F.array_distinct(kept))


def other_type(type_a: Column, type_b: Column) -> Column:
    """Two titles that declare different kinds of dwelling."""
    compatible = ((type_a == "piso") & type_b.isin(*C.PISO_ALIASES)) | (
        (type_b == "piso") & type_a.isin(*C.PISO_ALIASES)
    )
    return F.coalesce((type_a != type_b) & ~compatible, F.lit(False))


def contradict(type_a: Column, streets_a: Column, type_b: Column, streets_b: Column) -> Column:
    """Two titles that cannot name the same unit: other type or other street."""
    other_street = (F.size(streets_a) > 0) & (F.size(streets_b) > 0) & ~F.arrays_overlap(streets_a, streets_b)
    return other_type(type_a, type_b) | other_street


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either text is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


#: From this length on the measure leaves out very common letters of the second text; such texts go one by one.
_PLAIN_LENGTH = 200
_SIDE_BY_SIDE = 4096  # pairs compared at once


def _codes(texts: list[str], blank: int) -> np.ndarray:
    """Code points of texts, a row each, filled up with a value that equals nothing."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), blank, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<i4")
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def matched_letters(left: list[str], right: list[str]) -> np.ndarray:
    """Letters of both texts' matching blocks: the longest common block (first in the left text, then in the
    right one), then the same left and right of it.

    All pairs advance together: a round finds the longest block of every open stretch of every pair by one
    sweep over the left texts' letters.
    """
    a, b = _codes(left, -1), _codes(right, -2)
    total = np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    low_a, high_a = np.zeros(len(left), np.int64), np.fromiter(map(len, left), np.int64, len(left))
    low_b, high_b = np.zeros(len(left), np.int64), np.fromiter(map(len, right), np.int64, len(right))
    columns = np.arange(b.shape[1])[None, :]
    while len(pair):
        inside = (columns >= low_b[:, None]) & (columns < high_b[:, None])
        letters = np.where(inside, b[pair], -2)
        run = np.zeros((len(pair), b.shape[1] + 1), np.int32)  # common letters up to here, of the row before
        best, end_a, end_b = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        for i in range(int(low_a.min()), int(high_a.max())):
            here = (low_a <= i) & (i < high_a)
            same = (letters == a[pair, i][:, None]) & here[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            longest = run.max(axis=1)
            better = np.flatnonzero(longest > best)
            best[better] = longest[better]
            end_a[better] = i + 1
            end_b[better] = run[better].argmax(axis=1)
        some = best > 0
        np.add.at(total, pair[some], best[some])
        before = np.flatnonzero(some & (end_a - best > low_a) & (end_b - best > low_b))
        after = np.flatnonzero(some & (end_a < high_a) & (end_b < high_b))
        pair, low_a, high_a, low_b, high_b = (
            np.concatenate([pair[before], pair[after]]),
            np.concatenate([low_a[before], end_a[after]]),
            np.concatenate([(end_a - best)[before], high_a[after]]),
            np.concatenate([low_b[before], end_b[after]]),
            np.concatenate([(end_b - best)[before], high_b[after]]),
        )
    return total


@F.pandas_udf(DoubleType())
def matching_blocks_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two folded texts, 0 where one is blank; run only on blocked pairs."""
    from difflib import SequenceMatcher

    pairs = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    place, distinct = pd.factorize(pd.MultiIndex.from_frame(pairs))
    left, right = map(list, zip(*distinct)) if len(distinct) else ([], [])
    lengths = np.array([[len(x), len(y)] for x, y in zip(left, right)], np.int64).reshape(-1, 2)
    scores = np.zeros(len(left))
    plain = np.flatnonzero((lengths[:, 0] > 0) & (lengths[:, 1] > 0) & (lengths[:, 1] < _PLAIN_LENGTH))
    # of like lengths, so that little is filled up
    plain = plain[np.argsort(lengths[plain].sum(axis=1), kind="stable")]
    for at in range(0, len(plain), _SIDE_BY_SIDE):
        some = plain[at : at + _SIDE_BY_SIDE]
        matched = matched_letters([left[k] for k in some], [right[k] for k in some])
        scores[some] = 2.0 * matched / lengths[some].sum(axis=1)
    for k in np.flatnonzero((lengths[:, 0] > 0) & (lengths[:, 1] >= _PLAIN_LENGTH)):
        scores[k] = SequenceMatcher(None, left[k], right[k]).ratio()
    return pd.Series(scores[place], dtype="float64")


TITLE_SIMILARITY = {"edit": edit_similarity, "blocks": matching_blocks_similarity}


def grouped_thousands(value: Column) -> Column:
    """Number as text with comma thousands, at most two decimals, no trailing zeros."""
    whole = F.format_number(value, 0)
    exact = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), r"0+$", ""), r"\.$", "")
    return F.when(value.isNull(), F.lit("?")).when(value == F.floor(value), whole).otherwise(exact)


def euros(value: Column) -> Column:
    """Whole euros with dots between thousands."""
    return F.concat(F.translate(F.format_number(F.rint(value), 0), ",", "."), F.lit(" €"))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([_*`\[])", r"\\$1")
