"""What several operators of this subpackage share: names, word rules, word hashes, tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what lies between these seven characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own: others can't clash or be read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def spaced(text: Column) -> Column:
    """The text with each of the other five separators replaced by a space; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    for other in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(other), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The words of a text as an array; a split at one plain character is several times faster than a pattern."""
    return F.array_remove(F.split(spaced(text), " "), "")


_STEP = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(block: np.ndarray) -> np.ndarray:
    space = _IS_SPACE[block]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = block[starts[0] :]
    space, starts = space[starts[0] :], starts - starts[0]
    at = np.arange(len(body)) - np.repeat(starts, np.diff(starts, append=len(body)))
    powers = np.cumprod(np.full(int(at.max()) + 1, _RADIX, np.uint64))
    value = _BYTE[body] * powers[at]
    value[space] = 0
    return mixed(np.add.reduceat(value, starts))


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, in order; `fold` lower-cases A-Z first.

    Works through the text in steps that end at a space, so memory does not grow with its length.
    """
    data = np.frombuffer(text, np.uint8)
    if fold:
        data = _FOLD[data]
    out, at = [], 0
    while at < len(data):
        end = min(at + _STEP, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_IS_SPACE[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        out.append(_hash_block(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def utf8(texts) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    return [b"" if t is None else t.encode("utf-8") for t in texts.to_pylist()]
