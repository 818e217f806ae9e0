"""Texts cut into pieces that a tokenizer treats each on its own, as Arrow arrays over shared buffers.

Words repeat, so a tokenizer meets each distinct piece of a batch once; whole texts are put together
again from the pieces' places. No Python object is made for a piece that is met before.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pricetide.llm.common import SPACES

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
# A character that starts with such a byte is no white space; of the other leads, each has some that are.
_SOLID_LEAD = np.zeros(256, bool)
_SOLID_LEAD[0x21:0x7F] = True
_SOLID_LEAD[0xC3:0xE0] = True
_SOLID_LEAD[0xE4:0xF8] = True


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The same rows in tables of about `limit` bytes; a longer text makes a table of its own. A row counts 64 bytes besides its text."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(lengths, np.int64) + 64)
        done = 0
        while done < batch.num_rows:
            before = int(ends[done - 1]) if done else 0
            stop = int(np.searchsorted(ends, before + max(limit - held, 0), "right"))
            if stop <= done and not waiting:
                stop = done + 1
            if stop > done:
                waiting.append(batch.slice(done, stop - done))
                held += int(ends[stop - 1]) - before
                done = stop
            if done < batch.num_rows or held >= limit:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def whole(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """One array of a column's chunks."""
    return pa.concat_arrays([c.cast(kind) for c in column.chunks]) if column.num_chunks else pa.array([], kind)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero, and the bytes, of a string or binary array without nulls."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


def binary_array(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An array over bytes that lie one after another."""
    parts = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, parts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at `starts`, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between consecutive offsets, as integers."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _coded(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = pc.dictionary_encode(pieces)
    return coded.dictionary, np.asarray(coded.indices)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and the texts' offsets among the places.

    For tokenizers that drop white space: a word is what lies between ASCII white space.
    """
    offsets, data = buffers(texts)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    opens = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[opens] |= solid[opens]
    at = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(solid)])
    distinct, places = _coded(binary_array(np.append(kept[at], kept[-1]), data[solid]))
    return distinct, places, np.searchsorted(at, offsets)


def _ends_solid(data: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is surely no white space; in one text, whatever precedes it."""
    ends = (data >= 0x21) & (data < 0x7F)
    ends[1:] |= (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    ends[2:] |= (data[:-2] >= 0xE4) & (data[:-2] < 0xF0)
    return ends


def spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the piece at each place, and the texts' offsets among the places.

    For tokenizers that keep a single space with the word after it. A piece starts with a space
    between two characters that are surely no white space, or with its text; pieces put one after
    another give the texts again.
    """
    offsets, data = buffers(texts)
    cut = data == 0x20
    if len(data):
        cut[:-1] &= _SOLID_LEAD[data[1:]]
        cut[-1] = False
        cut[1:] &= _ends_solid(data)[:-1]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(cut)
    distinct, places = _coded(binary_array(np.append(at, len(data)), data))
    return distinct, places, np.searchsorted(at, offsets)


def joinable(pieces: pa.Array) -> np.ndarray:
    """Pieces of a space and a word, which in a row stay pieces of their own."""
    offsets, data = buffers(pieces)
    starts, ends = offsets[:-1], offsets[1:]
    out = ends - starts > 1
    some = np.flatnonzero(out)
    out[some] = (data[starts[some]] == 0x20) & _SOLID_LEAD[data[starts[some] + 1]] & _ends_solid(data)[ends[some] - 1]
    return out


_LOADED: dict[tuple[str, str], object] = {}


def loaded(kind: str, file: bytes, load: Callable[[bytes], object]):
    """One object for each file and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = kind, hashlib.sha256(file).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = load(file)
    return _LOADED[key]


#: What is made of some pieces: all their numbers, and how many each has.
Made = tuple[np.ndarray, np.ndarray]


class Memory:
    """What was made of pieces met lately, in a worker process: plain arrays, some 40 bytes a piece.

    A full memory keeps the half that was met last.
    """

    def __init__(self, size: int, longest: int = 40) -> None:
        self.size, self.longest, self.now = size, longest, 0
        self.pieces = pa.array([], pa.binary())
        self.numbers, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def values(self, distinct: pa.Array, make: Callable[[pa.Array], Made]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, and where those of each piece start and how many they are; `make` is asked for what is not remembered."""
        self.now += 1
        at = pc.index_in(distinct, value_set=self.pieces)
        new = np.asarray(pc.is_null(at))
        at = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        fresh = pc.filter(distinct, pa.array(new))
        made, own = make(fresh)
        numbers = np.concatenate([self.numbers, made])
        begun = np.cumsum(own) - own + len(self.numbers)
        starts, counts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[new], counts[new] = begun, own
        old = at[~new]
        starts[~new], counts[~new] = self.starts[old], self.counts[old]
        self.met[old] = self.now
        self._keep(fresh, numbers, begun, own)
        return numbers, starts, counts

    def _keep(self, fresh: pa.Array, numbers: np.ndarray, begun: np.ndarray, own: np.ndarray) -> None:
        short = np.asarray(pc.less_equal(pc.binary_length(fresh), self.longest))
        pieces = pa.concat_arrays([self.pieces, pc.filter(fresh, pa.array(short))])
        starts, counts = np.concatenate([self.starts, begun[short]]), np.concatenate([self.counts, own[short]])
        met = np.concatenate([self.met, np.full(int(short.sum()), self.now)])
        if len(pieces) > self.size:
            last = np.sort(np.argpartition(met, len(met) - self.size // 2)[-(self.size // 2) :])
            pieces, starts, counts, met = pc.take(pieces, pa.array(last)), starts[last], counts[last], met[last]
        self.pieces, self.met, self.counts = pieces, met, counts
        self.numbers, self.starts = numbers[ragged(starts, counts)], np.cumsum(counts) - counts


def in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Made:
    """Numbers by place, from parts of (places, how many each has, numbers)."""
    counts = np.zeros(n, np.int64)
    starts = np.zeros(n, np.int64)
    at = 0
    for places, own, numbers in parts:
        counts[places] = own
        starts[places] = at + np.cumsum(own) - own
        at += len(numbers)
    flat = np.concatenate([np.zeros(0, np.int32), *(numbers for _, _, numbers in parts)])
    return flat[ragged(starts, counts)], counts
