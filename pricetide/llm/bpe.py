"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. Every adjacent pair that has a merge rank waits in the
bucket of that rank; a bitmap of two levels over the ranks tells by find-first-set which bucket is
next, whatever the length of the pre-token. A merge changes two pairs; their old entries stay where
they are and are skipped when they surface. Work grows as n log n in the length of a pre-token.

Nulls: a null text encodes as an empty one, null ids decode to empty bytes. Other columns pass
through, except that the output column replaces one of its own name. Rows are independent, so ties,
repeated rows, null ids and empty tables need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm import pieces as P

#: Pre-tokens up to this length are remembered by a worker, and so many of them at once.
REMEMBERED_CHARS, REMEMBERED = 48, 200_000
#: Spaced words whose ids a worker remembers, and bytes of text that are taken at once.
WORDS, TEXT_BYTES = 1_500_000, 4 << 20


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The queue is written out in place, as it runs for every new pre-token: `buckets` has the waiting
    positions of a rank (leftmost first), `leaves` a bitmap of 256 ranks each, `top` one bit a leaf.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    waiting = [-1] * n  # the rank under which the pair that starts here was queued last
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for at in range(n - 1):
        rank = get(piece[at : at + 2])
        if rank is not None:
            waiting[at] = rank
            if rank in buckets:
                buckets[rank].append(at)
            else:
                buckets[rank] = [at]
                leaf = rank >> 8
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & 255)
                top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1
        mask = leaves[leaf]
        first = mask & -mask
        rank = leaf << 8 | first.bit_length() - 1
        bucket = buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del buckets[rank]
            leaves[leaf] = mask = mask ^ first
            if not mask:
                top &= top - 1
        if waiting[at] != rank:
            continue  # stale: one of its two tokens has been merged since
        gone = after[at]
        waiting[gone] = -1
        after[at] = end = after[gone]
        before[end] = at
        waiting[at] = -1
        for left in (at, before[at]) if at else (at,):
            middle = after[left]
            if middle >= n:
                continue
            rank = get(piece[left : after[middle]])
            if rank is None:
                waiting[left] = -1
                continue
            waiting[left] = rank
            if rank in buckets:
                heapq.heappush(buckets[rank], left)
            else:
                buckets[rank] = [left]
                leaf = rank >> 8
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & 255)
                top |= 1 << leaf
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Remembered(dict):
    """Packed ids of pre-tokens, computed when first asked for.

    Two generations bound the memory: a full one becomes the old one, and what is met again moves on.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = merged(word.encode("utf-8"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= REMEMBERED_CHARS:
            self[word] = packed
        return packed

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Codec:
    def __init__(self, rank_file: bytes, pattern: str) -> None:
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = dict.fromkeys(range(max(self.ranks.values(), default=-1) + 1), b"")
        tokens.update((rank, token) for token, rank in self.ranks.items())
        self.tokens = pa.array(tokens.values(), pa.binary())
        self.split = regex.compile(pattern).findall
        self.known = _Remembered(self.ranks)
        self.memory = P.Memory(WORDS)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.known.age()
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def _made(self, pieces: pa.Array) -> P.Made:
        packed = [self.encode(text) for text in pieces.cast(pa.string()).to_pylist()]
        return np.frombuffer(b"".join(packed), "<i4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4

    def encode_all(self, texts: pa.Array, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' offsets among them. By words, each new word is split and merged once."""
        if not by_words:
            ids, counts = self._made(texts)
            return ids, np.concatenate([[0], np.cumsum(counts)])
        distinct, places, offsets = P.spaced(texts)
        numbers, starts, counts = self.memory.values(distinct, self._made)
        own = counts[places]
        return numbers[P.ragged(starts[places], own)], np.concatenate([[0], np.cumsum(own)])[offsets]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of runs of ids."""
        ends, data = P.buffers(pc.take(self.tokens, pa.array(ids)))
        return P.binary_array(ends[offsets], data)

    def decode(self, packed: bytes) -> bytes:
        return self.decode_all(np.frombuffer(packed, "<u4"), np.array([0, len(packed) // 4]))[0].as_py()


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, name])


def _schema(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    The rank file (some hundred kilobytes, whatever the input) is read once, by the driver, and sent
    along; executors need no copy of it.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(text_col).to_pylist()]
            yield _with_column(batch, out_col, pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, _schema(docs, out_col))


def decode(tokens: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for."""
    ranks = tokens.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            texts = [codec.decode(i or b"") for i in batch.column(ids_col).to_pylist()]
            yield _with_column(batch, out_col, pa.array(texts, pa.binary()))

    return tokens.mapInArrow(run, _schema(tokens, out_col))


def digests(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True
) -> DataFrame:
    """Per document: the number of tokens, the digest of its ids and that of what they decode to, in one pass.

    `by_words` tells that the pattern starts a match at every single space between two characters that are no
    white space, as those of byte-level vocabularies do; then a batch's distinct words are encoded once each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for table in P.sized(batches, "text", TEXT_BYTES):
            texts = P.whole(table.column("text"), pa.string()).fill_null("")
            ids, offsets = codec.encode_all(texts, by_words)
            decoded = codec.decode_all(ids, offsets)
            packed, ends = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
            sha = lambda data: hashlib.sha256(data).hexdigest()
            yield pa.RecordBatch.from_pydict({
                "doc_id": table.column("doc_id").combine_chunks(),
                "n_tokens": pa.array(np.diff(offsets)),
                "ids_sha256": pa.array([sha(packed[a:b]) for a, b in zip(ends, ends[1:])], pa.string()),
                "decoded_sha256": pa.array([sha(x.as_buffer()) for x in decoded], pa.string()),
            })
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)
