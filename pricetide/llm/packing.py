"""Token-id files: ids packed in the fewest bits their vocabulary needs, in blocks that are read alone.

A file is a sequence of sections, each followed by one newline byte:

* a header: the magic number, then bits of an id and ids of a full block;
* blocks: ids one after another in so many bits each, lowest bits first, padded to whole bytes;
* an index: the block table (byte offset of each block, number of its first id), then the documents
  (id, whether it is null, number of its first id), all as little-endian 64-bit integers but the flags;
* a trailer: the counts, where the index starts and its crc32, and the magic number again.

A block never depends on another, so any id range is read by unpacking the blocks that hold it. Files are
in document order: all documents of part n come before those of part n + 1. They are written by
Spark's own sink, so a lost task leaves no half file.

Nulls: a null text is empty and holds only what is appended; null document ids come first. Repeated ids
are ordered by their texts' hash and keep a row each. Other columns are not read. An empty table gives no
documents. A text may be split over blocks but not over files.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetide.llm import pieces as P
from pricetide.llm.common import id_and_text
from pricetide.session import cut_lineage

MAGIC = b"PTIDPK01"
#: Ids of a full block, and bytes of text a file is meant to hold.
BLOCK_IDS, FILE_BYTES = 1 << 16, 256 << 20
#: Bytes of text that are encoded at once, and words a worker remembers.
TEXT_BYTES, REMEMBERED = 4 << 20, 600_000
_HEADER, _TRAILER = struct.Struct("<8sII"), struct.Struct("<QQQQI8s")


def width(vocabulary: int) -> int:
    """Bits for ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` each, lowest bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.reshape(-1), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids `start` to `stop` of packed bytes, without those before or after them."""
    at = np.arange(start, stop, dtype=np.int64) * bits
    first = start * bits >> 3
    body = np.frombuffer(data, np.uint8)[first : (stop * bits + 7) >> 3]
    if bits in (8, 16, 32):
        return body.view(f"<u{bits // 8}").astype(np.uint32)
    body = np.concatenate([body, np.zeros(5, np.uint8)])
    value = np.zeros(len(at), np.uint64)
    for k in range(5):  # an id of up to 32 bits touches five bytes at most
        value |= body[(at >> 3) - first + k].astype(np.uint64) << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def sections(documents: Iterator[tuple[int | None, np.ndarray]], bits: int, block_ids: int = BLOCK_IDS) -> Iterator[bytes]:
    """A file's sections for documents in order; no more than a block and one document are held."""
    at = 0

    def placed(section: bytes) -> bytes:
        nonlocal at
        at += len(section) + 1
        return section

    yield placed(_HEADER.pack(MAGIC, bits, block_ids))
    offsets, firsts, ids, nulls, starts = [], [], [], [], []
    waiting: list[np.ndarray] = []
    held = done = 0
    for doc_id, tokens in documents:
        ids.append(doc_id or 0)
        nulls.append(doc_id is None)
        starts.append(done + held)
        waiting.append(tokens)
        held += len(tokens)
        while held >= block_ids:
            joined = np.concatenate(waiting)
            offsets.append(at)
            firsts.append(done)
            yield placed(packed(joined[:block_ids], bits))
            waiting, held, done = [joined[block_ids:]], held - block_ids, done + block_ids
    if held:
        offsets.append(at)
        firsts.append(done)
        yield placed(packed(np.concatenate(waiting), bits))
        done += held
    numbers = [np.array(x, "<i8") for x in (offsets, firsts, ids)]
    index = b"".join([x.tobytes() for x in numbers] + [np.array(nulls, np.uint8).tobytes(), np.array(starts, "<i8").tobytes()])
    begin = at
    yield placed(index)
    yield _TRAILER.pack(done, len(ids), len(offsets), begin, zlib.crc32(index), MAGIC)


class IdFile:
    """A file's index, and its ids by position. `content` is the whole file or a map of it."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        magic, self.bits, self.block_ids = _HEADER.unpack_from(content, 0)
        trailer = len(content) - _TRAILER.size - 1
        self.n_ids, self.n_documents, n_blocks, begin, crc, again = _TRAILER.unpack_from(content, trailer)
        index = memoryview(content)[begin : trailer - 1]
        if magic != MAGIC or again != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole token-id file")
        n, d = 8 * n_blocks, 8 * self.n_documents
        self.offsets, self.firsts = np.frombuffer(index[:n], "<i8"), np.frombuffer(index[n : 2 * n], "<i8")
        rest = index[2 * n :]
        self.doc_ids, self.nulls = np.frombuffer(rest[:d], "<i8"), np.frombuffer(rest[d : d + self.n_documents], bool)
        self.starts = np.append(np.frombuffer(rest[d + self.n_documents :], "<i8"), self.n_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids by their number in the file; only blocks that hold some are touched."""
        out = []
        block = int(np.searchsorted(self.firsts, start, "right")) - 1
        while start < stop:
            first = int(self.firsts[block])
            end = min(stop, first + self.block_ids)
            data = memoryview(self.content)[int(self.offsets[block]) : int(self.offsets[block]) + ((end - first) * self.bits + 7) // 8]
            out.append(unpacked(data, self.bits, start - first, end - first))
            start, block = end, block + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Kinds of bytes in plain words: letters (ASCII, and the two bytes of U+00C0 to U+00FF), digits, other signs.
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = _SIGN
_KIND[list(b"'<|")] = 0  # may start a contraction or a special token
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT


class WordEncoder:
    """Ids of whole texts, for a tokenizer that drops white space and marks the ends of its words.

    A new word goes through the library once. Plain words go many in a row, told apart by the number of
    ends in each: one for each run of letters, each digit and each run of signs. Others go one by one.
    """

    ROW = 256

    def __init__(self, file: bytes) -> None:
        self.tokenizer = Tokenizer.from_buffer(file)
        self.memory = P.Memory(REMEMBERED)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(words: pa.Array) -> np.ndarray:
        """Word ends of each plain word, 0 for others."""
        offsets, data = P.buffers(words)
        kind = _KIND[data]
        second = np.flatnonzero(data == 0xC3) + 1  # of a letter; the signs U+00D7 and U+00F7 are none
        kind[second] = np.where((data[second] == 0x97) | (data[second] == 0xB7), 0, _LETTER)
        new = kind != np.concatenate([[0], kind[:-1]])
        new[offsets[:-1]] = True
        new |= kind == _DIGIT
        return np.where(P.run_sums(kind == 0, offsets) == 0, P.run_sums(new, offsets), 0)

    def _made(self, words: pa.Array) -> P.Made:
        parts = self._parts(words)
        plain = np.flatnonzero(parts)
        alone, made = [np.flatnonzero(parts == 0)], []
        texts = pc.take(words, pa.array(plain)).to_pylist()
        for at in range(0, len(plain), self.ROW):
            places = plain[at : at + self.ROW]
            ids = np.array(self._ids([b" ".join(texts[at : at + self.ROW]).decode()])[0], np.int32)
            ends, last = np.flatnonzero(self.ends[ids]), np.cumsum(parts[places]) - 1
            if len(ends) == last[-1] + 1:
                made.append((places, np.diff(ends[last], prepend=-1), ids))
            else:
                alone.append(places)
        alone = np.concatenate(alone)
        texts = pc.take(words, pa.array(alone)).cast(pa.string()).to_pylist()
        for at in range(0, len(texts), 4096):
            found = self._ids(texts[at : at + 4096])
            own = np.fromiter(map(len, found), np.int64, len(found))
            made.append((alone[at : at + 4096], own, np.concatenate([np.array(ids, np.int32) for ids in found])))
        return P.in_order(made, len(words))

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text where it is given, and the texts' offsets among them."""
        distinct, places, offsets = P.words(texts)
        numbers, starts, counts = self.memory.values(distinct, self._made)
        own = counts[places]
        ids = numbers[P.ragged(starts[places], own)].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(own)])[offsets]
        if end is None:
            return ids, ends
        return np.insert(ids, ends[1:], end), ends + np.arange(len(ends))


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES, text_bytes: int = TEXT_BYTES,
) -> None:
    """Encode whole texts and write their ids, `end` after each text where it is given, in ascending document order.

    Texts are dealt by ranges of document ids and encoded where they are written, so ids are never
    shuffled. Ranges also split one id, or one row, that a large part of the rows repeats.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    order = ["doc_id", "_hash", "_row"]
    numbered = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = numbered.repartitionByRange(files, *order).sortWithinPartitions(*order)
    bits = width(vocabulary)
    file = spark.sparkContext.broadcast(open(tokenizer_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = P.loaded("words", file.value, WordEncoder)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for table in P.sized(batches, "text", text_bytes):
                ids, offsets = encoder.encode(P.whole(table.column("text"), pa.string()).fill_null(""), end)
                for k, doc_id in enumerate(table.column("doc_id").to_pylist()):
                    yield doc_id, ids[offsets[k] : offsets[k + 1]]
                pa.default_memory_pool().release_unused()

        found = documents()
        for first in found:  # a part without rows leaves no file
            for section in sections(itertools.chain([first], found), bits, block_ids):
                yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], ["section"])

    written = dealt.select("doc_id", "text").mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value"))
    written.write.option("lineSep", "\n").text(folder)


def read(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, the crc32 of its ids, ids.

    Each file is read by one task; where it starts in the whole comes from the files' totals, one number each.
    """
    schema = "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                file = IdFile(content.as_buffer())
                for at in range(0, file.n_documents, 1024):
                    stop = min(at + 1024, file.n_documents)
                    ids = [file.document(k).astype("<u4").tobytes() for k in range(at, stop)]
                    columns = {
                        "part": pa.array([part] * (stop - at), pa.int32()),
                        "doc_id": pa.array(file.doc_ids[at:stop], mask=file.nulls[at:stop]),
                        "own_start": pa.array(file.starts[at:stop]),
                        "n_tokens": pa.array(np.diff(file.starts[at : stop + 1])),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    part = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("part")
    rows = cut_lineage(files.select(part, "content").mapInArrow(run, schema))
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, bases = 0, []
    for part, total in totals:
        bases.append((part, before))
        before += total
    base = spark.createDataFrame(bases, "part int, base long")
    told = ["n_tokens", "ids_crc32", *["ids"] * keep_ids]
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), *told)
