"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what it can.

Writer: one gzip member per record, so a damaged byte costs one record. Of the pages with equal
payloads of at least `min_bytes`, the one with the smallest id is stored as `response`, the others as
`revisit` records that name it. The files are written by Spark's text sink (members as raw bytes, an
empty member between them), hence to any store that Spark reaches.

Reader: a member or record must decompress, have a version line, whole headers, a block as long as
announced, and the announced digest. After a failed check the reader goes on at the next place where
a gzip member or a version line begins and passes all checks; the bytes skipped are logged as a gap. The same holds inside
a member: what it gives before it breaks off is read, records before and after a damaged one are kept, and such a gap
has its offset inside the member (`inner_offset`) and counts uncompressed bytes.

Nulls: a null payload is empty, a null url is left out, a page without an id is written with an empty
one and read back as null. Pages that repeat the smallest id of their payload are all `response`. An
empty table gives an archive without records. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "file string, offset long, inner_offset long, record_id string, record_type string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, gap_bytes long, gap_reason string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP % len(payload) + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if record_id is None else quote(str(record_id))}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{quote(str(refers_to))}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _id_in(value: str) -> str | None:
    return unquote(value.removeprefix("<urn:page:").removesuffix(">")) or None


def _record_at(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins here and its end, or what is wrong with it."""
    if not _VERSION.match(data, at):
        return "no version line"
    end_of_head = data.find(b"\r\n\r\n", at)
    if end_of_head < 0:
        return "headers do not end"
    try:
        lines = data[at:end_of_head].decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(head["content-length"])
    except (ValueError, KeyError):
        return "headers cannot be read"
    begin, end = end_of_head + 4, end_of_head + 4 + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        return "block is not as long as announced"
    block = data[begin:end]
    if head.get("warc-block-digest", f"sha1:{sha1_base32(block)}") != f"sha1:{sha1_base32(block)}":
        return "block digest differs"
    kind = head.get("warc-type")
    if kind == "revisit":
        payload = None
        size, digest = head.get("warc-payload-length"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        size, digest = len(payload), sha1_base32(payload)
        if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            return "payload digest differs"
    refers = head.get("warc-refers-to")
    return {
        "record_id": _id_in(head.get("warc-record-id", "")),
        "record_type": kind,
        "url": head.get("warc-target-uri"),
        "refers_to": _id_in(refers) if refers else None,
        "payload_bytes": None if size is None else int(size),
        "payload_digest": digest,
        "payload": payload,
    }, end + 4


def _decompressed(data: bytes, at: int, step: int) -> tuple[bytes, int, str | None]:
    """What a member gives, where it ends or breaks off, and what is wrong with it."""
    unpacker = zlib.decompressobj(31)
    out, fed = [], at
    try:
        while not unpacker.eof and fed < len(data):
            out.append(unpacker.decompress(data[fed : fed + step]))
            fed += step
    except zlib.error:
        return b"".join(out), fed, "member does not decompress"
    if not unpacker.eof:
        return b"".join(out), len(data), "member is cut short"
    return b"".join(out), min(fed, len(data)) - len(unpacker.unused_data), None


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    whole = _decompressed(data, at, 65536)
    # a failed call gives nothing of its own bytes, so a broken member is taken in small steps
    return whole if whole[2] is None else _decompressed(data, at, 64)


def _inside(inner: bytes) -> tuple[list[tuple[int, dict]], list[tuple[int, int, str]]]:
    """The records of a member's bytes with their places, and the gaps between them: place, length, reason."""
    records, gaps, at, lost, reason = [], [], 0, None, ""
    while at < len(inner):
        one = _record_at(inner, at)
        if isinstance(one, str):
            if lost is None:
                lost, reason = at, one
            at = inner.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        if lost is not None:
            gaps.append((lost, at - lost, reason))
            lost = None
        records.append((at, one[0]))
        at = one[1]
    if lost is not None:
        gaps.append((lost, len(inner) - lost, reason))
    return records, gaps


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order; each has `offset`, a gap has `gap_bytes` too."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        records, gaps, problem = [], [], None
        if data.startswith(_MAGIC, at):
            inner, end, problem = _member_at(data, at)
            whole = problem is None
            records, gaps = _inside(inner)
            good = bool(records) or (whole and not gaps)
            problem = problem or (gaps[0][2] if gaps else None)
        else:
            one = _record_at(data, at)
            good = whole = not isinstance(one, str)
            if good:
                records, end = [(0, one[0])], one[1]
            else:
                problem = one
        if not good:
            if lost is None:
                lost, reason = at, problem
            at = _next_place(data, at)
            continue
        if lost is not None and at > lost and (records or end == len(data)):
            yield {"offset": lost, "gap_bytes": at - lost, "gap_reason": reason}
        if records or end == len(data) or (lost is not None and at <= lost):
            lost = None
        for _, one in records:
            yield {"offset": at, **one}
        for inner_at, length, why in gaps:
            yield {"offset": at, "inner_offset": inner_at, "gap_bytes": length, "gap_reason": why}
        if whole:
            at = end
        else:  # the member broke off at `end`; a valid one may begin before that, in bytes it took for its own
            lost, reason = end, problem
            at = _next_place(data, at)
    if lost is not None and lost < len(data):
        yield {"offset": lost, "gap_bytes": len(data) - lost, "gap_reason": reason}


def _next_place(data: bytes, at: int) -> int:
    places = [p for p in (data.find(_MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if p >= 0]
    return min(places, default=len(data))


def with_originals(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Pages (page_id, url, payload) and, where another holds the same payload, whose it is.

    The smallest id of each payload comes from an aggregate that combines before its shuffle; it is
    joined back on the digest, a join whose large keys Spark can split.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), body.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("key")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("held"))
        .where("held > 1")
        .select("key", "first_id")
    )
    same = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "key", "left").select(
        "page_id", "url", "payload", F.when(~same, F.col("first_id")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    payload_col: str = "html",
    min_bytes: int = 0,
    records_per_file: int = 2000,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one archive per task and `records_per_file` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "refers_to"))
            packed = [member(record(i, u, p, r, date)) for i, u, p, r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])

    (
        with_originals(pages, id_col, payload_col, min_bytes)
        .mapInArrow(run, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives of a folder; gaps have `gap_bytes`. A file is read by one task."""
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for row in salvage(content):
                    row["file"] = path
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 256:
                        yield _rows(names, rows)
                        rows = []
                if rows:
                    yield _rows(names, rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, RECORDS)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(names: list[str], rows: list[dict]) -> pa.RecordBatch:
    kinds = [_ARROW[part.split()[1]] for part in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)


def records(read: DataFrame) -> DataFrame:
    return read.where("gap_bytes IS NULL").drop("gap_bytes", "gap_reason")


def quarantine(read: DataFrame) -> DataFrame:
    """Byte ranges that no check accepted."""
    return read.where("gap_bytes IS NOT NULL").select("file", "offset", "gap_bytes", "gap_reason")
