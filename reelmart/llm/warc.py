"""WARC archives: a writer of per-record gzip members, and a reader that salvages damaged files.

**Writer.** ``write_warc`` makes one record per page. Of pages with equal payloads that with the
smallest page_id is stored as ``response``, the others as ``revisit`` records that name it. Members
are written by Spark's own text sink, byte for byte, so that any file system Spark knows will do and
tasks of lost executors are simply run again.

**Reader.** ``read_warc`` checks each record: the member inflates and passes its checksum, the
version line and the header parse, the block has the stated length and the payload the stated digest.
After a failed check it looks for the next gzip member or version line from which a record passes,
goes on there, and reports the bytes in between as a gap. Compressed and plain records may alternate.

Defined results: NULL html is an empty payload; NULL url writes no target; a NULL page_id is kept and
comes after all others in the choice of the response; rows that repeat the smallest page_id of their
payload are all responses; an empty table makes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmart.scratch import written
from reelmart.shipping import ship_package

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = b"WARC/1."
RECORD_TYPES = {"response", "revisit"}
SAME_DIGEST = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"

ZIP_LEVEL = 4
# Text that one Arrow batch of records may hold before it is passed on.
BATCH_BYTES = 8 << 20

RECORD_COLUMNS = (
    "file string, offset bigint, length bigint, gap_reason string, record_type string, "
    "record_id string, target string, refers_to string, payload_bytes bigint, "
    "payload_digest string, payload binary"
)
_RECORD_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("gap_reason", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


class Record(NamedTuple):
    """A record that passed its checks, or (``gap_reason`` set) a stretch of bytes left out."""

    offset: int
    length: int
    gap_reason: str | None = None
    record_type: str | None = None
    record_id: str | None = None
    target: str | None = None
    refers_to: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_id(record_id: str) -> str:
    return f"<urn:page:{record_id}>"


def record_bytes(
    record_id: str, target: str | None, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """One uncompressed record; with ``refers_to`` a revisit, whose block is the HTTP header alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_page_id(record_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
    ]
    if target is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", target))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_page_id(refers_to)}", f"WARC-Profile: {SAME_DIGEST}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero.

    That byte is the highest of the uncompressed length; from 16 MB on it may not be zero, and an
    empty member follows.
    """
    member = _gzip(record)
    return member if member[-1] == 0 else member + _gzip(b"")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(ZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# Reading one file ----------------------------------------------------------------------------


class _Bad(Exception):
    """A check failed; the message says which."""


def _header(lines: Iterable[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", value):
        raise _Bad("content length")
    return int(value)


def _parse(data: bytes | memoryview, start: int, end: int) -> tuple[dict, bytes, int]:
    """Header, block and end of the plain record at ``start``."""
    data = bytes(data[start:end]) if isinstance(data, memoryview) else data[start:end]
    if not data.startswith(VERSION_LINE):
        raise _Bad("version line")
    head_end = data.find(b"\r\n\r\n")
    if head_end < 0:
        raise _Bad("header")
    fields = _header(data[:head_end].split(b"\r\n")[1:])
    begin = head_end + 4
    finish = begin + _length(fields)
    if data[finish : finish + 4] != b"\r\n\r\n":
        raise _Bad("block length")
    return fields, data[begin:finish], start + finish + 4


def _checked(fields: dict, block: bytes, offset: int, length: int, with_payload: bool) -> Record:
    kind = fields.get("warc-type", "")
    size = digest = payload = None
    stated = fields.get("warc-payload-digest", "")
    stated = stated[5:] if stated.startswith("sha1:") else None
    if kind in RECORD_TYPES and fields.get("content-type", "").startswith("application/http"):
        http, blank, body = block.partition(b"\r\n\r\n")
        if not blank:
            raise _Bad("http header")
        if kind == "revisit":
            size, digest = _length(_header(http.split(b"\r\n")[1:])), stated
        else:
            size, digest, payload = len(body), payload_digest(body), body
            if stated is not None and stated != digest:
                raise _Bad("payload digest")
    else:
        payload = block
        size, digest = len(block), payload_digest(block)

    def page(name: str) -> str | None:
        value = fields.get(name)
        return value and re.sub(r"^<urn:page:(.*)>$", r"\1", value)

    return Record(
        offset, length, None, kind, page("warc-record-id"), fields.get("warc-target-uri"),
        page("warc-refers-to"), size, digest, payload if with_payload else None,
    )


def _record_at(data: bytes, at: int, with_payload: bool) -> tuple[Record | None, int]:
    """The record that begins at ``at`` and the place after it; None for an empty member."""
    if data[at : at + 3] == GZIP_MAGIC:
        unzip = zlib.decompressobj(31)
        plain = bytearray()
        view, place = memoryview(data), at
        try:
            while not unzip.eof and place < len(data):
                plain += unzip.decompress(view[place : place + (1 << 20)])
                place += 1 << 20
        except zlib.error:
            raise _Bad("gzip data") from None
        if not unzip.eof:
            raise _Bad("gzip member cut short")
        end = min(place, len(data)) - len(unzip.unused_data)
        if not plain:
            return None, end
        fields, block, used = _parse(bytes(plain), 0, len(plain))
        if used != len(plain):
            raise _Bad("more than one record in a member")
        return _checked(fields, block, at, end - at, with_payload), end
    if data[at : at + len(VERSION_LINE)] == VERSION_LINE:
        # The block length in the header bounds what is looked at.
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            raise _Bad("header")
        stop = head_end + 8 + _length(_header(data[at:head_end].split(b"\r\n")[1:]))
        fields, block, end = _parse(data, at, stop)
        return _checked(fields, block, at, end - at, with_payload), end
    raise _Bad("no member or version line")


_STARTS = re.compile(re.escape(GZIP_MAGIC) + b"|" + re.escape(VERSION_LINE))


def salvage(data: bytes, with_payload: bool = True) -> Iterator[Record]:
    """Records and gaps of one archive, in file order; together they cover every byte.

    After a failed check each later start is tried in turn, so a start that lies within damaged
    bytes by chance does not end the search.
    """
    at = gap = 0
    reason = None
    while at < len(data):
        try:
            record, end = _record_at(data, at, with_payload)
        except _Bad as failed:
            reason = reason or str(failed)
            found = _STARTS.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if reason is not None:
            yield Record(gap, at - gap, reason)
            reason = None
        if record is not None:
            yield record
        at = gap = end
    if reason is not None:
        yield Record(gap, len(data) - gap, reason)


def _read_batches(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, held = [], 0
            for record in salvage(content.as_py(), with_payload):
                rows.append((path.as_py(), *record))
                held += len(record.payload or b"") + 200
                if held >= BATCH_BYTES:
                    yield _as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _as_batch(rows)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, field.type) for c, field in zip(zip(*rows), _RECORD_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_RECORD_SCHEMA)


# Spark ---------------------------------------------------------------------------------------


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record and per gap of the archives in ``path``, see ``RECORD_COLUMNS``.

    ``gap_reason`` is NULL for records; for gaps only file, offset, length and the reason are set.
    One task reads a file; ``write_warc`` keeps files small, and Spark's binary source takes files
    up to 2 GB as far as the memory of an executor goes.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _read_batches(batches, with_payload), RECORD_COLUMNS)


def gaps(records: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, length and reason of every stretch that was left out."""
    return records.where("gap_reason IS NOT NULL").select("file", "offset", "length", "gap_reason")


def _write_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("member", pa.binary())])
    for batch in batches:
        members, held = [], 0
        for page_id, url, html, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
            payload = (html or "").encode()
            record = record_bytes(
                str(page_id), url, payload, payload_digest(payload), str(refers_to) if is_revisit else None
            )
            members.append(gzip_member(record)[:-1])
            held += len(members[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], schema=schema)
                members, held = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], schema=schema)


def first_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Distinct ``(its_page, its_hash, refers_to, is_revisit)`` of the pages that are revisits.

    Payloads are compared by their SHA-256 hash. Those of fewer than ``min_bytes`` bytes are never
    revisits. The payloads themselves are not shuffled, and equal payloads combine before the shuffle.
    """
    hashed = pages.select(
        F.col("page_id").alias("its_page"), _payload_hash("html").alias("its_hash")
    ).where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
    # Written, so that the join can split a payload that many pages have.
    first = written(
        hashed.groupBy(F.col("its_hash").alias("hash"))
        .agg(F.min("its_page").alias("refers_to"), F.count("*").alias("pages"))
        .where("pages > 1")
    )
    return (
        hashed.distinct()
        .join(first, F.col("its_hash") == F.col("hash"))
        .where("NOT (its_page <=> refers_to)")
        .select("its_page", "its_hash", "refers_to", F.lit(True).alias("is_revisit"))
    )


def _payload_hash(column: str):
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 5_000) -> None:
    """Archives of ``pages`` (page_id, url, html) in the new folder ``path``."""
    ship_package(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    revisits = first_pages(pages, min_bytes)
    known = F.col("page_id").eqNullSafe(F.col("its_page")) & (_payload_hash("html") == F.col("its_hash"))
    members = (
        pages.join(revisits, known, "left")
        .select("page_id", "url", "html", "refers_to", F.coalesce("is_revisit", F.lit(False)))
        .mapInArrow(_write_batches, "member binary")
    )
    # The sink ends each row by the separator, here the zero byte that ends each member.
    (
        members.select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\u0000")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )
