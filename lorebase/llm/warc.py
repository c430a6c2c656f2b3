"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every record (version line, header, length, closing line breaks, block digest). After
a failed check it searches for the next place where a valid record starts - a gzip member or a
version line - goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import stage
from lorebase.session import shared_dir

VERSION, BREAK = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
MEMBER = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]{1,3}\r\n")
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
FILE_BYTES, PIECE = 32 << 20, 64 << 10
_NUMBER, _ID = re.compile("[0-9]{1,18}"), re.compile("-?[0-9]{1,19}")
FOUND = (
    "file string, offset long, length long, kind string, reason string, page_id long, url string,"
    " payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits make four base32 digits."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> bytes:
    """A header value on one line: line breaks and NUL are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00").encode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <%s%s>" % (PAGE_URN.encode(), name.encode()),
        b"WARC-Date: " + _clean(date),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + payload_digest.encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _clean(url))
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <%s%d>" % (PAGE_URN.encode(), refers_to)]
    return BREAK.join(head) + 2 * BREAK + block + 2 * BREAK


def _chunks(records: Iterable[bytes], size: int) -> Iterator[bytes]:
    """Contents of files of about ``size`` bytes; a larger record fills one alone."""
    held, total = [], 0
    for item in records:
        if held and total + len(item) > size:
            yield b"".join(held)
            held, total = [], 0
        held.append(item)
        total += len(item)
    if held:
        yield b"".join(held)


def write_archives(pages: DataFrame, path: str, *, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row. Of equal payloads of ``least`` bytes or more, the smallest page_id is the response.

    Only digests and ids are shuffled; the pages stay where they were read and are written in files of about 32 MB.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("payload"),
        base32_sha1(html.cast("binary")).alias("payload_digest"),
    )
    large = rows.filter(F.length("payload") >= least).groupBy("payload_digest")
    firsts = stage(large.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    typed = rows.join(firsts, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(k) for k in range(5)]
                for page_id, url, payload, name, refers_to in zip(*columns, strict=True):
                    yield record(page_id.as_py(), url.as_py(), payload.as_py(), name.as_py(), refers_to.as_py(), date)

        for content in _chunks(records(), FILE_BYTES):
            # the last line break is the separator that the text writer appends
            yield pa.RecordBatch.from_arrays([pa.array([content[:-2]], pa.binary())], ["content"])

    files = typed.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    """A record that fails a check. Version lines from there up to ``until`` fail the same check."""

    def __init__(self, reason: str, until: int = 0) -> None:
        super().__init__(reason)
        self.until = until


def parse_record(data: bytes, offset: int) -> tuple[Record, int]:
    """The record at ``offset`` and the offset behind it; raises Damaged with the failed check.

    Headers are read line by line and reading ends at the first line that is none. A later version line among the same
    headers has a suffix of them, so it fails too, up to the line that decided; the error names that place.
    """
    line = VERSION_LINE.match(data, offset)
    if not line:
        raise Damaged("no version line")
    headers, at, digest_at = {}, line.end(), 0
    while (end := data.find(BREAK, at)) != at:
        if end < 0:
            raise Damaged("header has no end", len(data))
        name, colon, value = data[at:end].partition(b":")
        if not colon:
            raise Damaged("header line without a colon", at)
        key = name.strip().decode("latin-1").lower()
        headers[key] = value.strip().decode("utf-8", "replace")
        if key == "warc-block-digest":
            digest_at = at
        at = end + 2
    length = headers.get("content-length", "")
    if not _NUMBER.fullmatch(length):
        raise Damaged("no content length", at)
    begin, stop = at + 2, at + 2 + int(length)
    if data[stop : stop + 4] != 2 * BREAK:
        raise Damaged("length does not end at a record's end", at)
    block = data[begin:stop]
    stated = headers.get("warc-block-digest", "")
    if stated.lower().startswith("sha1:") and stated[5:] != digest(block):
        raise Damaged("block digest differs", digest_at)
    return Record(headers, block), stop + 4


def _member(data: bytes, offset: int) -> tuple[Record, int]:
    """The record in the gzip member at ``offset``, and the offset behind the member. The file is fed in small pieces."""
    inflate, parts, at = zlib.decompressobj(31), [], offset
    try:
        while at < len(data) and not inflate.eof:
            piece = data[at : at + PIECE]
            parts.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error as error:
        raise Damaged(f"gzip: {error}") from None
    if not inflate.eof:
        raise Damaged("gzip: truncated member")
    content = b"".join(parts)
    try:
        found, end = parse_record(content, 0)
    except Damaged as damage:
        raise Damaged(str(damage)) from None  # its places are those of the content
    if end != len(content):
        raise Damaged("gzip: more than one record in a member")
    return found, at - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """All valid records and all gaps of an archive: (offset, length, record or None, reason or None).

    Together they cover every byte exactly once, in order. Gzip members and plain records may mix. One search finds the next
    member or version line, and version lines that are known to fail are passed over, so the cost is linear in the file,
    except for blocks and members that lie inside each other and all fail at their end.
    """
    offset, size = 0, len(data)
    while offset < size:
        start, reason, found, until = offset, None, None, 0
        while offset < size:
            try:
                found, end = (_member if data[offset : offset + 3] == MEMBER else parse_record)(data, offset)
                break
            except Damaged as damage:
                reason, until = reason or str(damage), max(until, damage.until)
            places = (m.start() for m in STARTS.finditer(data, offset + 1) if m.start() >= until or m[0] == MEMBER)
            offset = next(places, size)
        if offset > start:
            yield start, offset - start, None, reason
        if found is not None:
            yield offset, end - offset, found, None
            offset = end


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(PAGE_URN)
    value = int(name) if _ID.fullmatch(name) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _fields(found: Record) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a valid record."""
    head, _, payload = found.block.partition(2 * BREAK)
    kind, h = found.headers.get("warc-type"), found.headers
    size, name = len(payload), digest(payload)
    if kind == "revisit":  # the payload is with the response; its size and digest are stated here
        stated = [line[15:].strip() for line in head.split(BREAK) if line[:15].lower() == b"content-length:"]
        size = int(stated[0]) if stated and _NUMBER.fullmatch(stated[0].decode("latin-1")) else None
        name = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return _page(h.get("warc-record-id")), h.get("warc-target-uri"), size, name, kind, _page(h.get("warc-refers-to"))


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Salvage all archives under ``path``: one row per valid record (kind ``record``) and per gap (``gap``).

    A gap row has the file, the offset and length of its bytes and the first failed check. A file is one
    row of a task, so it must be smaller than 2 GiB; the writer makes files of about 32 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [field.split()[0] for field in FOUND.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [
                    (file, at, length, *(("record", None, *_fields(found)) if found else ("gap", reason, *[None] * 6)))
                    for at, length, found, reason in salvage(content.as_py())
                ]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, FOUND)


def archive_and_read(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write all pages as WARC records and return one row per page as read back from the archives.

    Columns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (and ``url``). A null html is an empty payload; a
    null url has no target line; null page_ids are never the response unless all of their group are
    null. Rows that repeat the smallest page_id of a group are all responses. An empty table gives no
    rows; other columns are ignored. A long html is written and read whole, as one record that fills a file alone.
    """
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path, "part-*").filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
