"""Length-delimited binary records of token ids, with a separate offset index.

File format (little-endian), one record per document, in ascending doc_id order over the files:

    8 bytes  length of the payload          4 bytes  masked CRC-32 of those 8 bytes
    payload                                 4 bytes  masked CRC-32 of the payload
    1 byte   line feed, which closes the frame

The payload is the doc_id (8 bytes, signed; a flag byte before it tells a null one), the width of an
id in bytes (1 byte: 2 or 4) and the ids. A mask rotates a checksum and adds a constant, so that a
checksum of data that holds checksums stays strong. The index has one row per record: file, offset,
frame length, doc_id and ids before it, so that a shuffled reader can open any record directly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.common import stage, tokenizer_path, word_ids
from lorebase.session import shared_dir

MASK = 0xA282EAD8  # fixed value, as customary for framed records
HEAD, FOOT, META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<?qB")
FRAME = HEAD.size + FOOT.size + 1
FILE_BYTES = 32 << 20
INDEX = "file string, offset long, frame_bytes long, doc_id long, n_tokens long, ids_crc32 long, valid boolean"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One framed record."""
    payload = META.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, FOOT.pack(masked(length)), payload, FOOT.pack(masked(payload)), b"\n"))


def unframe(data, offset: int) -> tuple[int, int | None, np.ndarray, bool]:
    """Frame size, doc_id, ids and whether all checks held, of the record at ``offset``.

    A frame whose length fails its check cannot be stepped over, so it takes the rest of the data.
    """
    broken = (len(data) - offset, None, np.array([], dtype="<u4"), False)
    if len(data) - offset < FRAME:
        return broken
    size, check = HEAD.unpack_from(data, offset)
    if masked(bytes(data[offset : offset + 8])) != check or offset + size + FRAME > len(data) or size < META.size:
        return broken
    payload = data[offset + HEAD.size : offset + HEAD.size + size]
    valid = FOOT.unpack_from(data, offset + HEAD.size + size)[0] == masked(payload)
    null, doc_id, width = META.unpack_from(payload)
    if width not in (2, 4) or (size - META.size) % width:
        return size + FRAME, None, broken[2], False
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=META.size).astype("<u4")
    return size + FRAME, None if null else doc_id, ids, valid


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text, close it with ``end_id`` and write framed records in doc_id order.

    Rows are range-partitioned by doc_id, so a file holds a run of ids and is written by one task;
    the number of files follows the input's size. Spark's own writer commits the files, so a retried task leaves none twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path(vocabulary))
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            frames = [
                frame(doc_id, np.frombuffer(encoder.ids(text.as_py()) + end, dtype="<u4"), width)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            ]
            # the frame's own line feed is the separator that the text writer appends
            yield pa.RecordBatch.from_arrays([pa.array([f[:-1] for f in frames], pa.binary())], ["record"])

    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    framed = ordered.mapInArrow(run, "record binary")
    framed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Scan the files and check every frame: ``file, offset, frame_bytes, doc_id, n_tokens, ids_crc32, valid``.

    A record whose checksum fails is returned with ``valid`` false; a broken length ends its file,
    and the bytes after it are one such row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, offset, rows = memoryview(content.as_buffer()), 0, []
                while offset < len(data):
                    size, doc_id, ids, valid = unframe(data, offset)
                    rows.append((file, offset, size, doc_id, len(ids), zlib.crc32(ids.tobytes()), valid))
                    offset += size
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["file", "offset", "frame_bytes", "doc_id", "n_tokens", "ids_crc32", "valid"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan the records once and write the offset index beside them; returns the index.

    ``start`` (ids of all records before) is a sum inside each file plus the totals of the files
    before it, in the order of the numbers in their names, whatever their width.
    """
    scanned = stage(read_frames(spark, path), "frames")
    totals = scanned.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    part = lambda mark: F.regexp_extract("file", f"{mark}([0-9]+)", 1).try_cast("long")
    before = Window.orderBy(part("^part-"), part("-c"), "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("skipped")
    index = scanned.join(totals, "file").withColumn("start", start.cast("long")).drop("skipped")
    return stage(index, "offsets")


def read_at(content: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """Random access through the index: the doc_id and ids of the record at ``offset`` of a file's bytes."""
    _, doc_id, ids, valid = unframe(memoryview(content), offset)
    if not valid:
        raise ValueError(f"the record at offset {offset} fails its checks")
    return doc_id, ids


def write_and_read(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", *, end_id: int = 2) -> DataFrame:
    """Write framed records of all documents, index them, and return one row per document from the files.

    Columns ``doc_id, start, n_tokens, ids_crc32`` (and ``file, offset, valid``). A null text is empty: its record holds the
    end id alone. Null doc_ids come first; rows that repeat a doc_id are records of their own, in the
    order of their text's hash. An empty table gives no rows. Other columns are ignored.
    """
    path = shared_dir(docs.sparkSession, "records")
    write_records(docs, path, vocabulary, end_id)
    return write_index(docs.sparkSession, path).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "valid"
    )
