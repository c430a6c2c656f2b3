"""Object store folders and dataset manifests as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import shared_dir

WHOLE_BYTES = 32 * 1024 * 1024
UNCUT = {  # a file is one split, and no other file joins it
    "spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}
MARK = b"\xef\xbb\xbf"  # of UTF-8, which line readers drop
DATASET_SCHEMA = "id string, split string, license string, task string, tasks array<string>, text string"


def objects(spark: SparkSession, root: str, pattern: str = "*", *, whole: int = WHOLE_BYTES) -> DataFrame:
    """Every file below ``root`` that is not empty, with size and sha256. Bytes never leave the executors.

    A file of at most ``whole`` bytes is one row; a larger one passes through its task line by line, so its size is not limited (a
    single line must stay below 2 GiB).
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    sums = found.filter(F.col("length") <= whole).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    endings = found.filter(F.col("length") > whole).select(_ending(F.col("path"))).distinct().collect()
    for (ending,) in sorted(endings):
        sums = sums.unionByName(_streamed(spark, root, pattern, ending, whole))
    return sums


def _ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]*$", 0))


def _streamed(spark: SparkSession, root: str, pattern: str, ending: str, whole: int) -> DataFrame:
    """Checksums of the large files with one ending, a file a task, written to the shared folder.

    The session of the scan cuts no file, and what looks compressed by its ending is read as it stands.
    """
    scan = spark.newSession()
    for key, value in UNCUT.items():
        scan.conf.set(key, value)
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    reader = scan.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if ending:
        reader = reader.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec").option(codec.OPT_EXTENSION, ending)
    lines = reader.load(root).filter((F.col("_metadata.file_size") > whole) & (_ending(F.col("_metadata.file_name")) == ending))
    sums = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"), F.col("value").cast("binary").alias("line")
    ).mapInArrow(_digests, "path string, size_bytes long, sha256 string")
    location = shared_dir(spark, "checksums")
    sums.write.parquet(location)
    return spark.read.schema(sums.schema).parquet(location)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file, of its lines in order; line breaks, and a byte order mark that the reader took, are put back."""
    name = size = None
    done: list[tuple] = []

    def close() -> None:
        missing = size - fed  # the last line break, the mark, or both
        if missing not in (0, 1, len(MARK), len(MARK) + 1):
            raise ValueError(f"{name} was not read whole: {fed} of {size} bytes")
        digest = plain if missing < len(MARK) else marked
        digest.update(b"\n" * (missing % len(MARK)))
        done.append((unquote(name), size, digest.hexdigest()))

    for batch in batches:
        runs = pc.run_end_encode(batch.column("path"))
        start = 0
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            lines = batch.column("line").slice(start, end - start)
            if path != name:
                if name is not None:
                    close()
                name, size, fed, plain, marked = path, batch.column("size_bytes")[start].as_py(), 0, sha256(), sha256(MARK)
            elif fed:
                plain.update(b"\n")
                marked.update(b"\n")
                fed += 1
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_buffer()
            plain.update(text)
            marked.update(text)
            fed, start = fed + len(text), end
    if name is not None:
        close()
    columns = list(zip(*done, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "size_bytes", "sha256"])


def jsonl(spark: SparkSession, path: str, schema: str = DATASET_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def manifest_diff(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Compare two (path, size_bytes, sha256) manifests; equal entries are left out."""
    r, f = recorded.alias("r"), found.alias("f")
    state = (
        F.when(F.col("f.path").isNull(), "missing")
        .when(F.col("r.path").isNull(), "extra")
        .when((F.col("r.sha256") != F.col("f.sha256")) | (F.col("r.size_bytes") != F.col("f.size_bytes")), "changed")
    )
    return (
        r.join(f, F.col("r.path") == F.col("f.path"), "full_outer")
        .select(F.coalesce("r.path", "f.path").alias("path"), state.alias("state"))
        .filter(F.col("state").isNotNull())
    )


def dataset_violations(records: DataFrame, splits: list[str]) -> DataFrame:
    """Contract of evaluation records over all files: ids, splits, licences, split coverage."""
    spark = records.sparkSession
    identifier = F.coalesce("id", F.lit(""))
    empty = records.filter(identifier == "").select(F.lit("missing_id").alias("violation"), F.lit("").alias("item"))
    repeated = (
        records.filter(identifier != "").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.lit("duplicate_id").alias("violation"), F.col("id").alias("item"))
    )
    unknown = records.filter(~F.coalesce("split", F.lit("")).isin(*splits)).select(
        F.lit("invalid_split").alias("violation"), F.col("id").alias("item")
    )
    unlicensed = records.filter(F.coalesce("license", F.lit("")) == "").select(
        F.lit("license_missing").alias("violation"), F.col("id").alias("item")
    )
    declared = spark.createDataFrame([(s,) for s in splits], "split string")
    unseen = declared.join(records.select("split").distinct(), "split", "left_anti").select(
        F.lit("split_without_records").alias("violation"), F.col("split").alias("item")
    )
    return empty.unionByName(repeated).unionByName(unknown).unionByName(unlicensed).unionByName(unseen)
