"""Index tables written once per corpus and read by every retrieval plan.

An index is built when documents are ingested, not when a query runs. The tables go to the shared
folder of the cluster, so they survive lost executors and cut the lineage of what reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import shared_dir

BUCKET_BYTES = 128 * 1024 * 1024
BROADCAST_BYTES = 32 * 1024 * 1024  # of files; a few times as much in memory
MAX_BUCKETS = 50_000  # below Spark's own limit; beyond it buckets grow instead
_LOCATIONS: dict[tuple[str, str, str], str] = {}


def _complete(spark: SparkSession, location: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets of about 128 MB, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, min(-(-size // BUCKET_BYTES), MAX_BUCKETS))


def _state(spark: SparkSession, directory: str) -> str:
    """Sizes, file counts and times of the tables of a corpus; new or changed files make another state."""
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for entry in system.listStatus(root):
        summary = system.getContentSummary(entry.getPath())
        parts.append(f"{entry.getPath().getName()}:{summary.getLength()}:{summary.getFileCount()}:{entry.getModificationTime()}")
    return "|".join(sorted(parts))


def staged(
    spark: SparkSession, directory: str, name: str, build: Callable[[], DataFrame], *,
    bucket_by: str | None = None, size: Callable[[], int] | None = None,
) -> DataFrame:
    """The table ``name`` of the corpus at ``directory``; built and written on first use.

    With ``bucket_by`` the table is bucketed, so grouping by that column (and more) later needs no
    shuffle; ``size`` then estimates the table's bytes. A location is reused only within one application,
    while its success marker exists and the files of the corpus are the same.
    """
    key = (spark.sparkContext.applicationId, f"{directory}|{_state(spark, directory)}", name)
    location = _LOCATIONS.get(key)
    table_name = "lore_" + hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
    if location is None or not _complete(spark, location):
        location = shared_dir(spark, name)
        frame = build()
        if bucket_by is None:
            frame.write.mode("overwrite").parquet(location)
        else:
            buckets = _bucket_count(spark, size() if size else 0)
            (
                frame.repartition(buckets, bucket_by).write.mode("overwrite").option("path", location)
                .bucketBy(buckets, bucket_by).saveAsTable(table_name)
            )
        _LOCATIONS[key] = location
    return spark.read.parquet(location) if bucket_by is None else spark.table(table_name)


def materialized(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once so that several branches of one plan read it, not its sources again."""
    location = shared_dir(frame.sparkSession, name)
    frame.write.parquet(location)
    return frame.sparkSession.read.schema(frame.schema).parquet(location)


def broadcast_within(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table of files for broadcast where these measure at most ``limit`` bytes; beyond, the same join shuffles."""
    spark, size = frame.sparkSession, 0
    for file in frame.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size > limit:
            return frame
    return F.broadcast(frame)
