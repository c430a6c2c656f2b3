"""From document messages to a published index: delta segments by micro-batch, compaction into generations.

A micro-batch writes the records of its documents (chunks with vectors) once, to a folder of its own number, so a replayed batch
leaves the same files. Compaction merges segments with the current generation and publishes records and the postings built from
them together, after a health check; a failure leaves the current generation as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import index
from lorebase.operators.search import SCOPE
from lorebase.sources import sinks
from lorebase.sources.staging import broadcast_within, materialized
from lorebase.streaming.jobs import _finish

INDEX, TABLES = "index", ("records", "postings")
CARRIED = ("document_version_id", *SCOPE)


def write_segment(batch: DataFrame, batch_id: int, to_chunks: Callable[[DataFrame], DataFrame], *, root: str, dims: int, tenant: Column | str) -> None:
    """One micro-batch as a segment: ``records`` and ``stages`` under ``batch_id=<n>``; overwrites itself.

    ``stages`` has a row per document version: ``indexed`` with its number of chunks, ``empty`` without any, or ``failed`` with the code
    for which the index rejects its rows. Rejected rows stay in their segment with ``error_code`` and reach no generation.
    """
    spark = batch.sparkSession
    place = lambda table: f"{root}/segments/{table}/batch_id={batch_id}"
    judged = index.embed(to_chunks(batch), dims=dims).withColumn("error_code", index.scope_error(tenant, dims))
    judged.write.mode("overwrite").option("compression", sinks.COMPRESSION).parquet(place("records"))
    judged = spark.read.parquet(place("records"))
    made = judged.groupBy("document_id").agg(F.count_if(F.col("error_code").isNull()).alias("chunks"), F.max("error_code").alias("error_code"))
    code = F.coalesce("error_code", F.lit(""))
    batch.select("document_id").distinct().join(made, "document_id", "left").select(
        "document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), code.alias("error_code"),
        F.when(code != "", "failed").when(F.coalesce("chunks", F.lit(0)) == 0, "empty").otherwise("indexed").alias("stage"),
    ).write.mode("overwrite").parquet(place("stages"))


def ingest(
    messages: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], *, message_id: str, event_time: str, delay: str,
    root: str, checkpoint: str, dims: int = 64, tenant: Column | str | None = None,
) -> None:
    """At-least-once messages to segments; duplicates within the watermark are dropped by message id.

    Messages carry ``document_id``; ``tenant`` names the tenant that a row must have (by default its own, so only vectors are checked).
    """
    unique = messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([message_id])
    expected = F.col("tenant_id") if tenant is None else tenant

    def write(batch: DataFrame, batch_id: int) -> None:
        write_segment(batch, batch_id, to_chunks, root=root, dims=dims, tenant=expected)

    _finish(unique.writeStream.foreachBatch(write).outputMode("append"), checkpoint)


def stages(spark: SparkSession, root: str) -> DataFrame:
    """The latest stage of every document."""
    rows = spark.read.parquet(f"{root}/segments/stages")
    return index.latest(rows, ["document_id"], [F.col("batch_id")]).drop("batch_id")


def counts(records: DataFrame) -> DataFrame:
    """Records per scope, as a health check expects them."""
    return records.groupBy("index_version_id", "tenant_id", "knowledge_base_id").agg(F.count(F.lit(1)).alias("expected_count"))


def whole(records: DataFrame, expected: DataFrame) -> bool:
    """Whether every scope has its count of whole records."""
    return index.generation_health(records, expected, 1).filter("NOT healthy").isEmpty()


def healthy(tables: dict[str, DataFrame], expected: DataFrame) -> bool:
    """Whether every scope has its count of whole records and no chunk but theirs has postings."""
    records, postings = tables["records"], tables["postings"]
    strange = postings.select("chunk_id").distinct().join(records, "chunk_id", "left_anti")  # a row per chunk leaves a task
    return whole(records, expected) and strange.isEmpty()


def compact(spark: SparkSession, root: str, *, expected_current: int | None = None) -> int:
    """Merge all segments into the current generation and publish the result; returns the generation.

    A document version in a segment replaces that of the generation, the latest segment wins. Postings are built only for what the
    segments bring, from the records as published; those of the rest are carried over.
    """
    segments = spark.read.parquet(f"{root}/segments/records")
    fresh = index.newest_segments(segments.filter("error_code IS NULL").drop("error_code")).drop("batch_id")
    held = sinks.read_tables(spark, root, INDEX, TABLES)
    if held is None:
        merged = fresh
        posted = lambda done: index.postings(done["records"], CARRIED)
    else:
        replaced = broadcast_within(materialized(fresh.select("document_version_id").distinct(), "replaced-versions"))
        kept = {t: held[t].join(replaced, "document_version_id", "left_anti") for t in TABLES}
        merged = kept["records"].select(*fresh.columns).unionByName(fresh)
        posted = lambda done: kept["postings"].unionByName(
            index.postings(done["records"].join(replaced, "document_version_id", "left_semi"), CARRIED))
    expected = counts(merged)
    return sinks.publish_tables(
        {"records": lambda _: merged, "postings": posted}, spark, root, INDEX,
        first=lambda records: whole(records, expected), validate=lambda staged: healthy(staged, expected), expected_current=expected_current,
    )


def read(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    return sinks.read_tables(spark, root, INDEX, TABLES)
