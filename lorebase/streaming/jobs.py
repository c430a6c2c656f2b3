"""Structured Streaming forms of ingestion, status replay and error-rate monitoring.

All jobs use ``availableNow`` triggers by default, so the same code serves as an incremental batch
run. Checkpoints and outputs live in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import index, lifecycle, temporal
from lorebase.operators.lifecycle import VERSION_EDGES
from lorebase.session import shared_dir
from lorebase.sources.staging import materialized


def file_stream(spark: SparkSession, directory: str, pattern: str, schema, **options) -> DataFrame:
    """Files of a folder as a stream; ``maxFilesPerTrigger`` bounds a micro-batch.

    A match may be a file or a table's folder of part files. A plain name is written as a pattern too, since Spark takes a path without
    one for the folder to list.
    """
    if not any(c in pattern for c in "*?[{"):
        pattern = f"{pattern[:-1]}[{pattern[-1]}]"
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(f"{directory.rstrip('/')}/{pattern}")


def _finish(writer, location: str) -> None:
    query = writer.option("checkpointLocation", location).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(
    messages: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    *,
    message_id: str,
    event_time: str,
    delay: str,
    keys: list[str],
    out: str,
    checkpoint: str,
) -> DataFrame:
    """At-least-once messages to an upserted table.

    Duplicates within the watermark are dropped by message id. Each micro-batch overwrites its own
    folder, so a replayed batch leaves the same files; readers take the latest row per key.
    """
    unique = messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([message_id])

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _finish(unique.writeStream.foreachBatch(write).outputMode("append"), checkpoint)
    rows = messages.sparkSession.read.parquet(out)
    return index.latest(rows, keys, [F.col("batch_id")]).drop("batch_id")


def error_rates(requests: DataFrame, *, event_time: str, delay: str, out: str, checkpoint: str) -> DataFrame:
    """Closed five-minute windows; rows later than the watermark delay are dropped."""
    rates = temporal.error_rates(requests.withWatermark(event_time, delay), at=event_time)
    _finish(rates.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return requests.sparkSession.read.parquet(out)


def replay_status(log: DataFrame, *, out: str, checkpoint: str, edges=VERSION_EDGES, initial: str = "registered") -> DataFrame:
    """Status machine over a stream ``(entity_id, seq, status)``.

    A micro-batch is replayed in pieces, as a batch is, from the states that earlier batches left; an entry older than what its
    entity has applied is rejected as a regression (late data never overwrites newer state). A batch writes its outcomes and the
    states of the entities it touched to folders of its own number, so a replayed batch leaves the same files.
    """
    spark = log.sparkSession
    fields = dict(log.dtypes)
    kept = f"entity_id {fields['entity_id']}, state string, last {fields['seq']}, batch_id long"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = materialized(batch.select("entity_id", "seq", "status"), "status-batch")
        earlier = spark.createDataFrame([], kept)
        if batch_id:
            earlier = spark.read.schema(kept).parquet(f"{out}/states").filter(F.col("batch_id") < batch_id)
        touched = earlier.join(batch.select("entity_id").distinct(), "entity_id", "left_semi")
        states = materialized(index.latest(touched, ["entity_id"], [F.col("batch_id")]).drop("batch_id"), "status-states")
        marked = batch.join(states, "entity_id", "left").withColumn("late", F.coalesce(F.col("seq") < F.col("last"), F.lit(False)))
        fresh = marked.filter("NOT late").select("entity_id", "seq", "status")
        done = lifecycle.replay(fresh, edges=edges, initial=initial, states=states.select("entity_id", "state"))
        late = marked.filter("late").select(
            "entity_id", "seq", F.col("state").alias("from_status"), F.col("status").alias("to_status"), F.lit("document_version_timestamp_regression").alias("outcome"))
        done.unionByName(late).write.mode("overwrite").parquet(f"{out}/outcomes/batch_id={batch_id}")
        written = spark.read.parquet(f"{out}/outcomes/batch_id={batch_id}").filter("outcome <> 'document_version_timestamp_regression'")
        reached = F.when(F.col("outcome") == "applied", F.col("to_status")).otherwise(F.col("from_status"))
        written.groupBy("entity_id").agg(F.max_by(reached, "seq").alias("state"), F.max("seq").alias("last")).write.mode("overwrite").parquet(
            f"{out}/states/batch_id={batch_id}")

    _finish(log.writeStream.foreachBatch(write).outputMode("append"), checkpoint)
    return spark.read.parquet(f"{out}/outcomes").drop("batch_id")


def locations(spark: SparkSession, name: str) -> dict[str, str]:
    return {"out": shared_dir(spark, name), "checkpoint": shared_dir(spark, f"{name}-checkpoint")}
