"""Writers: versioned table folders with a pointer, partition-pruned traces, small reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.index import upsert

COMPRESSION = "zstd"  # of index tables: texts and heading paths repeat over more than the default codec sees
POINTER_SCHEMA = "table_name string, generation int, location string, rows long"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def pointers(spark: SparkSession, root: str) -> DataFrame:
    system, path = _hadoop(spark, f"{root.rstrip('/')}/_pointers")
    if not system.exists(path):
        return spark.createDataFrame([], POINTER_SCHEMA)
    return spark.read.schema(POINTER_SCHEMA).json(path.toString())


def current(spark: SparkSession, root: str, name: str):
    """The latest pointer row of a table (one aggregated row), or None."""
    rows = (
        pointers(spark, root).filter(F.col("table_name") == name)
        .agg(F.max(F.struct("generation", "location", "rows")).alias("p")).collect()
    )
    return rows[0]["p"]


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    pointer = current(spark, root, name)
    return None if pointer is None else spark.read.parquet(pointer["location"])


def _switch(spark: SparkSession, root: str, name: str, generation: int, location: str, count: int) -> None:
    """Create the pointer file of one generation; of two writers the file system lets only one create it."""
    system, path = _hadoop(spark, f"{root.rstrip('/')}/_pointers/{name}-{generation:06d}.json")
    try:
        stream = system.create(path, False)
    except Exception as error:
        raise ValueError("index_alias_conflict") from error
    line = json.dumps({"table_name": name, "generation": generation, "location": location, "rows": count})
    stream.write(bytearray(line.encode() + b"\n"))
    stream.close()


def _publish(
    spark: SparkSession, root: str, name: str, write: Callable[[str], None], check: Callable[[str], int], expected_current: int | None
) -> int:
    """Stage a generation in a folder of its own (``write``), check it and count its rows (``check``), then switch."""
    before = current(spark, root, name)
    seen = None if before is None else before["generation"]
    if expected_current is not None and seen != expected_current:
        raise ValueError("index_alias_conflict")
    generation = 1 if seen is None else seen + 1
    location = f"{root.rstrip('/')}/{name}/g{generation:06d}-{os.urandom(6).hex()}"
    try:
        write(location)
        _switch(spark, root, name, generation, location, check(location))
    except Exception:
        system, path = _hadoop(spark, location)
        system.delete(path, True)
        raise
    return generation


def publish(
    df: DataFrame,
    root: str,
    name: str,
    *,
    partition_by: tuple[str, ...] = (),
    expected_current: int | None = None,
    validate: Callable | None = None,
) -> int:
    """Stage a new generation in a folder of its own, validate it, then switch (compare-and-switch).

    The switch succeeds only while the generation seen at the start is still the current one. A failed
    validation or a lost switch drops the staged folder and leaves the current generation untouched;
    older generations stay readable until they are dropped.
    """
    spark = df.sparkSession

    def check(location: str) -> int:
        staged = spark.read.parquet(location)
        if validate is not None and not validate(staged):
            raise ValueError(f"staged generation of {name} failed validation")
        return staged.count()

    write = lambda location: (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(location)
    return _publish(spark, root, name, write, check, expected_current)


def publish_tables(
    tables: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], spark: SparkSession, root: str, name: str, *,
    validate: Callable[[dict[str, DataFrame]], bool] | None = None, first: Callable[[DataFrame], bool] | None = None,
    expected_current: int | None = None,
) -> int:
    """Publish several tables as one generation, so that readers switch to all of them at once.

    Each table is built from those staged before it (postings from the records as written); the first one gives the row count.
    ``first`` judges the first table before the others are built, ``validate`` all of them.
    """

    def judge(passed: bool) -> None:
        if not passed:
            raise ValueError(f"staged generation of {name} failed validation")

    def write(location: str) -> None:
        for table, build in tables.items():
            done = {t: spark.read.parquet(f"{location}/{t}") for t in list(tables)[: list(tables).index(table)]}
            build(done).write.option("compression", COMPRESSION).parquet(f"{location}/{table}")
            if first is not None and not done:
                judge(first(spark.read.parquet(f"{location}/{table}")))

    def check(location: str) -> int:
        staged = _tables(spark, location, tables)
        judge(validate is None or validate(staged))
        return next(iter(staged.values())).count()

    return _publish(spark, root, name, write, check, expected_current)


def _tables(spark: SparkSession, location: str, names) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{location}/{t}") for t in names}


def read_tables(spark: SparkSession, root: str, name: str, tables: tuple[str, ...]) -> dict[str, DataFrame] | None:
    """The tables of the current generation, all of the same one."""
    pointer = current(spark, root, name)
    return None if pointer is None else _tables(spark, pointer["location"], tables)


def rollback(spark: SparkSession, root: str, name: str, generation: int, *, validate: Callable[[str], bool] | None = None) -> int:
    """Make an earlier generation current again, as a new switch to its folder; ``validate`` may refuse the folder."""
    chosen = pointers(spark, root).filter((F.col("table_name") == name) & (F.col("generation") == generation)).first()
    if chosen is None:
        raise ValueError("index_generation_missing")
    if validate is not None and not validate(chosen["location"]):
        raise ValueError("index_generation_unhealthy")
    following = current(spark, root, name)["generation"] + 1
    _switch(spark, root, name, following, chosen["location"], chosen["rows"])
    return following


def upsert_table(
    incoming: DataFrame, root: str, name: str, keys: list[str], order: str, partition_by: tuple[str, ...] = (), *, error: Column | None = None
) -> int:
    """Merge rows into the current generation and publish the result as the next one.

    Rows for which ``error`` is not null are rejected: they leave the table as it is and go to ``<name>-rejected``.
    """
    if error is not None:
        judged = incoming.withColumn("error_code", error)
        publish(judged.filter("error_code IS NOT NULL"), root, f"{name}-rejected")
        incoming = judged.filter("error_code IS NULL").drop("error_code")
    existing = read_current(incoming.sparkSession, root, name)
    merged = incoming if existing is None else existing.select(*incoming.columns)
    return publish(upsert(merged, incoming, keys, order), root, name, partition_by=partition_by)


def append_traces(traces: DataFrame, path: str) -> None:
    """Content-free trace rows partitioned by tenant and expiry date, so expiry prunes folders."""
    traces.withColumn("expiry_date", F.to_date("expires_at")).write.mode("append").partitionBy(
        "tenant_id", "expiry_date"
    ).parquet(path)


def live_traces(traces: DataFrame, now: Column) -> DataFrame:
    return traces.filter(F.col("expires_at") > now)


def visible_traces(traces: DataFrame, tenant: str, role: str, privileged: tuple[str, ...]) -> DataFrame:
    """Traces of one tenant; candidate detail only for privileged roles."""
    scoped = traces.filter(F.col("tenant_id") == tenant)
    return scoped if role in privileged else scoped.drop("candidates")


def write_report(metrics: DataFrame, path: str) -> None:
    """A handful of metric rows as one JSON file with sorted keys."""
    metrics.select(*sorted(metrics.columns)).coalesce(1).write.mode("overwrite").json(path)
