"""Column-pruned table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-local text work when the scan has fewer splits than cores.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan(
    df: DataFrame,
    *,
    where: Column | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered, ordered, limited metadata scan; ``orderBy().limit()`` plans as a top-k."""
    if where is not None:
        df = df.filter(where)
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit is not None else df


def list_prefix(df: DataFrame, tenant: Column, prefix: Column) -> DataFrame:
    """Object keys under a tenant prefix. Keys of other tenants can never match."""
    root = F.concat(F.lit("tenants/"), tenant, F.lit("/"))
    return df.filter(F.col("object_key").startswith(root) & F.col("object_key").startswith(prefix))
