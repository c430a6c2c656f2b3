"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``u``, ``v``); the component is its smallest node.

    Every step writes its links to the shared folder. A large star hangs all larger neighbours of a node
    on its smallest one, a small star all smaller ones; the links end as stars around the smallest
    nodes after a logarithmic number of steps. Nulls and loops are ignored.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    current = stage(links.filter("u <> v").select(high, low).distinct(), "links")
    before = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
