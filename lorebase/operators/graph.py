"""Entity graph in long form: one row per (entity, source), (edge, source), (vertex, member).

An entity named in a third of all chunks is a third of the rows of a table, never an array in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import ENTITY_TOKEN, fold, let, matches

# fixed values: limits of one build
ENTITIES_PER_CHUNK = 32
MAX_CHUNKS, MAX_ENTITIES, MAX_EDGES = 5_000, 20_000, 50_000
SCOPE = ["tenant_id", "knowledge_base_id"]


def chunk_entities(content: Column) -> Column:
    return F.slice(F.array_distinct(matches(content, ENTITY_TOKEN)), 1, ENTITIES_PER_CHUNK)


def entity_sources(chunks: DataFrame) -> DataFrame:
    """Every (entity, chunk) mention; distinct per chunk by construction, so no shuffle."""
    return chunks.select(*SCOPE, "chunk_id", F.explode(chunk_entities(F.col("content"))).alias("name"))


def entities(chunks: DataFrame) -> DataFrame:
    return entity_sources(chunks).groupBy(*SCOPE, "name").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("chunk_id").alias("first_source"))


def edge_sources(chunks: DataFrame) -> DataFrame:
    """Undirected edges between neighbours of the entity list, with the chunk that shows them."""

    def pairs(names: Column) -> Column:
        left = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
        right = F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
        return F.array_distinct(
            F.zip_with(left, right, lambda a, b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"))))

    return chunks.select(*SCOPE, "chunk_id", F.explode(let(chunk_entities(F.col("content")), pairs)).alias("e")).select(
        *SCOPE, "chunk_id", "e.source", "e.target")


def edges(chunks: DataFrame) -> DataFrame:
    return edge_sources(chunks).groupBy(*SCOPE, "source", "target").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("chunk_id").alias("first_source"))


def communities(edge_table: DataFrame) -> DataFrame:
    """Members of the ego community of every vertex: itself and its neighbours."""
    e = edge_table.select(*SCOPE, "source", "target")
    out = e.select(*SCOPE, F.col("source").alias("vertex"), F.explode(F.array("source", "target")).alias("member"))
    back = e.select(*SCOPE, F.col("target").alias("vertex"), F.explode(F.array("source", "target")).alias("member"))
    return out.unionByName(back).distinct()


def budget_status(
    chunks: DataFrame, *, max_chunks: int = MAX_CHUNKS, max_entities: int = MAX_ENTITIES, max_edges: int = MAX_EDGES
) -> DataFrame:
    """Build status per knowledge base against the budgets; counts come from partial aggregates."""
    n_chunks = chunks.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_chunks"))
    n_entities = entities(chunks).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_entities"))
    n_edges = edges(chunks).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(F.col("n_chunks") > max_chunks, "source_budget_exceeded")
        .when((zero("n_entities") > max_entities) | (zero("n_edges") > max_edges), "graph_budget_exceeded")
        .otherwise("succeeded")
    )
    return n_chunks.join(n_entities, SCOPE, "left").join(n_edges, SCOPE, "left").select(
        *SCOPE, "n_chunks", zero("n_entities").alias("n_entities"), zero("n_edges").alias("n_edges"), status.alias("status"))


def query_entities(questions: DataFrame, entity_table: DataFrame) -> DataFrame:
    """Entities of the tenant named in a question, ignoring case. The question side carries the key
    set; the entity table is one row per name, so a hot name is still a single row per scope."""
    named = questions.select(
        "query_id", "tenant_id", F.explode(F.array_distinct(F.transform(matches(F.col("text"), ENTITY_TOKEN), fold))).alias("folded"))
    return named.join(entity_table.withColumn("folded", fold(F.col("name"))), ["tenant_id", "folded"]).select(
        "query_id", "tenant_id", "knowledge_base_id", "name", "n_sources")
