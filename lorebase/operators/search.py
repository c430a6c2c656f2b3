"""Lexical search over posting tables, for whole tables of queries at once.

A query row has ``query_id, tenant_id, actor_id, roles, knowledge_base_ids, text`` and optionally
``languages`` (an inferred filter; null means none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.predicates import access_allowed, searchable
from lorebase.functions.text import words

# fixed values: the public defaults of the ranking function and the phrase weight
K1, B, PHRASE_BOOST = 1.2, 0.75, 2.0
# query-term rows (a few hundred bytes each) that may be broadcast
BROADCAST_TERMS = 100_000

SCOPE = (
    "tenant_id", "knowledge_base_id", "owner_id", "visibility", "allowed_actor_ids", "allowed_roles",
    "active", "document_enabled", "document_deleted", "language",
)


def top_k(scored: DataFrame, k: int | Column, *, keys: tuple[str, ...] = ("query_id",), tie: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per key with ``rank``. Plans as a partial top-k before the shuffle, so a
    query that matches a third of all chunks ships only ``k`` rows per task."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """One row per query and distinct term; a repeated term weighs as often as it occurs."""
    kept = [c for c in queries.columns if c != text]
    terms = queries.withColumn("terms", words(F.col(text)))
    weight = F.size("terms") - F.size(F.array_remove("terms", F.col("term")))
    return (
        terms.select("*", F.explode(F.array_distinct("terms")).alias("term"))
        .select(*kept, "term", weight.alias("weight"), F.size(F.array_distinct("terms")).alias("n_terms"))
    )


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def allowed(query: str, record: str) -> Column:
    """Hard scope, access and inferred filter between a query and a record (both aliased)."""
    q, r = (lambda c: F.col(f"{query}.{c}")), (lambda c: F.col(f"{record}.{c}"))
    return (
        F.array_contains(q("knowledge_base_ids"), r("knowledge_base_id"))
        & access_allowed(record, q("actor_id"), q("roles"))
    )


def bm25(
    terms: DataFrame,
    postings: DataFrame,
    frequencies: DataFrame,
    n_chunks: Column,
    average_length: Column,
    *,
    broadcast_terms: int = BROADCAST_TERMS,
    salts: int = 8,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Score every permitted (query, chunk) pair that shares a term (OR semantics).

    Statistics cover all records; scope, access and liveness are applied below the aggregation.

    When the query terms are at most ``broadcast_terms`` rows (checked), the postings are probed
    where they lie. On postings bucketed by chunk the scores then add up inside each bucket, so
    neither the postings nor the pairs are shuffled, and buckets are even whatever term or tenant
    is hot. A larger query table is joined by shuffle, with posting lists spread over ``salts``.
    With ``blocks`` (``query_id, block``) only postings of these blocks are scored; both sides then meet by block.
    """
    q = terms.join(frequencies, "term").withColumn("idf", idf(n_chunks, F.col("df")))
    p = postings.filter(searchable())
    keys = [F.col("q.query_id"), F.col("p.chunk_id"), F.col("p.document_id")]
    if "block" in postings.columns:
        keys.insert(1, F.col("p.block"))  # a chunk lies in one block; on postings bucketed by block this saves the shuffle
    on = (F.col("q.tenant_id") == F.col("p.tenant_id")) & (F.col("q.term") == F.col("p.term")) & allowed("q", "p")
    if blocks is not None:
        p = p.join(blocks.withColumnRenamed("query_id", "asked_by"), "block")
        matched = p.alias("p").join(q.alias("q"), on & (F.col("p.asked_by") == F.col("q.query_id")))
    elif terms.limit(broadcast_terms + 1).count() <= broadcast_terms:
        matched = p.alias("p").join(F.broadcast(q.alias("q")), on)
    else:
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
        matched = q.alias("q").join(p.alias("p"), on & (F.col("q.salt") == F.col("p.salt")))
    part = F.col("q.weight") * F.col("q.idf") * saturation(F.col("p.tf"), F.col("p.length"), average_length)
    in_filter = F.col("q.languages").isNull() | F.array_contains("q.languages", F.col("p.language"))
    # only fixed-width aggregates, so this stays a hash aggregation with map-side combine
    return (
        matched.groupBy(*keys)
        .agg(
            F.round(F.sum(part), 6).alias("score"),
            F.max(F.coalesce(in_filter, F.lit(False))).alias("in_filter"),
            F.count(F.lit(1)).alias("terms_hit"),
            F.max("q.n_terms").alias("n_terms"),
            F.sum("q.idf").alias("idf_sum"),
        )
    )


def phrase_boost(scored: DataFrame, queries: DataFrame, chunks: DataFrame, average_length: Column) -> DataFrame:
    """Add twice the phrase score where the whole query occurs as a phrase.

    Only pairs that hit every query term can hold the phrase, so only those fetch their content.
    """
    q = queries.select("query_id", words(F.col("text")).alias("phrase"))
    c = chunks.select("chunk_id", words(F.col("content")).alias("tokens"))
    n = F.size("phrase")
    count = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1))),
            lambda i: F.slice("tokens", i, n) == F.col("phrase"),
        )
    )
    boosts = (
        scored.filter("terms_hit = n_terms").select("query_id", "chunk_id", "idf_sum")
        .join(q, "query_id").join(c, "chunk_id")
        .withColumn("tf", count).filter("tf > 0")
        .select("query_id", "chunk_id",
                (PHRASE_BOOST * F.col("idf_sum") * saturation(F.col("tf"), F.size("tokens"), average_length)).alias("boost"))
    )
    return scored.join(boosts, ["query_id", "chunk_id"], "left").withColumn(
        "score", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)
    )


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """Best score per chunk over all variants of a query (the first variant wins ties), top ``k``."""
    best = hits.groupBy("query_id", "chunk_id", "document_id").agg(
        F.max(F.struct(F.col("score"), (-F.col("variant_no")).alias("earlier"))).alias("best")
    )
    return top_k(
        best.select("query_id", "chunk_id", "document_id", F.col("best.score").alias("score"),
                    (-F.col("best.earlier")).alias("variant_no")),
        k,
    )
