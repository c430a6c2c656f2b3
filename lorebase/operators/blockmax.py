"""Lexical top-k that skips blocks of postings by their largest impact.

Successive chunks of one document version form a block, and a block has one scope. For every block and term the index keeps the
largest impact of a posting. Summed over the terms of a query these bound the score of every chunk in the block. A search
scores the blocks with the best bounds first; the k-th score found there is the query's threshold, and of all other blocks
only those whose bound reaches it are scored. The result is that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.predicates import searchable
from lorebase.operators.search import allowed, bm25, idf, saturation, top_k
from lorebase.sources.staging import broadcast_within, materialized

BLOCK_CHUNKS = 16
ROUNDING = 1e-6  # scores are rounded to six digits


def block_of(version: Column, sequence: Column) -> Column:
    """The block of a chunk: up to ``BLOCK_CHUNKS`` successive chunks of a document version."""
    return F.xxhash64(version, F.floor(sequence / BLOCK_CHUNKS))


def block_maxima(postings: DataFrame, scope: tuple[str, ...], average_length: Column) -> DataFrame:
    """``block, term, scope.., top``: the largest impact of a block's postings of a term, without the term's weight.

    On postings bucketed by block this needs no shuffle.
    """
    impact = saturation(F.col("tf"), F.col("length"), average_length)
    return postings.groupBy("block", "term").agg(F.max(impact).alias("top"), *(F.first(c).alias(c) for c in scope))


def bounds(terms: DataFrame, maxima: DataFrame, frequencies: DataFrame, n_chunks: Column) -> DataFrame:
    """``query_id, block, bound`` of every permitted block that shares a term with the query."""
    weighted = materialized(terms.join(frequencies, "term").withColumn("idf", idf(n_chunks, F.col("df"))), "query-terms")
    on = (F.col("q.tenant_id") == F.col("m.tenant_id")) & (F.col("q.term") == F.col("m.term")) & allowed("q", "m")
    met = maxima.filter(searchable()).alias("m").join(broadcast_within(weighted).alias("q"), on)
    return met.groupBy(F.col("q.query_id"), F.col("m.block")).agg(F.sum(F.col("q.weight") * F.col("q.idf") * F.col("m.top")).alias("bound"))


def search(
    terms: DataFrame, postings: DataFrame, maxima: DataFrame, frequencies: DataFrame, n_chunks: Column, average_length: Column, k: int
) -> DataFrame:
    """Best ``k`` chunks per query: ``query_id, chunk_id, document_id, score, rank``.

    Each of the ``k`` blocks with the best bounds holds a chunk that shares a term, so these blocks give ``k`` scores wherever there
    are so many. Queries with fewer have no threshold, and all their blocks are among these. Equal scores rank by chunk id.
    """
    return _searched(terms, postings, maxima, frequencies, n_chunks, average_length, k)[0]


def _searched(terms, postings, maxima, frequencies, n_chunks, average_length, k) -> tuple[DataFrame, DataFrame]:
    every = bounds(terms, maxima, frequencies, n_chunks)
    first = materialized(top_k(every.withColumnRenamed("bound", "score"), k, tie="block").select("query_id", "block"), "first-blocks")

    def scored(chosen: DataFrame) -> DataFrame:
        return bm25(terms, postings, frequencies, n_chunks, average_length, blocks=chosen)

    seen = materialized(top_k(scored(first), k), "first-scores")
    threshold = seen.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = every.join(broadcast_within(materialized(threshold, "thresholds")), "query_id").filter(F.col("bound") + ROUNDING >= F.col("least"))
    rest = materialized(rest.join(broadcast_within(first), ["query_id", "block"], "left_anti").select("query_id", "block"), "other-blocks")
    found = seen.drop("rank").unionByName(top_k(scored(rest), k).drop("rank"))
    return top_k(found, k).select("query_id", "chunk_id", "document_id", "score", "rank"), first.unionByName(rest)


def skipped_share(terms: DataFrame, postings: DataFrame, maxima: DataFrame, frequencies: DataFrame, n_chunks: Column, average_length: Column, k: int) -> float:
    """Share of the permitted blocks with a term of the query that a search does not open."""
    opened = _searched(terms, postings, maxima, frequencies, n_chunks, average_length, k)[1].count()
    return 1 - opened / max(1, bounds(terms, maxima, frequencies, n_chunks).count())
