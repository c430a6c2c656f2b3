"""Block-wise lexical search equals the full one and skips blocks."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import blockmax, search
from lorebase.plans import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    return retrieval.Corpus(spark, "/root/testdata/sf0.01")


@pytest.mark.parametrize("k", [1, 10, 5_000])
def test_equals_full_scoring(corpus, k):
    """Also with more results wanted than some queries have."""
    full = search.top_k(corpus.lexical(), k).select("query_id", "chunk_id", "document_id", "score", "rank")
    assert sorted(full.collect()) == sorted(blockmax.search(*retrieval.block_search(corpus), k).collect())


def test_skips_most_blocks_for_few_results(corpus):
    one, ten = (blockmax.skipped_share(*retrieval.block_search(corpus), k) for k in (1, 10))
    assert one > ten > 0.4


def test_a_block_lies_in_one_version_and_bounds_its_chunks(corpus):
    per_block = corpus.chunks.groupBy("block").agg(F.count_distinct("document_version_id").alias("v"), F.count("*").alias("n"))
    assert per_block.filter((F.col("v") > 1) | (F.col("n") > blockmax.BLOCK_CHUNKS)).isEmpty()
    terms, _, maxima, frequencies, n, average = retrieval.block_search(corpus)
    bound = blockmax.bounds(terms, maxima, frequencies, n)
    scored = corpus.lexical().join(corpus.chunks.select("chunk_id", "block"), "chunk_id").join(bound, ["query_id", "block"], "left")
    assert scored.filter("bound IS NULL OR score > bound + 1e-6").isEmpty() and not scored.isEmpty()


def test_without_queries(corpus):
    terms, *rest = retrieval.block_search(corpus)
    assert blockmax.search(terms.limit(0), *rest, 10).collect() == []
