"""The driver contract, and a sample of queries against their check SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canonical

SAMPLE = (
    "chunk_qa", "chunk_metadata", "cells_to_table", "parse_markdown", "reading_order", "index_upsert", "postings", "bm25_topk", "bm25_phrase",
    "vector_topk_scoped", "fallback_retrieve", "parent_budget", "trace_stages", "query_variants", "redact_log", "filter_tree", "scoped_sql_cte",
    "summaries", "raptor_tree", "graph_communities", "similar_windows", "latency_p95", "illegal_transitions", "reconcile", "budget_breach", "ablation",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "final_rank", "chunk_id", "document_id", "relevance"] and df.count() > 0


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 140


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, sf, name):
    got = canonical(entry.queries()[name](spark, sf).toPandas())
    assert got[:2] == canonical(duck.execute(entry.oracle_sql()[name]).df())[:2]
    assert got[1]


def test_partitioning_does_not_matter(spark, sf):
    results = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.add(canonical(entry.queries()["rrf"](spark, sf).toPandas())[2])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(results) == 1
