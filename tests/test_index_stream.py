"""From messages to a published index: replayed batches, later versions, rejections, health-checked switches."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import index, search
from lorebase.session import shared_dir
from lorebase.sources import derived, sinks
from lorebase.sources.tables import table
from lorebase.streaming import indexing

DIMS = 16


def to_chunks(batch):
    return derived.chunk_rows(derived.document_rows(batch))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents").withColumn("document_id", F.concat(F.lit("d"), "doc_id"))


def segment(batch, number, root, tenant=None):
    tenant = F.col("tenant_id") if tenant is None else tenant
    indexing.write_segment(batch, number, to_chunks, root=root, dims=DIMS, tenant=tenant)


def top(spark, sf, tables):
    stats = index.corpus_statistics(tables["records"]).first()
    scored = search.bm25(
        search.query_terms(derived.queries(spark, sf)), tables["postings"], index.document_frequencies(tables["postings"]),
        F.lit(stats.n_chunks), F.lit(stats.avg_length))
    return sorted(map(tuple, search.top_k(scored, 5).select("query_id", "chunk_id", "score", "rank").collect()))


def test_replayed_batches_and_increments_equal_the_batch_index(spark, sf, documents):
    root = shared_dir(spark, "index-test")
    old = documents.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")))
    segment(old, 0, root)
    segment(old.filter("doc_id % 2 = 0"), 1, root)  # the same documents again
    assert indexing.compact(spark, root) == 1
    segment(old, 0, root)  # a replayed batch leaves the same files
    segment(documents.filter("doc_id % 3 = 0"), 2, root)
    segment(documents.filter("doc_id % 4 = 1"), 3, root)  # shorter texts replace longer ones of the same version
    assert indexing.compact(spark, root, expected_current=1) == 2
    got = indexing.read(spark, root)
    records = index.embed(to_chunks(documents), dims=DIMS)
    wanted = {"records": records, "postings": index.postings(records, ("document_version_id", *search.SCOPE))}
    for name in indexing.TABLES:
        assert got[name].count() == wanted[name].count() > 0
    assert sorted(got["records"].select("chunk_id", "content").collect()) == sorted(wanted["records"].select("chunk_id", "content").collect())
    assert top(spark, sf, got) == top(spark, sf, wanted)
    assert {r.stage for r in indexing.stages(spark, root).collect()} <= {"indexed", "empty"} and indexing.stages(spark, root).count() == documents.count()


def test_rejected_rows_are_stages_not_records(spark, documents):
    root = shared_dir(spark, "index-test")
    empty = documents.limit(1).withColumns({"doc_id": F.lit(100_000).cast("long"), "document_id": F.lit("d100000"), "text": F.lit("")})
    segment(documents.limit(60).unionByName(empty), 0, root, tenant=F.when(F.col("doc_id") % 2 == 0, F.col("tenant_id")).otherwise("other"))
    found = {r.document_id: (r.stage, r.error_code, r.chunks) for r in indexing.stages(spark, root).collect()}
    for document, (stage, code, chunks) in found.items():
        odd = int(document[1:]) % 2 == 1
        assert (stage, code, chunks > 0) == (("failed", "index_scope_mismatch", False) if odd else ("empty", "", False) if document == "d100000" else ("indexed", "", True))
    indexing.compact(spark, root)
    assert indexing.read(spark, root)["records"].filter("doc_id % 2 = 1").isEmpty()


def test_unhealthy_generation_is_not_switched_to(spark, documents):
    root = shared_dir(spark, "index-test")
    segment(documents.limit(40), 0, root)
    indexing.compact(spark, root)
    before = indexing.read(spark, root)
    expected = indexing.counts(before["records"])
    assert indexing.healthy(before, expected)
    strange = {"records": lambda _: before["records"].limit(1), "postings": lambda _: before["postings"]}
    with pytest.raises(ValueError, match="validation"):
        sinks.publish_tables(strange, spark, root, indexing.INDEX, validate=lambda t: indexing.healthy(t, expected))
    with pytest.raises(ValueError, match="conflict"):
        indexing.compact(spark, root, expected_current=7)
    with pytest.raises(ValueError, match="unhealthy"):
        sinks.rollback(spark, root, indexing.INDEX, 1, validate=lambda place: False)
    with pytest.raises(ValueError, match="missing"):
        sinks.rollback(spark, root, indexing.INDEX, 9)
    assert sinks.current(spark, root, indexing.INDEX)["generation"] == 1 and indexing.read(spark, root)["records"].count() == before["records"].count()


def test_merge_rejects_rows_itself(spark):
    root = shared_dir(spark, "merge-test")
    schema = "tenant_id string, chunk_id string, embedding array<double>, write_no int"
    sinks.publish(spark.createDataFrame([("t", "a", [1.0, 0.0], 1), ("t", "b", [1.0, 0.0], 1)], schema), root, "chunks")
    incoming = spark.createDataFrame([("t", "a", [0.0, 1.0], 2), ("x", "b", [0.0, 1.0], 2), ("t", "c", [1.0], 2), ("t", "d", None, 2), (None, "e", [1.0, 1.0], 2)], schema)
    sinks.upsert_table(incoming, root, "chunks", ["chunk_id"], "write_no", error=index.scope_error("t", 2))
    assert sorted((r.chunk_id, r.write_no) for r in sinks.read_current(spark, root, "chunks").collect()) == [("a", 2), ("b", 1)]
    rejected = sinks.read_current(spark, root, "chunks-rejected").collect()
    assert sorted((r.chunk_id, r.error_code) for r in rejected) == [
        ("b", "index_scope_mismatch"), ("c", "index_dimension_mismatch"), ("d", "index_dimension_mismatch"), ("e", "index_scope_mismatch")]
