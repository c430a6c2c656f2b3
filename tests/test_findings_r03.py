"""Findings of the third round: tables in many files, top-k in bounded memory, exact neighbours."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from lorebase.functions import text as tx
from lorebase.functions.vectors import hash_embedding, hash_embedding_of
from lorebase.operators import ivf, lexical, rank, search, vector
from lorebase.plans import retrieval
from lorebase.sources.staging import materialized
from lorebase.streaming import jobs


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    data = spark.range(20).withColumnRenamed("id", "doc_id")
    data.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    data.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        out = str(tmp_path / f"out-{kind}")
        stream = jobs.file_stream(spark, str(tmp_path / kind), "documents.parquet", data.schema)
        jobs._finish(stream.writeStream.format("parquet").option("path", out), str(tmp_path / f"check-{kind}"))
        assert rows(spark.read.parquet(out), "doc_id") == [(i,) for i in range(20)]


def test_scan_equals_scoring_all_postings_and_hands_on_k_rows_a_task(spark, sf, monkeypatch):
    corpus = retrieval.Corpus(spark, sf)
    k = 5
    want = search.top_k(corpus.lexical(), k).select("query_id", "chunk_id", "document_id", "score", "rank")
    boosted = search.phrase_boost(corpus.lexical(), corpus.queries, corpus.chunks, corpus.average)
    phrased = search.top_k(boosted, k).select("query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(lexical.bm25_topk, "__kwdefaults__", lexical.bm25_topk.__kwdefaults__ | {"block_queries": 7})
    assert rows(corpus.text(k), "query_id", "rank") == rows(want, "query_id", "rank")
    assert rows(corpus.text(k, phrase=True).select(*phrased.columns), "query_id", "rank") == rows(phrased, "query_id", "rank")


def test_a_task_hands_on_k_rows_a_query_whatever_its_batches(spark, monkeypatch):
    vectors = spark.range(0, 2000, 1, 2).select(
        F.col("id").cast("string").alias("vector_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7)).alias("embedding"))
    queries = vectors.filter("CAST(vector_id AS INT) % 500 = 0").withColumnRenamed("vector_id", "query_id")
    want = rows(vector.vector_topk(queries, vectors, 3, broadcast_queries=0), "query_id", "rank")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert rows(vector.vector_topk(queries, vectors, 3), "query_id", "rank") == want
        monkeypatch.setattr(vector, "top_k", lambda found, k, tie: found)
        assert vector.vector_topk(queries, vectors, 3).count() == 4 * 3 * 2  # queries, k, tasks
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_check_finds_what_a_poor_index_missed(spark):
    rng = np.random.default_rng(3)
    data = [(f"v{i:03d}", [float(x) for x in rng.standard_normal(12)]) for i in range(400)]
    v = spark.createDataFrame(data + [(f"w{i}", data[0][1]) for i in range(9)], "vector_id string, embedding array<double>")
    q = v.filter("vector_id LIKE '%0'").withColumnRenamed("vector_id", "query_id")
    fitted = ivf.fit(v, cells=20)
    model = ivf.Quantizer(fitted.centroids, fitted.codebooks, 1)
    found = ivf.search(q, ivf.build(v, model), v, model, 5)
    packed = ivf.pack(v, model)
    want = rows(vector.vector_topk(q, v, 5), "query_id", "rank")
    assert rows(found, "query_id", "rank") != want
    assert rows(ivf.exact(q, packed, ivf.reach(packed, model), model, found, 5), "query_id", "rank") == want


def test_block_search_builds_no_postings_and_equals_scoring_all(spark, sf, monkeypatch):
    corpus = retrieval.Corpus(spark, sf)
    want = rows(search.top_k(corpus.lexical(), 10).select("query_id", "chunk_id", "document_id", "score", "rank"), "query_id", "rank")
    monkeypatch.setattr(retrieval.Corpus, "postings", property(lambda _: 1 / 0))
    assert rows(retrieval.bm25_blocks(spark, sf), "query_id", "rank") == want


def test_blocks_below_the_kth_score_are_not_summed():
    terms = lexical._Terms([["a", "b"], ["b"]], {"a": 1, "b": 3}, 10)
    slots, chunk = np.array([0, 1, 1, -1, 1]), np.array([0, 0, 1, 2, 3])
    run = lambda **kw: lexical._scores(terms, 2, slots, chunk, np.array([2.0, 1.0, 1.0, 1.0]), 1.25, False, **kw)
    every, blocks = run(), np.array([5, 5, 9, 9])
    assert (run(blocks=blocks) == every).all() and every[0, 0] > every[0, 3]
    closed = run(blocks=blocks, least=np.array([every[0, 0], -1.0]))
    assert closed[0].tolist() == [every[0, 0], -1.0, -1.0, -1.0] and (closed[1] == every[1]).all()
    open_ = lexical.opened(terms, 2, slots[slots >= 0], np.array([0, 0, 0, 1]), np.ones(4), 2, np.array([every[0, 0], -1.0]))
    assert open_.tolist() == [[True, False], [True, True]]


def test_words_of_a_chunk_are_taken_once(spark, sf):
    chunks = retrieval.Corpus(spark, sf).chunks
    same = F.col("embedding") == hash_embedding(F.col("content"), retrieval.DIMS)
    assert chunks.filter(~same | (F.col("words") != tx.words(F.col("content"))) | (F.size("words") != F.col("n_words"))).isEmpty()
    odd = spark.createDataFrame([("",), (None,), ("Straße ÉTÉ été x_1 x_1",), ("!",)], "t string")
    of_words = hash_embedding_of(tx.words(F.col("t")), 10)
    assert odd.select(of_words.alias("v")).collect() == odd.select(hash_embedding(F.col("t"), 10).alias("v")).collect()


def test_neighbours_join_only_the_versions_of_hits(spark, monkeypatch):
    written = {}
    keep = lambda frame, name: written.setdefault(name, materialized(frame, name))
    monkeypatch.setattr(rank, "materialized", keep, raising=False)
    chunks = spark.range(4000).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("v"), F.floor(F.col("id") / 40)).alias("document_version_id"),
        (F.col("id") % 40).cast("int").alias("sequence"), F.lit(3).alias("token_count"),
        F.when(F.col("id") % 40 < 20, F.concat(F.lit("p"), F.floor(F.col("id") / 4))).alias("parent_chunk_id"))
    hits = chunks.filter("chunk_id IN ('c5', 'c70')").withColumn("query_id", F.lit("q"))
    found = rows(rank.expand_neighbours(hits, chunks).select("hit_chunk_id", "sequence"), "hit_chunk_id", "sequence")
    assert found == [("c5", i) for i in (4, 5, 6, 7)] + [("c70", i) for i in range(20, 40)]
    assert written["hit-versions"].count() == 80
