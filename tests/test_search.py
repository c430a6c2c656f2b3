"""Search and ranking: brute force, literal rankings, and plan shape."""

import pytest
import math

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from lorebase.functions.text import words
from lorebase.operators import index, rank, search, vector
from lorebase.plans import retrieval

CORPUS = [("c1", "d1", "t0", "alpha beta beta"), ("c2", "d1", "t0", "alpha gamma delta epsilon"), ("c3", "d2", "t0", "beta"), ("c4", "d3", "t1", "alpha beta"), ("c5", "d4", "t0", "alpha beta gamma")]


def corpus(spark):
    df = spark.createDataFrame(CORPUS, "chunk_id string, document_id string, tenant_id string, content string")
    return df.selectExpr(
        "*", "'k' as knowledge_base_id", "'u1' as owner_id", "if(chunk_id = 'c3', 'private', 'tenant') as visibility", "array('u7') as allowed_actor_ids",
        "cast(null as array<string>) as allowed_roles", "chunk_id <> 'c5' as active", "cast(null as boolean) as document_enabled",
        "cast(null as boolean) as document_deleted", "'en' as language")


def asked(spark, actor="u2"):
    return spark.createDataFrame([("q", "t0", actor, ["r"], ["k"], "Beta alpha beta", None)], "query_id string, tenant_id string, actor_id string, roles array<string>, knowledge_base_ids array<string>, text string, languages array<string>")


def score(spark, queries, **kw):
    chunks = corpus(spark)
    postings = index.postings(chunks, search.SCOPE)
    stats = index.corpus_statistics(chunks)
    return search.bm25(search.query_terms(queries), postings, index.document_frequencies(postings),
                       stats.select("n_chunks").scalar(), stats.select("avg_length").scalar(), **kw)


def brute(query, visible):
    docs = {c: t.split() for c, _, _, t in CORPUS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for c in visible:
        total = 0.0
        for term in query:
            tf, df = docs[c].count(term), sum(term in d for d in docs.values())
            total += math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(docs[c]) / avg))
        if total:
            out[c] = round(total, 6)
    return out


def test_bm25_brute_force_with_access(spark):
    query = ["beta", "alpha", "beta"]
    for kw in ({}, {"broadcast_terms": 0, "salts": 3}):
        got = dict(rows(score(spark, asked(spark), **kw).select("chunk_id", "score")))
        assert got == brute(query, ["c1", "c2"])  # c3 private, c4 other tenant, c5 inactive
    assert set(dict(rows(score(spark, asked(spark, "u7")).select("chunk_id", "score")))) == {"c1", "c2", "c3"}


def test_phrase_boost(spark):
    q = spark.createDataFrame([("q", "t0", "u2", ["r"], ["k"], "alpha beta", None)], asked(spark).schema)
    base = score(spark, q)
    boosted = search.phrase_boost(base, q, corpus(spark), F.lit(13 / 5))
    delta = {c: round(b - a, 4) for (c, a), (_, b) in zip(rows(base.select("chunk_id", "score"), "chunk_id"), rows(boosted.select("chunk_id", "score"), "chunk_id"))}
    assert delta["c2"] == 0 and delta["c1"] > 0


def vectors(spark, n=300, dims=8):
    rng = np.random.default_rng(1)
    data = [(f"v{i}", [float(x) for x in rng.standard_normal(dims)], ["a" if i % 3 else "b"]) for i in range(n)]
    return spark.createDataFrame(data, "vector_id string, embedding array<double>, access array<string>"), data


def test_vector_paths_equal_brute_force(spark):
    v, data = vectors(spark)
    q = spark.createDataFrame([("q1", data[5][1], ["a"]), ("q2", data[9][1], None)], "query_id string, embedding array<double>, access array<string>")
    want = {}
    for name, vec, held in (("q1", data[5][1], {"a"}), ("q2", data[9][1], None)):
        scored = []
        for vid, e, acc in data:
            if held is None or held & set(acc):
                cos = float(np.dot(vec, e) / np.linalg.norm(vec) / np.linalg.norm(e))
                scored.append((-round((1 + cos) / 2, 6), vid))
        want[name] = [vid for _, vid in sorted(scored)[:7]]
    for limit in (10, 0):
        got = vector.vector_topk(q, v, 7, facets=("access",), broadcast_queries=limit)
        for name in want:
            assert [r[0] for r in rows(got.filter(F.col("query_id") == name).select("vector_id", "rank"), "rank")] == want[name]


def hits(spark, pairs):
    return spark.createDataFrame([("q", c, "d", s, i + 1) for i, (c, s) in enumerate(pairs)], "query_id string, chunk_id string, document_id string, score double, rank int")


def test_rrf_and_basic_ties(spark):
    fused = rank.reciprocal_rank_fusion(hits(spark, [("a", 12.0), ("b", 8.0)]), hits(spark, [("b", .9), ("c", .8)]))
    assert [r[0] for r in rows(fused.select("chunk_id", "fusion_rank"), "fusion_rank")] == ["b", "a", "c"]
    tied = hits(spark, [("z", 1.0)]), hits(spark, [("a", 1.0)])
    assert rank.reciprocal_rank_fusion(*tied).orderBy("fusion_rank").first()["chunk_id"] == "a"
    assert rank.basic_hybrid(*tied, 2).orderBy("fusion_rank").first()["chunk_id"] == "z"


def test_rerank_and_fallback(spark):
    fused = rank.reciprocal_rank_fusion(hits(spark, [("a", 2.0), ("b", 1.0)]), hits(spark, []))
    scores = spark.createDataFrame([("q", "a", .1), ("q", "b", .9)], "query_id string, chunk_id string, rerank_score double")
    assert [r[0] for r in rows(rank.rerank(fused, scores).select("chunk_id", "rerank_rank"), "rerank_rank")] == ["b", "a"]
    partial = rank.rerank(fused, scores.filter("chunk_id = 'b'")).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in partial] == ["a", "b"] and partial[0]["fallback_reason"]


def test_reranker_hook(spark):
    fused = rank.reciprocal_rank_fusion(hits(spark, [("c1", 2.0), ("c2", 1.0)]), hits(spark, []))
    q, c = asked(spark), corpus(spark)
    scores = rank.score_with(fused, q, c, lambda queries, texts: [float(len(t)) for t in texts])
    assert [r[0] for r in rows(rank.rerank(fused, scores).select("chunk_id", "rerank_rank"), "rerank_rank")] == ["c2", "c1"]
    failed = rank.rerank(fused, rank.score_with(fused, q, c, lambda queries, texts: 1 / 0))
    assert [r[0] for r in rows(failed.select("chunk_id", "rerank_rank"), "rerank_rank")] == ["c1", "c2"]


@pytest.mark.parametrize("pairs_per_call", [1, 7, 1_000])
def test_reranker_fails_by_query(spark, pairs_per_call):
    """Whatever the batches and partitions: a query fails alone, with its own reason; the others are scored."""
    import time

    def model(queries, texts):
        if "bad" in queries:
            raise KeyError("bad")
        if "slow" in queries:
            time.sleep(1.5)
        if "short" in queries:
            return [1.0]
        return [float("nan") if q == "nan" else float(len(t)) for q, t in zip(queries, texts)]

    names = ["good", "bad", "slow", "short", "nan", "fine"]
    q = spark.createDataFrame([(n, n) for n in names], "query_id string, text string")
    c = spark.createDataFrame([(f"c{i}", "x" * (i + 1)) for i in range(5)], "chunk_id string, content string")
    fused = q.select("query_id").crossJoin(c.select("chunk_id")).selectExpr(
        "query_id", "chunk_id", "cast(substring(chunk_id, 2) as int) + 1 as fusion_rank", "1.0 / (1 + cast(substring(chunk_id, 2) as int)) as fusion_score")
    scores = rank.score_with(fused, q, c, model, pairs_per_call=pairs_per_call, timeout=0.5)
    got = rank.rerank(fused, scores).select("query_id", "chunk_id", "rerank_rank", "fallback_reason").collect()
    reasons = {r.query_id: r.fallback_reason for r in got}
    assert reasons == {"good": None, "fine": None, "bad": "reranker_error:KeyError", "slow": rank.TIMEOUT, "short": "reranker_error:ValueError", "nan": "reranker_error:ValueError"}
    for name in names:
        order = [r.chunk_id for r in sorted(got, key=lambda r: r.rerank_rank) if r.query_id == name]
        assert order == ([f"c{i}" for i in (4, 3, 2, 1, 0)] if name in ("good", "fine") else [f"c{i}" for i in range(5)])


def test_expansion_and_budget_around_a_hot_document(spark):
    """A document with a third of all chunks; relations and budget against brute force."""
    rng = np.random.default_rng(3)
    rows_, at = [], 0
    for version, n in [("hot", 400), *((f"v{i}", 20) for i in range(40))]:
        for s in range(n):
            parent = None if s % 5 == 0 else f"{version}-{s - s % 5}" if s % 3 else f"{version}-p{s // 7}"
            rows_.append((f"{version}-{s}", version, s, int(rng.integers(1, 40)), parent))
            at += 1
    c = spark.createDataFrame(rows_, "chunk_id string, document_version_id string, sequence int, token_count int, parent_chunk_id string")
    picked = [rows_[int(i)] for i in rng.choice(len(rows_), 30, replace=False)]
    h = spark.createDataFrame([(f"q{k % 3}", *r) for k, r in enumerate(picked)], "query_id string, chunk_id string, document_version_id string, sequence int, token_count int, parent_chunk_id string")
    want, budget = set(), {}
    for k, (i, v, s, _, p) in enumerate(picked):
        near = [r for r in rows_ if r[1] == v and (r[0] in (i, p) or r[4] == p or abs(r[2] - s) <= 1)]
        want |= {(f"q{k % 3}", i, r[0]) for r in near}
        used, ids = 0, []
        for r in sorted(near, key=lambda r: r[2]):
            if used + r[3] <= 90:
                used, ids = used + r[3], [*ids, r[0]]
        budget[f"q{k % 3}", i] = (used, ids)
    expanded = rank.expand_neighbours(h, c)
    got = [(r.query_id, r.hit_chunk_id, r.chunk_id) for r in expanded.collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.query_id, r.hit_chunk_id): (r.tokens, list(r.chunk_ids)) for r in rank.greedy_budget(expanded, 90).collect()} == budget
    assert "NestedLoop" not in expanded._jdf.queryExecution().executedPlan().toString()


def test_clean_order_of_rules(spark):
    data = [(1, "a", "d", .9), (2, "a", "d", .9), (3, "b", "d", .1), (4, "c", "d", .8), (5, "e", "d", .7), (6, "f", "x", .6), (7, "g", "x", .5)]
    df = spark.createDataFrame([("q", *r) for r in data], "query_id string, rerank_rank int, chunk_id string, document_id string, final_score double")
    got = rank.clean_candidates(df, threshold=.2, per_document=2, top_k=3).orderBy("rerank_rank").collect()
    assert [r["exclusion_reason"] for r in got] == [None, "duplicate_chunk", "below_threshold", None, "per_document_limit", None, None]
    assert [r["final_rank"] for r in got] == [1, None, None, 2, None, 3, None]


def test_pack_breaks_and_budget_skips(spark):
    df = spark.createDataFrame([("q", 1, "x" * 30), ("q", 2, "y" * 30), ("q", 3, "z")], "query_id string, final_rank int, content string")
    assert rank.pack_context(df, 50).first()["context"] == "[1] " + "x" * 30 + "\n"
    e = spark.createDataFrame([("q", "h", f"c{i}", i, t) for i, t in enumerate([3, 9, 4, 2])], "query_id string, hit_chunk_id string, chunk_id string, sequence int, token_count int")
    assert rank.greedy_budget(e, 8).first()["chunk_ids"] == ["c0", "c2"]


def test_fallback_plan_and_status(spark):
    q = spark.createDataFrame([("q", 6000)], "query_id string, top_k int")
    got = rows(rank.fallback_attempts(q, normal=.5, floor=.1).select("attempt", "candidate_top_k", "threshold", "inferred_filter_removed"), "attempt")
    assert got == [(0, 6000, .5, False), (1, 10000, .3, False), (2, 10000, .1, True), (3, 10000, .1, True), (4, 10000, .1, True)]
    s = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "s int, f int").select(rank.attempt_status(F.col("s"), F.col("f")))
    assert [r[0] for r in s.collect()] == ["success", "failed", "no_evidence"]


def test_index_plan_has_no_cross_join_and_no_posting_shuffle(spark, sf):
    plan = retrieval.bm25_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the only exchanges left are the statistics row, the broadcast side and the top-k per query
    assert "Exchange hashpartitioning(query_id" in plan and "hashpartitioning(chunk_id" not in plan and "hashpartitioning(query_id#" in plan
    assert plan.count("WindowGroupLimit") >= 2


def test_terms(spark):
    assert spark.sql("select 'Straße STRASSE' as t").select(words(F.col("t"))).first()[0] == ["strasse", "strasse"]


def test_qrels_find_items_of_any_length(spark, tmp_path):
    from lorebase.sources import derived

    items = ["two words", "x", "déjà", "alpha beta gamma", "one two three four five six seven eight", "lone wolf in", "", "absent phrase of words"]
    texts = [" ".join(["pad", *items[:6], "tail"]), "xtwo wordsx", "alpha beta gammas", "no match", None, "alpha beta", "ha"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.query_id, r.document_id, r.relevance) for r in derived.qrels(spark, str(tmp_path)).collect())
    want = [(f"q{i}", f"d{j}", 2 if j == 0 else 1) for i, a in enumerate(items) for j, t in enumerate(texts) if a and t is not None and a in t]
    assert got == sorted(want)


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from lorebase.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster, "x")


def test_failed_channel_ends_the_attempts(spark):
    from lorebase.operators import rank

    pool = "query_id string, pool string, chunk_id string, document_id string, score double, rank int"
    hits = spark.createDataFrame([(q, "free", "c1", "d1", 1.0, 1) for q in "abc"] + [("d", "filtered", "c1", "d1", 1.0, 1)], pool)
    attempts = rank.fallback_attempts(spark.createDataFrame([(q, 10) for q in "abcde"], "query_id string, top_k int"), normal=0.0, floor=0.0)
    failures = spark.createDataFrame([("b", 0), ("c", 2), ("d", 0), ("e", 4)], "query_id string, attempt int")
    score = lambda df: df.withColumn("rerank_score", df.fusion_score)
    got = {r.query_id: r.attempt for r in rank.staged_retrieve(attempts, hits, hits.limit(0), score, failures=failures).collect()}
    assert got == {"a": 2, "c": 2, "d": 0}  # b failed before attempt 2 could serve it; e never selects
    assert {r.query_id for r in rank.staged_retrieve(attempts, hits, hits.limit(0), score).collect()} == set("abcd")


def test_provider_candidates_pass_manifest_and_scope(spark):
    from lorebase.operators import rank

    base = spark.createDataFrame([("q", "c0", 0.5)], "query_id string, chunk_id string, final_score double")
    extra = spark.createDataFrame(
        [("q", f"c{i}", 0.9, "t", t, kb, v) for i, (t, kb, v) in enumerate([("t", "k", "v"), ("t", "k", "old"), ("x", "k", "v"), ("t", "bad", "v"), ("t", "k2", "v")], 1)],
        "query_id string, chunk_id string, final_score double, request_tenant string, tenant_id string, knowledge_base_id string, document_version_id string")
    active = spark.createDataFrame([("t", "k", "v"), ("x", "k", "v"), ("t", "bad", "v")], "tenant_id string, knowledge_base_id string, document_version_id string")
    usable = spark.createDataFrame([("t", "k", True), ("x", "k", True), ("t", "bad", False), ("t", "k2", True)], "tenant_id string, knowledge_base_id string, usable boolean")
    got = [(r.chunk_id, r.origin) for r in rank.merge_advanced(base, extra, active, usable, 10).orderBy("rank").collect()]
    assert got == [("c1", "advanced"), ("c0", "base")]


def test_coded_search_recall_and_candidate_share(spark):
    from lorebase.operators import vector
    from lorebase.plans import retrieval

    q, v = retrieval.centroids(spark, "/root/testdata/sf0.1")
    exact = {(r.query_id, r.vector_id) for r in vector.vector_topk(q, v, 10).collect()}
    found = {(r.query_id, r.vector_id) for r in vector.vector_topk_coded(q, v, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert vector.candidate_budget(10) <= 0.05 * v.count() and [vector.candidate_budget(k) for k in (1, 5_000, 20_000)] == [4, 10_000, 20_000]


@pytest.mark.parametrize("k", [1, 10, 50])
def test_coded_search_recall_for_stored_vectors(spark, k):
    from lorebase.operators import vector
    from lorebase.plans import retrieval

    q, v = retrieval.stored(spark, "/root/testdata/sf0.1")
    e = np.array([r.embedding for r in v.orderBy(v.vector_id.cast("long")).collect()], dtype=float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    names = [r.vector_id for r in v.select("vector_id").orderBy(v.vector_id.cast("long")).collect()]
    exact = {(n, names[j]) for n, x in zip(names, e, strict=True) if int(n) % 100 == 0 for j in np.argsort(-(e @ x))[:k]}
    assert q.count() == sum(int(n) % 100 == 0 for n in names) > 10
    found = {(r.query_id, r.vector_id) for r in vector.vector_topk_coded(q, v, k).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    for options in ({}, {"broadcast_queries": 0}):
        found = {(r.query_id, r.vector_id) for r in vector.vector_topk(q, v, k, **options).collect()}
        assert len(exact & found) >= 0.999 * len(exact)
