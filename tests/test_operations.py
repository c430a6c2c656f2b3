"""Lifecycle, usage, temporal, graph, evaluation and streams on small literal inputs."""

import random
import re
from datetime import datetime, timedelta
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lorebase.operators import access, enrich, evaluate, evidence, graph, index, lifecycle, temporal, usage
from lorebase.operators.governed import StatementDenied
from lorebase.functions.predicates import Group, Leaf, compile_filter
from lorebase.plans import prepare
from lorebase.sources import sinks
from lorebase.streaming import jobs

NOW = datetime(2024, 1, 1)


def test_replay_matches_sequential_for_any_cut(spark):
    rng = random.Random(2)
    names = list(lifecycle.VERSION_EDGES)
    log = [(rng.randint(1, 3), i, rng.choice(names[1:5] * 6 + ["deleted"])) for i in range(400)]
    want, state = {}, {}
    for entity, seq, target in log:
        before = state.get(entity, "registered")
        legal = target in lifecycle.VERSION_EDGES[before]
        want[seq] = "unchanged" if target == before else "applied" if legal else "document_version_transition_invalid"
        state[entity] = target if legal else before
    df = spark.createDataFrame(log, "entity_id int, seq long, status string").repartition(5)
    for segment in (7, 100_000):
        got = lifecycle.replay(df, segment=segment)
        assert dict(rows(got.select("seq", "outcome"))) == want
        assert dict(rows(lifecycle.replay_summary(got).select("entity_id", "status"))) == state


def test_replay_of_one_hot_entity_stays_in_the_jvm(spark):
    rng = random.Random(5)
    names = list(lifecycle.VERSION_EDGES)
    log = [(1, -700 + 3 * i, rng.choice([*names[1:5], "lost"])) for i in range(3_000)] + [(2, 5, "ingesting"), (3, 6, None)]
    got = lifecycle.replay(spark.createDataFrame(log, "entity_id int, seq long, status string").repartition(5), segment=16)
    state, want = {1: "registered", 2: "registered", 3: "registered"}, {}
    for entity, seq, target in log:
        before = state[entity]
        legal = target in lifecycle.VERSION_EDGES[before]
        want[entity, seq] = (before, target, "unchanged" if target == before else "applied" if legal else "document_version_transition_invalid")
        state[entity] = target if legal else before
    assert {(r.entity_id, r.seq): (r.from_status, r.to_status, r.outcome) for r in got.collect()} == want
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    assert lifecycle.replay(spark.createDataFrame([], "entity_id int, seq long, status string")).collect() == []


def test_stream_status_carries_states_over_batches(spark, tmp_path):
    """Many batches give what one batch gives, for a hot entity and others."""
    rng, source = random.Random(8), str(tmp_path / "in")
    names = list(lifecycle.VERSION_EDGES)[1:5]
    log = [(1 if i % 3 else i % 5, i, rng.choice(names)) for i in range(300)]
    for k in range(0, 300, 100):
        spark.createDataFrame(log[k:k + 100], "entity_id int, seq long, status string").coalesce(1).write.mode("append").parquet(source)
    got = jobs.replay_status(
        jobs.file_stream(spark, source, "*.parquet", "entity_id int, seq long, status string", maxFilesPerTrigger=1),
        out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    once = lifecycle.replay(spark.createDataFrame(log, "entity_id int, seq long, status string"))
    assert sorted(map(tuple, got.select(*once.columns).collect())) == sorted(map(tuple, once.collect()))


def test_publish_single_winner_is_order_independent(spark):
    docs = spark.createDataFrame([("d1", "active", 3, "v1"), ("d2", "delete_pending", 1, None)], "document_id string, status string, revision int, current_version_id string")
    vers = spark.createDataFrame([("v1", "d1", "ready"), ("v2", "d1", "registered"), ("v9", "d2", "ready")], "document_version_id string, document_id string, status string")
    counts = spark.createDataFrame([("v1", 2), ("v2", 2), ("v9", 1)], "document_version_id string, chunk_count int")
    ops = [("a", "d1", "v2", 3, 1), ("b", "d1", "v2", 3, 5), ("late", "d1", "v2", 2, 9), ("c", "d2", "v9", 1, 1), ("e", "dx", "v2", 1, 1)]
    for order in (ops, ops[::-1]):
        df = spark.createDataFrame(order, "operation_id string, document_id string, document_version_id string, expected_revision int, fencing_token int")
        done = lifecycle.publish_versions(df, docs, vers, counts)
        assert dict(rows(done.select("operation_id", "outcome"))) == {
            "a": "document_revision_conflict", "b": "published", "late": "document_revision_conflict", "c": "document_deleted", "e": "not_found"}
    new_docs, new_versions = lifecycle.apply_published(docs, vers, done, F.lit(NOW))
    assert rows(new_docs.select("document_id", "current_version_id", "revision"), "document_id") == [("d1", "v2", 4), ("d2", None, 1)]
    assert dict(rows(new_versions.select("document_version_id", "status"))) == {"v1": "superseded", "v2": "ready", "v9": "ready"}


def test_fencing_and_upsert(spark):
    state = spark.createDataFrame([("d1", "v1", 4), ("d2", "v1", None), ("d3", "v1", 2)], "id string, version string, token int")
    up = spark.createDataFrame([("d1", "v2", 3), ("d2", "v2", 1), ("d3", "v2", 2), ("d3", "v3", 2)], "id string, new_version string, new_token int")
    assert rows(index.fenced_promote(state, up, "id"), "id") == [("d1", "v1", 4, False), ("d2", "v2", 1, True), ("d3", "v3", 2, True)]
    old = spark.createDataFrame([("k1", 1, "a"), ("k2", 5, "b")], "k string, n int, v string")
    new = spark.createDataFrame([("k1", 1, "A"), ("k2", 4, "B"), ("k3", 1, "C")], "k string, n int, v string")
    assert rows(index.upsert(old, new, ["k"], "n").select("k", "v"), "k") == [("k1", "A"), ("k2", "b"), ("k3", "C")]


def test_publish_pointer_and_conflict(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sinks.publish(df, root, "t") == 1 and sinks.upsert_table(spark.createDataFrame([(1, "b"), (2, "c")], df.schema), root, "t", ["k"], "v") == 2
    assert rows(sinks.read_current(spark, root, "t"), "k") == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError, match="validation"):
        sinks.publish(df, root, "t", validate=lambda staged: False)
    with pytest.raises(ValueError, match="index_alias_conflict"):
        sinks.publish(df, root, "t", expected_current=1)
    assert sinks.read_current(spark, root, "t").count() == 2
    assert len([p for p in (tmp_path / "t").iterdir()]) == 2  # rejected candidates are gone
    assert sinks.rollback(spark, root, "t", 1) == 3 and rows(sinks.read_current(spark, root, "t")) == [(1, "a")]


def test_of_two_writers_one_switches(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.publish(df, root, "t")

    def late(staged):  # another writer switches between this one's start and its switch
        sinks.publish(df.union(df), root, "t")
        return True

    with pytest.raises(ValueError, match="index_alias_conflict"):
        sinks.publish(df, root, "t", validate=late)
    assert sinks.read_current(spark, root, "t").count() == 2 and sinks.current(spark, root, "t")["generation"] == 2


def test_retry_plan(spark):
    df = spark.createDataFrame([("a", 0, None, None, None), ("b", 1, "TimeoutError", None, None), ("c", 2, "document_revision_conflict", None, None), ("d", 0, None, 429, 900.0), ("e", 5, None, 500, None), ("f", 0, None, 404, None)],
                               "outbox_id string, attempts int, error string, http_status int, retry_after double")
    got = {r["outbox_id"]: (r["status"], r["delay_seconds"]) for r in lifecycle.retry_plan(df, F.lit(NOW)).collect()}
    assert got == {"a": ("published", 0.0), "b": ("pending", 2.0), "c": ("dead_letter", 0.0), "d": ("pending", 300.0), "e": ("dead_letter", 0.0), "f": ("dead_letter", 0.0)}


def test_budget_breach_across_pieces(spark):
    df = spark.createDataFrame([("r", i, 10) for i in range(30)] + [("s", 0, 5)], "run_id string, seq long, tokens int")
    got = usage.first_breach(df, {"total_tokens": F.col("tokens")}, {"total_tokens": 195})
    assert rows(got) == [("r", 19, "total_tokens")]
    cut = usage.running_totals(df, {"total_tokens": F.col("tokens")}, segment=4).filter("run_id = 'r'").agg(F.max("total_tokens_total")).first()[0]
    assert cut == 300


def test_memories_follow_consent(spark):
    at = lambda d: NOW + timedelta(days=d)
    consents = spark.createDataFrame([(1, at(0), True), (1, at(5), False), (1, at(8), True), (2, at(0), True), (2, at(9), False)], "user_id int, at timestamp, enabled boolean")
    mem = spark.createDataFrame([(1, "old", at(1), None), (1, "gap", at(6), None), (1, "kept", at(9), None), (1, "gone", at(9), at(10)), (1, "my password", at(9), None), (2, "x", at(1), None)],
                                "user_id int, content string, created_at timestamp, deleted_at timestamp")
    assert rows(usage.active_memories(mem, consents, F.lit(at(20))).select("content")) == [("kept",)]
    assert usage.active_memories(mem, consents, F.lit(at(200))).count() == 0


@pytest.mark.parametrize("values,want", [(list(range(1, 101)), 95.95), ([1, 2, 9], 14.6), ([7], 7.0), ([5, 5, 5, 5], 5.0)])
def test_exclusive_quantile(spark, values, want):
    df = spark.createDataFrame([("r", float(v)) for v in values], "route string, v double")
    assert round(temporal.exclusive_quantile(df, ["route"], "v").first()["p95"], 6) == want


def test_exclusive_quantile_bracket_is_exact(spark):
    """The bracketed path, forced by a coarse accuracy, against the standard library."""
    rng = random.Random(8)
    data = {r: [round(rng.expovariate(1), rng.choice([1, 6])) for _ in range(4_000)] for r in ("a", "b", "c")}
    df = spark.createDataFrame([(r, v) for r, vs in data.items() for v in vs], "route string, v double").repartition(7)
    for accuracy in (100, 1_000):
        got = {r["route"]: round(r["p95"], 9) for r in temporal.exclusive_quantile(df, ["route"], "v", accuracy=accuracy).collect()}
        assert got == {r: round(quantiles(vs, n=100)[94], 9) for r, vs in data.items()}


def test_series_windows(spark):
    at = lambda s: NOW + timedelta(seconds=s)
    df = spark.createDataFrame([("s", 1, at(30), 3.0), ("s", 2, at(0), 1.0), ("s", 3, at(10), None), ("s", 4, at(150), 8.0)], "series_id string, event_id int, at timestamp, value double")
    got = temporal.series_windows(df, 60).orderBy("window_index").collect()
    assert [(r["window_index"], r["n"], r["missing"], r["mean"], r["trend"]) for r in got] == [(0, 2, 1, 2.0, 2.0), (2, 1, 0, 8.0, None)]


def test_keywords_questions_tree(spark):
    df = spark.createDataFrame([("the Brake and brake x. Reset? Reset? ok",), ("!",)], ["t"])
    got = rows(df.select(enrich.keywords(F.col("t")).alias("k"), enrich.questions(F.col("t")).alias("q")).select("k.text", "k.keyword_count", "q.question_count"))
    assert got == [("brake\nreset\nok", 3, 3), ("!", 0, 1)]
    chunks = spark.createDataFrame([("v", i, f"c{i}", f"w{i} x") for i in range(5)] + [("one", 0, "z", "t")], "document_version_id string, sequence int, chunk_id string, content string")
    tree = rows(enrich.summary_tree(chunks, words=3).filter("document_version_id = 'v' and level > 0").select("level", "position", "text", F.size("children"), F.size("sources")), "level", "position")
    assert tree == [(1, 0, "w0 x w1", 2, 2), (1, 1, "w2 x w3", 2, 2), (1, 2, "w4 x", 1, 1), (2, 0, "w0 x w1", 2, 4), (2, 1, "w4 x", 1, 1), (3, 0, "w0 x w1", 2, 5)]


def test_graph(spark):
    df = spark.createDataFrame([("t", "k", "c1", "Train Brake Controller Alarm Train"), ("t", "k", "c2", "Brake Train"), ("t", "k", "c3", "none")], "tenant_id string, knowledge_base_id string, chunk_id string, content string")
    assert rows(graph.edges(df).select("source", "target", "n_sources"), "source", "target") == [("Alarm", "Controller", 1), ("Brake", "Controller", 1), ("Brake", "Train", 2)]
    members = rows(graph.communities(graph.edges(df)).select("vertex", "member"), "vertex", "member")
    assert [m for v, m in members if v == "Brake"] == ["Brake", "Controller", "Train"]
    assert rows(graph.budget_status(df, max_entities=3).select("status")) == [("graph_budget_exceeded",)]


def test_evidence_and_policy(spark):
    steps = spark.createDataFrame([(r, s, True) for r in (1, 2, 3) for s in ("a", "b")] + [(4, "a", True)], "run_id int, step_id string, critical boolean")
    ev = spark.createDataFrame([(1, "a", "f", "Yes"), (1, "b", "f", " yes "), (2, "a", "f", "yes"), (4, "a", "f", "yes"), (4, "a", "f", "no")], "run_id int, step_id string, fact_key string, stance string").selectExpr(
        "*", "'t' as run_tenant_id", "'t' as tenant_id", "true as authorized", "true as active_version", "1.0 as score", "false as injection_detected", "'ok' as excerpt", "'knowledge' as source_kind", "'c' as citation_id")
    assert dict(rows(evidence.decide(ev, steps).select("run_id", "status"))) == {1: "sufficient", 2: "partial_evidence", 3: "no_evidence", 4: "conflicting_evidence"}
    calls = spark.createDataFrame([("t", "u", "x", 1, "sql", "d1", True), ("t", "u", "x", 2, "sql", "d2", True), ("t", "u", "y", 3, "sql", "d1", True), ("t", "u", "x", 4, "sql", "d1", True)],
                                  "tenant_id string, actor_id string, call_id string, seq int, tool string, digest string, ok boolean")
    assert dict(rows(access.call_reuse(calls).select("seq", "outcome"))) == {1: "executed", 2: "collision", 3: "reused", 4: "replayed"}


def test_filter_not_keeps_unknown(spark):
    df = spark.createDataFrame([("a", "en"), ("b", None), ("c", "fr")], "document_id string, language string")
    assert [r[0] for r in rows(df.filter(compile_filter(Group("not", (Leaf("language", "equals", "en"),)))))] == ["b", "c"]
    with pytest.raises(ValueError):
        compile_filter(Leaf("secret", "equals", 1))


@pytest.mark.parametrize("statement,code", [
    ("SELECT * FROM orders", "sql_column_denied"), ("DROP TABLE orders", "sql_not_read_only"), ("SELECT o_orderkey FROM lineitem", "sql_table_denied"),
    ("SELECT upper('x') FROM orders", "sql_parameter_required"), ("SELECT concat(o_orderstatus, o_orderstatus) FROM orders", "sql_function_denied"),
    ("SELECT secret FROM orders", "sql_column_denied"), ("SELEC", "sql_invalid"), ("SELECT a.x FROM parquet.`/root/testdata` a", "sql_table_denied"),
])
def test_governed_sql_denies(spark, sf, statement, code):
    with pytest.raises(StatementDenied) as error:
        prepare.governed(spark, sf).run(statement, "BUILDING")
    assert error.value.code == code


def test_governed_sql_isolates_tenants(spark, sf):
    sql = prepare.governed(spark, sf)
    total = sum(sql.run("SELECT count(o_orderkey) AS n FROM orders", s).first()["n"] for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    assert total == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert sql.run("SELECT count(o_orderkey) AS n FROM orders", "NOBODY").first()["n"] == 0
    cut = sql.run("SELECT o_orderkey AS k FROM orders", "BUILDING", flag="truncated").collect()
    assert len(cut) == sql.max_rows and all(r.truncated for r in cut) and [r.k for r in cut] == sorted(r.k for r in cut)
    assert not any(r.truncated for r in sql.run("SELECT count(o_orderkey) AS n FROM orders", "BUILDING", flag="truncated").collect())


def test_metrics(spark):
    q = spark.createDataFrame([("q1",), ("q2",)], ["query_id"])
    run = spark.createDataFrame([("q1", 1, "noise"), ("q1", 2, "a"), ("q1", 3, "b"), ("q2", 1, "x")], "query_id string, rank int, item_id string")
    rels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2)], "query_id string, item_id string, relevance int")
    value = lambda df, c: dict((r["query_id"], round(r[c], 4)) for r in df.collect())
    assert value(evaluate.precision_at_k(q, run, rels, 10), "precision") == {"q1": .2, "q2": 0}
    assert value(evaluate.recall_at_k(q, run, rels, 2), "recall") == {"q1": .5, "q2": 0}
    assert value(evaluate.binary_ranking(q, run, rels, 3), "recall") == {"q1": 1, "q2": 1}
    assert value(evaluate.binary_ranking(q, run, rels, 3), "ndcg") == {"q1": .6934, "q2": 1}
    assert value(evaluate.ndcg_at_k(q, run, rels, 3), "ndcg") == {"q1": .5869, "q2": 0}
    assert evaluate.mean_reciprocal_rank(q, run, rels).first()["mrr"] == .25
    gate = evaluate.release_gate(spark.createDataFrame([("r", "cross_tenant_violations", 0.0), ("r", "retrieval_recall_at_10", .95)], "release string, metric string, value double"))
    assert gate.first()["failures"] == "critical_security_violations,recovery_failures,answer_faithfulness,citation_recall,internal_error_rate"


def test_stream_status_rejects_late_entries(spark, tmp_path):
    source = str(tmp_path / "in")
    for seq, status in ((1, "ingesting"), (5, "ready"), (3, "failed"), (6, "superseded")):
        spark.createDataFrame([(7, seq, status)], "entity_id int, seq long, status string").coalesce(1).write.mode("append").parquet(source)
        got = jobs.replay_status(
            jobs.file_stream(spark, source, "*.parquet", "entity_id int, seq long, status string", maxFilesPerTrigger=1),
            out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    assert dict(rows(got.select("seq", "outcome"))) == {1: "applied", 5: "applied", 3: "document_version_timestamp_regression", 6: "applied"}


def test_stream_error_rate_drops_late_rows(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "at timestamp, status int"
    for minutes in ([1, 2], [60], [3], [120]):  # minute 3 arrives after the watermark passed it
        spark.createDataFrame([(NOW + timedelta(minutes=m), 500 if m == 2 else 200) for m in minutes], schema).coalesce(1).write.mode("append").parquet(source)
        got = jobs.error_rates(jobs.file_stream(spark, source, "*.parquet", schema), event_time="at", delay="10 minutes", out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    assert rows(got.select("window_start", "requests", "errors", "alert"), "window_start") == [(NOW, 2, 1, True), (NOW + timedelta(minutes=60), 1, 0, False)]


def test_stream_ingest_ignores_duplicates(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id string, at timestamp, v int"
    once = spark.createDataFrame([("a", NOW, 1), ("b", NOW, 2)], schema).coalesce(1)
    for _ in range(2):
        once.write.mode("append").parquet(source)
        got = jobs.ingest(jobs.file_stream(spark, source, "*.parquet", schema), lambda b: b.select("id", "v"), message_id="id", event_time="at", delay="1 day", keys=["id"],
                          out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    assert rows(got, "id") == [("a", 1), ("b", 2)]


def test_filter_fingerprints_are_order_stable(spark):
    """Nested trees by one digest each, whatever the order of children and rows; broken trees have none."""
    def tree(name, order):
        nodes = [(0, None, "and", None, None), (1, 0, "or", None, None), (2, 0, "not", None, None), (3, 1, "eq", "a", "1"), (4, 1, "in", "b", "[2,3]"), (5, 2, "gte", "c", None)]
        number = {n[0]: k for k, n in enumerate(nodes[i] for i in order)}
        return [(name, number[i], None if p is None else number[p], op, f, v) for i, p, op, f, v in (nodes[k] for k in order)]

    rows_ = tree("x", range(6)) + tree("y", [5, 4, 3, 2, 1, 0]) + [("z", *r[1:3], "or" if r[3] == "and" else r[3], *r[4:]) for r in tree("z", range(6))]
    rows_ += [("leaf", 0, None, "eq", "a", "1"), ("empty", 0, None, "and", None, None), ("two", 0, None, "eq", "a", "1"), ("two", 1, None, "eq", "a", "1")]
    rows_ += [("loop", 0, 1, "and", None, None), ("loop", 1, 0, "or", None, None), ("lost", 0, None, "eq", "a", "1"), ("lost", 1, 9, "eq", "a", "1")]
    rows_ += [("nots", 0, None, "not", None, None), ("nots", 1, 0, "eq", "a", "1"), ("nots", 2, 0, "eq", "b", "1")]
    schema = "filter_id string, node_id int, parent_id int, op string, field string, value string"
    got = {r.filter_id: (r.digest, r.n_leaves) for r in access.filter_fingerprints(spark.createDataFrame(rows_, schema).repartition(3)).collect()}
    assert got["x"] == got["y"] and got["x"][1] == 3 and len(got["x"][0]) == 16 and len({got[k][0] for k in ("x", "z", "leaf")}) == 3
    assert {k for k, v in got.items() if v[0] == access.INVALID_FILTER} == {"empty", "loop", "nots", "two", "lost"}
    assert access.filter_fingerprints(spark.createDataFrame([], schema)).collect() == []


def test_quantile_of_one_large_group_narrows_its_bracket(spark):
    """One route holds most rows; equal values, ties at the edges and small groups give the exact quantile."""
    df = spark.range(60_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN concat('r', id % 7) ELSE 'hot' END AS route", "cast(pmod(xxhash64(id), 20000) AS double) AS v").unionByName(
        spark.range(5_000).selectExpr("'same' AS route", "7.0D AS v")).unionByName(
        spark.range(9_000).selectExpr("'ties' AS route", "cast(least(id, 100) AS double) AS v")).unionByName(spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 9.0)], "route string, v double"))
    samples = {}
    for r in df.collect():
        samples.setdefault(r.route, []).append(r.v)
    got = {r.route: (r.n, r.p95) for r in temporal.exclusive_quantile(df, ["route"], "v", bracket_rows=300).collect()}
    assert set(got) == set(samples)
    for route, values in samples.items():
        values.sort()
        n = len(values)
        j = max(1, min(n - 1, (n + 1) * 95 // 100))
        delta = (n + 1) * 95 - j * 100
        want = values[0] if n == 1 else (values[j - 1] * (100 - delta) + values[j] * delta) / 100
        assert got[route] == (n, pytest.approx(want))
