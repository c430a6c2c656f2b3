"""Registered lifecycle, usage, memory and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import text as tx
from lorebase.operators import evaluate, index, lifecycle, rank, usage
from lorebase.plans import retrieval
from lorebase.plans.sqlkit import define, query
from lorebase.session import shared_dir
from lorebase.sources import derived, files, sinks
from lorebase.sources.staging import materialized, staged
from lorebase.sources.tables import table


# ---- lifecycle -------------------------------------------------------------------------------
def idempotent_commands(spark: SparkSession, d: str) -> DataFrame:
    commands = table(spark, d, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 4).alias("tenant_id"), F.concat(F.lit("k"), "o_custkey").alias("key"),
        F.col("o_orderkey").alias("seq"), F.concat_ws("|", "o_orderstatus", F.floor(F.col("o_orderkey") / 4000)).alias("fingerprint"))
    return lifecycle.idempotent_commands(commands).select("key", "seq", "job_id", "outcome")


def status_of(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    status = (
        F.when((t == "error") & (F.col("event_id") % 11 == 0), "deleted").when(t == "click", "ingesting").when(t == "view", "ready")
        .when(t == "purchase", "failed").when(t == "signup", "superseded").otherwise("ingesting")
    )
    return events.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), status.alias("status"))


def status_replay(spark: SparkSession, d: str) -> DataFrame:
    """Cut into small pieces here, so the composition of pieces is exercised."""
    return lifecycle.replay(status_of(table(spark, d, "events")), segment=64)


def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    return status_replay(spark, d).filter(F.col("outcome").endswith("invalid")).select("entity_id", "seq", "from_status", "to_status")


def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.replay_summary(status_replay(spark, d))


def operations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lifecycle operations on the document numbered like the customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.concat(F.lit("op"), k).alias("operation_id"), F.concat(F.lit("d"), c).alias("document_id"),
        F.concat(F.lit("d"), c, F.when(k % 7 == 6, "_v2").otherwise("_v1")).alias("document_version_id"),
        (F.lit(1) + k % 3).cast("int").alias("expected_revision"), (F.lit(1) + k % 5).cast("int").alias("fencing_token"),
        F.when(s == "F", "succeeded").when((s == "O") & (k % 2 == 0), "failed").when(s == "O", F.when(k % 4 == 1, "dead_letter").otherwise("pending"))
        .when(k % 3 == 0, "cancelled").otherwise("running").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))


def _projections(spark: SparkSession, d: str) -> DataFrame:
    return _projection_counts(spark, d).select("document_version_id")


def _projection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Indexed chunks per version: written once per corpus, as an index keeps it."""
    return staged(spark, d, "projections", lambda: index.projection_counts(derived.chunks(spark, d).withColumn("document_deleted", F.lit(False))))


def publish_versions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.publish_versions(operations(spark, d), derived.kb_documents(spark, d), derived.kb_versions(spark, d), _projection_counts(spark, d)).select(
        "operation_id", "document_version_id", "outcome")


def published_tables(spark: SparkSession, d: str) -> DataFrame:
    """Version table after all publications were applied."""
    docs, versions = derived.kb_documents(spark, d), derived.kb_versions(spark, d)
    counts = versions.select("document_version_id", F.lit(1).alias("chunk_count"))
    done = lifecycle.publish_versions(operations(spark, d), docs, versions, counts)
    _, after = lifecycle.apply_published(docs, versions, done, F.expr(derived.NOW))
    return after.select("document_version_id", "status", F.coalesce(F.date_format("purge_after", "yyyy-MM-dd"), F.lit("")).alias("purge_after"))


def rollback_check(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.rollback_check(operations(spark, d).drop("status"), derived.kb_versions(spark, d)).select("operation_id", "outcome")


def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    requests = operations(spark, d).select("document_id")
    return lifecycle.soft_delete(requests, derived.kb_documents(spark, d), F.expr(derived.NOW)).withColumn(
        "purge_after", F.coalesce(F.date_format("purge_after", "yyyy-MM-dd"), F.lit("")))


def restore_check(spark: SparkSession, d: str) -> DataFrame:
    """Restore every requested document to the version it had (half of the versions are kept)."""
    versions = derived.kb_versions(spark, d).withColumn(
        "status", F.when(F.substring("document_id", 2, 20).cast("long") % 2 == 0, "superseded").otherwise(F.col("status")))
    counts = _projection_counts(spark, d)
    requests = operations(spark, d).select("operation_id", "document_id", "document_version_id")
    return lifecycle.restore_check(requests, derived.kb_documents(spark, d), versions, counts, F.expr(derived.NOW)).select("operation_id", "outcome")


def purge_due(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.purge_due(derived.kb_documents(spark, d), derived.kb_versions(spark, d), F.expr(derived.NOW))


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("ob"), "event_id").alias("outbox_id"), F.col("ts").cast("timestamp").alias("available_at"),
        F.when(F.col("event_type") == "purchase", "published").otherwise("pending").alias("status"))


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of a reconciliation, and the projections and objects it looked at."""
    versions = derived.kb_versions(spark, d)
    n = F.substring("document_id", 2, 20).cast("long")
    objects = versions.select(F.when(n % 13 == 0, F.concat("object_key", F.lit(".lost"))).otherwise(F.col("object_key")).alias("object_key"))
    projections = _projections(spark, d).withColumn(
        "document_version_id", F.when(F.col("document_version_id").endswith("7_v1"), F.concat("document_version_id", F.lit("x"))).otherwise(F.col("document_version_id")))
    found = lifecycle.reconcile(
        operations(spark, d), derived.kb_documents(spark, d), versions, projections, objects, _outbox(spark, d),
        now=F.expr("timestamp'2024-01-15 00:00:00'"), stale_before=F.expr("timestamp'1998-01-01 00:00:00'"))
    return found, projections, objects


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)[0]


def reconcile_repair(spark: SparkSession, d: str) -> DataFrame:
    """Projections and objects that are left after the orphans of both kinds were removed."""
    found, projections, objects = _findings(spark, d)
    found = materialized(found, "findings")
    left = lifecycle.repaired(projections, found, "orphan_projection", "document_version_id").select(F.lit("projection").alias("kind"), F.col("document_version_id").alias("resource_id"))
    return left.unionByName(lifecycle.repaired(objects, found, "orphan_object", "object_key").select(F.lit("object").alias("kind"), F.col("object_key").alias("resource_id")))


def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    children = table(spark, d, "orders").select(
        F.concat(F.lit("b"), F.floor(F.col("o_orderkey") / 3)).alias("batch_id"),
        F.concat(F.lit("op"), F.when(F.col("o_orderkey") % 50 == 7, -1).otherwise(F.col("o_orderkey"))).alias("operation_id"))
    return lifecycle.batch_rollup(children, operations(spark, d))


def outbox_due(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.due_outbox(_outbox(spark, d), F.expr(derived.NOW), 100).select("outbox_id", F.unix_micros("available_at").alias("due_us"))


def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    attempts = table(spark, d, "events").select(
        F.concat(F.lit("ob"), n).alias("outbox_id"), (n % 7).cast("int").alias("attempts"),
        F.when(F.col("event_type") == "error", F.when(n % 4 == 0, "document_revision_conflict").when(n % 4 == 1, "TimeoutError").when(n % 4 == 2, "authorization").otherwise("KeyError")).alias("error"),
        F.when(F.col("event_type") == "view", F.when(n % 3 == 0, 429).when(n % 3 == 1, 503).otherwise(404)).alias("http_status"),
        F.when((F.col("event_type") == "view") & (n % 6 == 0), F.lit(400.0)).alias("retry_after"))
    return lifecycle.retry_plan(attempts, F.expr(derived.NOW)).select(
        "outbox_id", "attempts", "failure_class", "status", "delay_seconds", F.coalesce(F.unix_micros("available_at"), F.lit(0)).alias("available_us"))


# ---- usage and memory -------------------------------------------------------------------------
RATE_IN, RATE_OUT = 3.0, 15.0
LIMITS = {"model_calls": 6, "total_tokens": 1_200, "generated_tokens": 500, "known_cost": 0.006, "retrieval_rounds": 3, "tool_attempts": 2}


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
        F.ceil(F.length("text") / 4).cast("long").alias("input_tokens"), F.ceil(F.length("text") / 8).cast("long").alias("generated_tokens"),
        (F.col("role") == "user").alias("is_retrieval"), (F.col("turn") % 3 == 2).alias("is_tool"),
        F.when(F.col("turn") % 5 == 4, "unknown").when((F.col("role") == "system") | (F.col("conv_id") % 4 == 0), "local").otherwise("known").alias("cost_status"))


def _amounts() -> dict:
    one = lambda flag: F.when(flag, 1).otherwise(0)
    return {
        "model_calls": F.lit(1), "total_tokens": F.col("input_tokens") + F.col("generated_tokens"), "generated_tokens": F.col("generated_tokens"),
        "known_cost": F.when(F.col("cost_status") == "known", usage.event_cost(RATE_IN, RATE_OUT)).otherwise(0.0),
        "retrieval_rounds": one(F.col("is_retrieval")), "tool_attempts": one(F.col("is_tool"))}


def budget_breach(spark: SparkSession, d: str) -> DataFrame:
    return usage.first_breach(usage_events(spark, d), _amounts(), LIMITS)


def run_cost(spark: SparkSession, d: str) -> DataFrame:
    return usage.run_cost(usage_events(spark, d), usage.event_cost(RATE_IN, RATE_OUT)).withColumn("known_cost_usd", F.round("known_cost_usd", 9))


def active_memories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    memories = e.filter("event_type = 'view'").select(
        "user_id", "event_id", F.col("at").alias("created_at"),
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("my password is "), "event_id")).otherwise(F.col("props")).alias("content"),
        F.when(F.col("event_id") % 10 == 1, F.col("at")).alias("deleted_at"))
    consents = e.filter("event_type in ('signup', 'error')").select("user_id", "at", (F.col("event_type") == "signup").alias("enabled"))
    return usage.active_memories(memories, consents, F.expr(derived.NOW), days=20).select("user_id", "event_id")


# ---- evaluation ------------------------------------------------------------------------------
K = 10


def _run(corpus: retrieval.Corpus) -> DataFrame:
    return retrieval.text_hits(corpus).select("query_id", "rank", F.col("document_id").alias("item_id"))


def _judgements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = retrieval.Corpus(spark, d)
    rels = materialized(derived.qrels(spark, d).withColumnRenamed("document_id", "item_id"), "qrels")  # a metric reads them up to twice
    return corpus.queries.select("query_id"), _run(corpus), rels


def _metric(function, *args, columns: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return function(*_judgements(spark, d), *args).select("query_id", *[F.round(c, 6).alias(c) for c in columns])

    return run


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mean_reciprocal_rank(*_judgements(spark, d)).select(F.round("mrr", 6).alias("mrr"))


def citation_pr(spark: SparkSession, d: str) -> DataFrame:
    q, run, rels = _judgements(spark, d)
    return evaluate.citation_scores(q, run.filter(F.col("rank") <= K), rels).select(
        "query_id", F.round("citation_precision", 6).alias("citation_precision"), F.round("citation_recall", 6).alias("citation_recall"))


def answer_score(spark: SparkSession, d: str) -> DataFrame:
    """Words as facts: an answer turn against the turn before it and the whole first turn."""
    facts = F.array_distinct(tx.words(F.col("text")))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", facts.alias("facts"))
    said = turns.select("conv_id", "turn", F.col("facts").alias("stated"), F.col("role"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("facts").alias("expected"))
    first = turns.filter("turn = 0").select("conv_id", F.col("facts").alias("supported"))
    answers = said.join(before, ["conv_id", "turn"]).join(first, "conv_id").select(
        F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "expected", "stated", "supported",
        (F.col("conv_id") % 3 == 0).alias("should_refuse"), (F.col("role") == "user").alias("refused"))
    return evaluate.answer_scores(answers).select(
        "answer_id", F.round("correctness", 6).alias("correctness"), F.round("faithfulness", 6).alias("faithfulness"), "refusal_correct")


def scenario_report(spark: SparkSession, d: str) -> DataFrame:
    n, t = F.col("event_id"), F.col("event_type")
    results = table(spark, d, "events").select(
        (n % 50 != 7).alias("passed"), F.when(t == "click", "sql").alias("tool_expected"),
        F.when(n % 40 == 3, "api").otherwise("sql").alias("tool_selected"), F.when(n % 5 == 0, n % 30 != 10).alias("parameters_valid"),
        F.when(t == "view", "no_evidence").when(t == "signup", "partial_evidence").otherwise("sufficient").alias("expected_status"),
        F.when(n % 60 == 5, "sufficient").when(t == "view", "no_evidence").when(t == "signup", "partial_evidence").otherwise("sufficient").alias("actual_status"),
        (F.lit(4) + n % 3).alias("important"), (F.lit(4) + n % 3 - F.when(n % 25 == 0, 1).otherwise(0)).alias("cited"),
        (F.lit(3) + n % 3 + F.when(n % 4 > 0, 1).otherwise(0)).alias("grounded"),
        (t == "error").alias("safety_critical"), ((t == "error") & (n % 1999 == 0)).alias("violation"))
    return evaluate.scenario_report(results).select(
        *[F.round(c, 6).alias(c) for c in evaluate.SCENARIO_MINIMUM], "violations", "gate_passed")


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every market segment is a release; its metrics come from its customers' balances."""
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("release")).agg(
        F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("share"),
        F.count_if(F.col("c_acctbal") < -990).cast("double").alias("low"))
    pairs = {
        "cross_tenant_violations": F.lit(0.0), "critical_security_violations": F.when(F.col("release") == "MACHINERY", F.lit(2.0)).otherwise(0.0),
        "recovery_failures": F.when(F.col("release") != "BUILDING", F.lit(0.0)), "retrieval_recall_at_10": F.col("share"),
        "answer_faithfulness": F.col("share") + 0.05, "citation_recall": F.col("share") + 0.1, "internal_error_rate": F.col("low") / 1000}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in pairs.items()]))
    metrics = c.select("release", rows.alias("m")).select("release", "m.*").filter("value is not null")
    return evaluate.release_gate(metrics)


def dataset_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    records = table(spark, d, "documents").select(
        F.when(n % 101 == 5, "").when(n % 50 == 9, F.concat(F.lit("r"), n - 1)).otherwise(F.concat(F.lit("r"), n)).alias("id"),
        F.when(n % 70 == 11, "holdout").otherwise(F.col("lang")).alias("split"), F.when(n % 90 != 13, "CC0").alias("license"))
    return files.dataset_violations(records, ["en", "fr", "de", "es", "it"])


def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """The documents as JSON lines in the shared folder, scanned with a declared schema."""
    path = shared_dir(spark, "dataset")
    table(spark, d, "documents").select(
        F.concat(F.lit("r"), "doc_id").alias("id"), F.col("lang").alias("split"), F.lit("CC0").alias("license"), F.col("source").alias("task"), "text"
    ).write.json(path)
    return files.jsonl(spark, path).select("id", "split", "license", "task", F.sha2("text", 256).alias("sha256"))


def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """The release gate written as a JSON report and read back."""
    path = shared_dir(spark, "report")
    sinks.write_report(release_gate(spark, d), path)
    return spark.read.schema("failures string, passed boolean, release string").json(path)


def trace_store(spark: SparkSession, d: str) -> DataFrame:
    """Traces written by tenant and expiry date; expired days are whole folders and are pruned."""
    path = shared_dir(spark, "traces")
    sinks.append_traces(table(spark, d, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), F.concat(F.lit("tr"), "event_id").alias("trace_id"),
        (F.col("ts").cast("timestamp") + F.expr("interval 30 days")).alias("expires_at")), path)
    kept = spark.read.parquet(path).filter(F.col("expiry_date") >= F.lit("2024-02-06").cast("date"))
    return kept.groupBy("tenant_id", F.date_format("expiry_date", "yyyy-MM-dd").alias("expiry_date")).agg(F.count(F.lit(1)).alias("traces"))


def ablation(spark: SparkSession, d: str) -> DataFrame:
    corpus = retrieval.Corpus(spark, d)
    fused = materialized(retrieval.fused(corpus), "fused")  # holds the ranks of both channels
    text, vector = (fused.filter(f"{r} IS NOT NULL") for r in ("full_text_rank", "vector_rank"))
    reranked = rank.rerank(retrieval.score_candidates(fused))
    shape = lambda df, r: df.select("query_id", F.col(r).alias("rank"), F.col("document_id").alias("item_id"))
    runs = {"text": shape(text, "full_text_rank"), "vector": shape(vector, "vector_rank"), "hybrid": shape(fused, "fusion_rank"), "reranked": shape(reranked, "rerank_rank")}
    rels = derived.qrels(spark, d).withColumnRenamed("document_id", "item_id")
    return evaluate.ablation(corpus.queries, runs, rels, K).select("channel", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


QUERIES = {
    f.__name__: f for f in (
        idempotent_commands, status_replay, illegal_transitions, replay_summary, publish_versions, published_tables, rollback_check,
        soft_delete, restore_check, purge_due, reconcile, reconcile_repair, batch_rollup, outbox_due, retry_plan, budget_breach, run_cost,
        active_memories, mrr, citation_pr, answer_score, scenario_report, release_gate, dataset_violations, jsonl_scan, report_sink, trace_store, ablation)
} | {
    "precision_at_k": _metric(evaluate.precision_at_k, K, columns=("precision",)),
    "recall_at_k": _metric(evaluate.recall_at_k, K, columns=("recall",)),
    "ndcg_at_k": _metric(evaluate.ndcg_at_k, K, columns=("ndcg",)),
    "ranking_binary": _metric(evaluate.binary_ranking, K, columns=("recall", "reciprocal_rank", "ndcg")),
}

# ---- check SQL ------------------------------------------------------------------------------
define("status_events", """
    SELECT user_id AS entity_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
           CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'deleted' WHEN event_type = 'click' THEN 'ingesting' WHEN event_type = 'view' THEN 'ready'
                WHEN event_type = 'purchase' THEN 'failed' WHEN event_type = 'signup' THEN 'superseded' ELSE 'ingesting' END AS status FROM events""")
define("legal_edges", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, targets in lifecycle.VERSION_EDGES.items() for b in targets) + ") t(a, b)")
_STEP = "CASE WHEN EXISTS (SELECT 1 FROM legal_edges l WHERE l.a = {state} AND l.b = e.status) THEN e.status ELSE {state} END"
define("walk0", """SELECT entity_id, seq, i, 'registered' AS before, status FROM status_events WHERE i = 1""")
define("walk", """
    SELECT entity_id, seq, i, before, status, CASE WHEN before || '>' || status IN (SELECT a || '>' || b FROM legal_edges) THEN status ELSE before END AS after FROM walk0
    UNION ALL
    SELECT e.entity_id, e.seq, e.i, w.after, e.status, CASE WHEN w.after || '>' || e.status IN (SELECT a || '>' || b FROM legal_edges) THEN e.status ELSE w.after END
    FROM walk w JOIN status_events e ON e.entity_id = w.entity_id AND e.i = w.i + 1""")
define("walked", """
    SELECT entity_id, seq, before AS from_status, status AS to_status, after,
           CASE WHEN before = status THEN 'unchanged' WHEN after = status THEN 'applied' ELSE 'document_version_transition_invalid' END AS outcome FROM walk""")
define("ops", """
    SELECT 'op' || o_orderkey AS operation_id, o_orderkey AS k, 'd' || o_custkey AS document_id, 'd' || o_custkey || CASE WHEN o_orderkey % 7 = 6 THEN '_v2' ELSE '_v1' END AS document_version_id,
           1 + o_orderkey % 3 AS expected_revision, 1 + o_orderkey % 5 AS fencing_token, o_orderdate AS updated_at,
           CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'failed' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 1 THEN 'dead_letter'
                WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'running' END AS status FROM orders""")
_CHECKED = """
    SELECT o.operation_id, o.document_id, o.document_version_id, o.fencing_token,
           CASE WHEN d.document_id IS NULL OR v.document_id IS NULL THEN 'not_found' WHEN d.status <> 'active' THEN 'document_deleted'
                WHEN d.revision <> o.expected_revision THEN 'document_revision_conflict' {empty} ELSE 'published' END AS o1
    FROM ops o LEFT JOIN kb_documents d ON d.document_id = o.document_id LEFT JOIN kb_versions v ON v.document_version_id = o.document_version_id"""
define("publish_checked", _CHECKED.format(empty="WHEN o.document_version_id NOT IN (SELECT document_version_id FROM chunks) THEN 'lifecycle_candidate_empty'"))
define("publish_simple", _CHECKED.format(empty=""))
_WINNERS = """
    SELECT *, CASE WHEN o1 = 'published' AND row_number() OVER (PARTITION BY document_id ORDER BY o1 = 'published' DESC, fencing_token DESC, operation_id DESC) > 1
                   THEN 'document_revision_conflict' ELSE o1 END AS outcome FROM """
define("usage_rows", f"""
    SELECT conv_id AS run_id, turn AS seq, CAST(ceil(length(text) / 4.0) AS BIGINT) AS i, CAST(ceil(length(text) / 8.0) AS BIGINT) AS g, role = 'user' AS r, turn % 3 = 2 AS t,
           CASE WHEN turn % 5 = 4 THEN 'unknown' WHEN role = 'system' OR conv_id % 4 = 0 THEN 'local' ELSE 'known' END AS cost_status,
           (ceil(length(text) / 4.0) * {RATE_IN} + ceil(length(text) / 8.0) * {RATE_OUT})::DOUBLE / 1000000 AS cost FROM conversations""")
define("usage_totals", """
    SELECT run_id, seq, count(*) OVER w AS calls, sum(i + g) OVER w AS total, sum(g) OVER w AS generated, sum(CASE WHEN cost_status = 'known' THEN cost ELSE 0 END) OVER w AS known,
           sum(CASE WHEN r THEN 1 ELSE 0 END) OVER w AS rounds, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER w AS tools
    FROM usage_rows WINDOW w AS (PARTITION BY run_id ORDER BY seq)""")
define("consent_state", """
    SELECT user_id, max(CASE WHEN event_type = 'error' THEN ts END) AS revoked, max_by(event_type, ts) = 'signup' AS enabled FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1""")
define("run10", f"SELECT query_id, rank, document_id AS item_id FROM text_hits WHERE rank <= {K}")
define("judged", "SELECT r.*, q.relevance FROM run10 r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.document_id = r.item_id")
define("wanted", "SELECT query_id, count(*) AS n FROM qrels GROUP BY 1")
define("ideal_dcg", f"""
    SELECT query_id, sum((pow(2, relevance) - 1) / log2(p + 1)) AS ideal FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, document_id) AS p FROM qrels) WHERE p <= {K} GROUP BY 1""")
define("channel_runs", """
    SELECT 'text' AS channel, query_id, rank, document_id FROM text_hits UNION ALL SELECT 'vector', query_id, rank, document_id FROM vector_hits
    UNION ALL SELECT 'hybrid', query_id, fusion_rank, document_id FROM fused UNION ALL SELECT 'reranked', query_id, rerank_rank, document_id FROM reranked""")
_BINARY = """
    SELECT {ch} q.query_id, CASE WHEN w.n IS NULL THEN 1 ELSE coalesce(j.hits, 0) / w.n END AS recall, coalesce(1.0::DOUBLE / j.first, 0) AS reciprocal_rank,
           CASE WHEN w.n IS NULL THEN 1 ELSE coalesce(j.dcg, 0) / list_sum(list_transform(range(1, least(w.n, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg
    FROM {queries} q LEFT JOIN wanted w ON w.query_id = q.query_id
    LEFT JOIN (SELECT {ch2} r.query_id, count(*) AS hits, min(r.rank) AS first, sum(1 / log2(r.rank + 1)) AS dcg FROM {run} r JOIN qrels x ON x.query_id = r.query_id AND x.document_id = r.{item}
               WHERE r.rank <= 10 GROUP BY ALL) j ON j.query_id = q.query_id {on}"""
define("word_facts", "SELECT conv_id, turn, role, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS f FROM conversations")
define("gate_shares", """
    SELECT c_mktsegment AS release, avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) FILTER (WHERE c_acctbal < -990) AS low FROM customer GROUP BY 1""")
define("records", """
    SELECT CASE WHEN doc_id % 101 = 5 THEN '' WHEN doc_id % 50 = 9 THEN 'r' || (doc_id - 1) ELSE 'r' || doc_id END AS id,
           CASE WHEN doc_id % 70 = 11 THEN 'holdout' ELSE lang END AS split, doc_id % 90 <> 13 AS licensed FROM documents""")

GATE = query("""
        SELECT release, failures = '' AS passed, failures FROM (
            SELECT release, array_to_string(list_filter([CASE WHEN release = 'MACHINERY' THEN 'critical_security_violations' END, CASE WHEN release = 'BUILDING' THEN 'recovery_failures' END,
                   CASE WHEN share < .9 THEN 'retrieval_recall_at_10' END, CASE WHEN share + 0.05::DOUBLE < .9 THEN 'answer_faithfulness' END, CASE WHEN share + 0.1::DOUBLE < .95 THEN 'citation_recall' END,
                   CASE WHEN low / 1000 >= .01 THEN 'internal_error_rate' END], lambda x: x IS NOT NULL), ',') AS failures FROM gate_shares)""")

ORACLE = {
    "idempotent_commands": """
        SELECT key, seq, 'job_' || left(sha256(tenant || chr(31) || key), 32) AS job_id, CASE WHEN i = 1 THEN 'accepted' WHEN fp = f1 THEN 'duplicate' ELSE 'conflict' END AS outcome
        FROM (SELECT *, row_number() OVER w AS i, first_value(fp) OVER w AS f1 FROM (
            SELECT 't' || (o_custkey % 4) AS tenant, 'k' || o_custkey AS key, o_orderkey AS seq, o_orderstatus || '|' || (o_orderkey // 4000) AS fp FROM orders) WINDOW w AS (PARTITION BY key ORDER BY seq))""",
    "status_replay": query("SELECT entity_id, seq, from_status, to_status, outcome FROM walked"),
    "illegal_transitions": query("SELECT entity_id, seq, from_status, to_status FROM walked WHERE outcome LIKE '%invalid'"),
    "replay_summary": query("""
        SELECT entity_id, max_by(after, seq) AS status, count(*) FILTER (WHERE outcome = 'applied') AS revision, count(*) FILTER (WHERE outcome LIKE '%invalid') AS rejected FROM walked GROUP BY 1"""),
    "publish_versions": query("SELECT operation_id, document_version_id, outcome FROM (" + _WINNERS + "publish_checked)"),
    "published_tables": query(f"""
        SELECT v.document_version_id, CASE WHEN p.nv = v.document_version_id THEN 'ready' WHEN p.nv IS NOT NULL AND v.status = 'ready' THEN 'superseded' ELSE v.status END AS status,
               CASE WHEN p.nv <> v.document_version_id AND v.status = 'ready' THEN '2024-03-02' ELSE '' END AS purge_after
        FROM kb_versions v LEFT JOIN (SELECT document_id, document_version_id AS nv FROM ({_WINNERS} publish_simple) WHERE outcome = 'published') p ON p.document_id = v.document_id"""),
    "rollback_check": query("""
        SELECT o.operation_id, CASE WHEN v.document_id IS NULL THEN 'not_found' WHEN v.status <> 'superseded' THEN 'rollback_target_invalid' ELSE 'accepted' END AS outcome
        FROM ops o LEFT JOIN kb_versions v ON v.document_version_id = o.document_version_id"""),
    "soft_delete": query("""
        SELECT document_id, 'delete_pending' AS status, CAST(revision + CASE WHEN active THEN 1 ELSE 0 END AS INTEGER) AS revision,
               CASE WHEN active THEN '2024-03-02' ELSE strftime(purge_after, '%Y-%m-%d') END AS purge_after, CASE WHEN active THEN 'accepted' ELSE 'document_deleted' END AS outcome
        FROM kb_documents WHERE document_id IN (SELECT document_id FROM ops)"""),
    "restore_check": query("""
        SELECT o.operation_id, CASE WHEN d.document_id IS NULL THEN 'not_found'
               WHEN d.status <> 'delete_pending' OR d.purge_after <= TIMESTAMP '2024-02-01' OR v.document_id IS NULL OR (v.status = 'deleted' AND d.doc_id % 2 <> 0) THEN 'document_restore_expired'
               WHEN o.document_version_id NOT IN (SELECT document_version_id FROM chunks) THEN 'rollback_target_invalid' ELSE 'restored' END AS outcome
        FROM ops o LEFT JOIN kb_documents d ON d.document_id = o.document_id LEFT JOIN kb_versions v ON v.document_version_id = o.document_version_id"""),
    "purge_due": query("""
        SELECT object_key, min(document_id) AS document_id, count(*) AS versions FROM kb_versions
        WHERE document_id IN (SELECT document_id FROM kb_documents WHERE status = 'delete_pending' AND purge_after <= TIMESTAMP '2024-02-01') GROUP BY 1"""),
    "reconcile": query("""
        SELECT CASE WHEN d.document_id IS NULL OR v.document_id IS NULL THEN 'missing_authoritative_state' ELSE 'cross_store_drift' END AS kind, o.operation_id AS resource_id
        FROM ops o LEFT JOIN kb_documents d ON d.document_id = o.document_id LEFT JOIN kb_versions v ON v.document_version_id = o.document_version_id
        WHERE o.status IN ('pending', 'running') AND o.updated_at < TIMESTAMP '1998-01-01'
          AND (d.document_id IS NULL OR v.document_id IS NULL OR d.doc_id % 13 = 0 OR o.document_version_id LIKE '%7_v1' OR o.document_version_id NOT IN (SELECT document_version_id FROM chunks))
        UNION ALL SELECT 'outbox_due', 'ob' || event_id FROM events WHERE event_type <> 'purchase' AND ts <= TIMESTAMP '2024-01-15'
        UNION ALL SELECT 'orphan_object', object_key || '.lost' FROM kb_versions WHERE CAST(substr(document_id, 2) AS BIGINT) % 13 = 0
        UNION ALL SELECT DISTINCT 'orphan_projection', document_version_id || 'x' FROM chunks WHERE document_version_id LIKE '%7_v1'
        UNION ALL SELECT 'expired_physical_cleanup', document_id FROM kb_documents WHERE status = 'delete_pending' AND purge_after <= TIMESTAMP '2024-01-15'"""),
    "reconcile_repair": query("""
        SELECT DISTINCT 'projection' AS kind, document_version_id AS resource_id FROM chunks WHERE document_version_id NOT LIKE '%7_v1'
        UNION ALL SELECT 'object', object_key FROM kb_versions WHERE CAST(substr(document_id, 2) AS BIGINT) % 13 <> 0"""),
    "batch_rollup": query("""
        SELECT batch_id, total, succeeded, failed, cancelled, CASE WHEN succeeded + failed + cancelled < total THEN 'running' WHEN cancelled = total THEN 'cancelled' WHEN succeeded = total THEN 'succeeded'
               WHEN succeeded > 0 THEN 'partial_success' ELSE 'failed' END AS status
        FROM (SELECT 'b' || (k // 3) AS batch_id, count(*) AS total, count(*) FILTER (WHERE s = 'succeeded') AS succeeded, count(*) FILTER (WHERE s IN ('failed', 'dead_letter')) AS failed,
                     count(*) FILTER (WHERE s = 'cancelled') AS cancelled FROM (SELECT k, CASE WHEN k % 50 = 7 THEN NULL ELSE status END AS s FROM ops) GROUP BY 1)"""),
    "outbox_due": """
        SELECT 'ob' || event_id AS outbox_id, epoch_us(ts) AS due_us FROM events WHERE event_type <> 'purchase' AND ts <= TIMESTAMP '2024-02-01' ORDER BY ts, 'ob' || event_id LIMIT 100""",
    "retry_plan": """
        SELECT outbox_id, attempts, class AS failure_class, status, CASE WHEN status = 'pending' THEN delay ELSE 0 END AS delay_seconds,
               CASE WHEN status = 'pending' THEN epoch_us(TIMESTAMP '2024-02-01') + CAST(delay * 1000000 AS BIGINT) ELSE 0 END AS available_us
        FROM (SELECT *, CASE WHEN class = 'none' THEN 'published' WHEN (class = 'transient' AND attempts < 6) OR (class = 'concurrency' AND attempts < 3) THEN 'pending' ELSE 'dead_letter' END AS status FROM (
            SELECT 'ob' || event_id AS outbox_id, CAST(event_id % 7 + 1 AS INTEGER) AS attempts,
                   CASE event_type WHEN 'error' THEN ['concurrency', 'transient', 'permanent', 'unknown'][event_id % 4 + 1] WHEN 'view' THEN CASE WHEN event_id % 3 = 2 THEN 'permanent' ELSE 'transient' END ELSE 'none' END AS class,
                   CASE WHEN event_type = 'view' AND event_id % 6 = 0 THEN 300.0::DOUBLE ELSE least(300.0::DOUBLE, pow(2, event_id % 7)) END AS delay FROM events))""",
    "budget_breach": query(f"""
        SELECT run_id, seq, CASE WHEN calls > {LIMITS['model_calls']} THEN 'model_calls' WHEN total > {LIMITS['total_tokens']} THEN 'total_tokens' WHEN generated > {LIMITS['generated_tokens']} THEN 'generated_tokens'
               WHEN round(known, 9) > {LIMITS['known_cost']} THEN 'known_cost' WHEN rounds > {LIMITS['retrieval_rounds']} THEN 'retrieval_rounds' ELSE 'tool_attempts' END AS dimension
        FROM usage_totals WHERE calls > {LIMITS['model_calls']} OR total > {LIMITS['total_tokens']} OR generated > {LIMITS['generated_tokens']} OR round(known, 9) > {LIMITS['known_cost']}
              OR rounds > {LIMITS['retrieval_rounds']} OR tools > {LIMITS['tool_attempts']}
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1"""),
    "run_cost": query("""
        SELECT run_id, round(sum(CASE WHEN cost_status = 'known' THEN cost ELSE 0 END), 9) AS known_cost_usd, CAST(sum(i + g) AS BIGINT) AS total_tokens,
               CASE WHEN bool_or(cost_status = 'unknown') THEN 'unknown' WHEN bool_or(cost_status = 'known') THEN 'known' ELSE 'local' END AS cost_status FROM usage_rows GROUP BY 1"""),
    "active_memories": query("""
        SELECT m.user_id, m.event_id FROM events m JOIN consent_state c ON c.user_id = m.user_id AND c.enabled
        WHERE m.event_type = 'view' AND m.event_id % 9 <> 0 AND m.event_id % 10 <> 1 AND m.ts + INTERVAL 20 DAY > TIMESTAMP '2024-02-01' AND (c.revoked IS NULL OR m.ts > c.revoked)
          AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = m.user_id AND s.event_type = 'signup' AND s.ts <= m.ts AND (c.revoked IS NULL OR s.ts > c.revoked))"""),
    "mrr": query("""
        SELECT round(avg(coalesce(1.0::DOUBLE / f.first, 0)), 6) AS mrr FROM queries q LEFT JOIN (
            SELECT h.query_id, min(rank) AS first FROM text_hits h JOIN qrels r ON r.query_id = h.query_id AND r.document_id = h.document_id GROUP BY 1) f ON f.query_id = q.query_id"""),
    "citation_pr": query("""
        SELECT q.query_id, round(CASE WHEN coalesce(p.n, 0) = 0 AND coalesce(w.n, 0) = 0 THEN 1 ELSE coalesce(b.n, 0) / greatest(1, coalesce(p.n, 0)) END, 6) AS citation_precision,
               round(CASE WHEN coalesce(w.n, 0) = 0 THEN 1 ELSE coalesce(b.n, 0) / w.n END, 6) AS citation_recall
        FROM queries q LEFT JOIN wanted w ON w.query_id = q.query_id
        LEFT JOIN (SELECT query_id, count(DISTINCT item_id) AS n FROM run10 GROUP BY 1) p ON p.query_id = q.query_id
        LEFT JOIN (SELECT query_id, count(DISTINCT item_id) AS n FROM judged WHERE relevance IS NOT NULL GROUP BY 1) b ON b.query_id = q.query_id"""),
    "answer_score": query("""
        SELECT s.conv_id || ':' || s.turn AS answer_id, round(len(list_intersect(s.f, b.f)) / greatest(1, len(b.f)), 6) AS correctness,
               round(len(list_intersect(s.f, o.f)) / greatest(1, len(s.f)), 6) AS faithfulness, (s.conv_id % 3 = 0) = (s.role = 'user') AS refusal_correct
        FROM word_facts s JOIN word_facts b ON b.conv_id = s.conv_id AND b.turn = s.turn - 1 JOIN word_facts o ON o.conv_id = s.conv_id AND o.turn = 0"""),
    "scenario_report": """
        SELECT * EXCLUDE (unsafe), violations = 0 AND unsafe = 0 AND overall_pass_rate >= .9 AND tool_validity >= .9 AND evidence_accuracy >= .95 AND citation_coverage >= .95 AND groundedness >= .9 AS gate_passed FROM (
            SELECT round(count(*) FILTER (WHERE event_id % 50 <> 7) / count(*), 6) AS overall_pass_rate,
                   round(count(*) FILTER (WHERE event_type = 'click' AND event_id % 40 <> 3 AND NOT (event_id % 5 = 0 AND event_id % 30 = 10)) / count(*) FILTER (WHERE event_type = 'click'), 6) AS tool_validity,
                   round(count(*) FILTER (WHERE event_type IN ('view', 'signup') AND event_id % 60 <> 5) / count(*) FILTER (WHERE event_type IN ('view', 'signup')), 6) AS evidence_accuracy,
                   round(sum(4 + event_id % 3 - CASE WHEN event_id % 25 = 0 THEN 1 ELSE 0 END) / sum(4 + event_id % 3), 6) AS citation_coverage,
                   round(sum(3 + event_id % 3 + CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END) / sum(4 + event_id % 3), 6) AS groundedness,
                   count(*) FILTER (WHERE event_type = 'error' AND event_id % 1999 = 0) AS violations, count(*) FILTER (WHERE event_type = 'error' AND event_id % 50 = 7) AS unsafe FROM events)""",
    "release_gate": GATE,
    "report_sink": GATE,
    "dataset_violations": query("""
        SELECT 'missing_id' AS violation, '' AS item FROM records WHERE id = ''
        UNION ALL SELECT 'duplicate_id', id FROM records WHERE id <> '' GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'invalid_split', id FROM records WHERE split NOT IN ('en', 'fr', 'de', 'es', 'it')
        UNION ALL SELECT 'license_missing', id FROM records WHERE NOT licensed
        UNION ALL SELECT 'split_without_records', s FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS s) WHERE s NOT IN (SELECT split FROM records)"""),
    "jsonl_scan": "SELECT 'r' || doc_id AS id, lang AS split, 'CC0' AS license, source AS task, sha256(text) AS sha256 FROM documents",
    "trace_store": """
        SELECT 't' || (user_id % 4) AS tenant_id, strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d') AS expiry_date, count(*) AS traces FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-06' GROUP BY ALL""",
    "ablation": query("""
        SELECT channel, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ("""
        + _BINARY.format(ch="q.channel,", queries="(SELECT channel, query_id FROM queries, (SELECT unnest(['text', 'vector', 'hybrid', 'reranked']) AS channel))", ch2="r.channel,",
                         run="channel_runs", item="document_id", on="AND j.channel = q.channel") + ") GROUP BY 1"),
    "precision_at_k": query(f"""
        SELECT q.query_id, round(count(j.relevance) / {K}, 6) AS precision FROM queries q LEFT JOIN judged j ON j.query_id = q.query_id GROUP BY 1"""),
    "recall_at_k": query("""
        SELECT q.query_id, round(CASE WHEN w.n IS NULL THEN CASE WHEN count(j.item_id) = 0 THEN 1 ELSE 0 END ELSE count(DISTINCT CASE WHEN relevance IS NOT NULL THEN j.item_id END) / w.n END, 6) AS recall
        FROM queries q LEFT JOIN judged j ON j.query_id = q.query_id LEFT JOIN wanted w ON w.query_id = q.query_id GROUP BY q.query_id, w.n"""),
    "ndcg_at_k": query("""
        SELECT q.query_id, round(CASE WHEN coalesce(i.ideal, 0) = 0 THEN 0 ELSE coalesce(sum((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1)), 0) / i.ideal END, 6) AS ndcg
        FROM queries q LEFT JOIN judged j ON j.query_id = q.query_id LEFT JOIN ideal_dcg i ON i.query_id = q.query_id GROUP BY q.query_id, i.ideal"""),
    "ranking_binary": query("SELECT query_id, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM ("
                            + _BINARY.format(ch="", queries="queries", ch2="", run="run10", item="item_id", on="") + ")"),
}
