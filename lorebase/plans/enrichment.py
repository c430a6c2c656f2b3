"""Registered enrichment, graph and temporal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import enrich, graph, temporal
from lorebase.plans.sqlkit import define, query, strip
from lorebase.sources import derived
from lorebase.sources.tables import spread, table

SUMMARY_WORDS = 40
WINDOW_SECONDS = 86_400


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return derived.chunks(spark, d).select("chunk_id", enrich.keywords(F.col("content")).alias("k")).select("chunk_id", "k.*")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return derived.chunks(spark, d).select("chunk_id", enrich.questions(F.col("content")).alias("q")).select("chunk_id", "q.*")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    chunks = derived.chunks(spark, d)
    columns = ["document_version_id", "level", "item", "text", "token_count"]
    short = enrich.chunk_summaries(chunks, SUMMARY_WORDS).withColumn("item", F.col("chunk_id"))
    long = enrich.document_summaries(chunks, {"document": SUMMARY_WORDS, "hierarchical": 3 * SUMMARY_WORDS}).withColumn("item", F.lit(""))
    return short.select(*columns).unionByName(long.select(*columns))


def toc(spark: SparkSession, d: str) -> DataFrame:
    links = derived.chunks(spark, d).select("document_version_id", F.explode("source_block_ids").alias("block_id"), "chunk_id")
    return enrich.table_of_contents(derived.block_rows(spark, d), links).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def artifact_id(spark: SparkSession, d: str) -> DataFrame:
    chunks = derived.chunks(spark, d).withColumn("text", enrich.keywords(F.col("content"))["text"])
    return enrich.artifacts(chunks, "keywords", "b1", F.array("chunk_id"), F.col("text")).select("chunk_id", "artifact_id")


def raptor_tree(spark: SparkSession, d: str) -> DataFrame:
    return enrich.summary_tree(derived.chunks(spark, d)).select(
        "document_version_id", "level", "position", "node_id", "text",
        F.array_join("sources", ",").alias("sources"), F.array_join("children", ",").alias("children"))


def raptor_level1(spark: SparkSession, d: str) -> DataFrame:
    return raptor_tree(spark, d).filter("level = 1")


def transcript_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document as the segments of a recording of one second per ten characters."""
    media = spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("media_id"), (F.col("n_chars") / 10).alias("duration"),
        F.filter(F.split("text", "\n"), lambda s: s != "").alias("segments"))
    return enrich.transcript_segments(media)


def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities(derived.chunks(spark, d))


def graph_entity_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_sources(derived.chunks(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(derived.chunks(spark, d))


def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.edges(derived.chunks(spark, d)))


def graph_budget(spark: SparkSession, d: str) -> DataFrame:
    return graph.budget_status(derived.chunks(spark, d), max_chunks=700, max_entities=1_100, max_edges=3_000)


def graph_query(spark: SparkSession, d: str) -> DataFrame:
    return graph.query_entities(derived.queries(spark, d), graph.entities(derived.chunks(spark, d)))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        F.col("user_id").alias("series_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_type").alias("text"))
    return temporal.timeline(events, ["series_id"], "at_us", "event_id")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return temporal.series_windows(points(spark, d), WINDOW_SECONDS)


def series_windows(spark: SparkSession, d: str) -> DataFrame:
    missing = F.lit(-1.0)
    return _windows(spark, d).select(
        "series_id", "window_index", F.unix_micros("start_at").alias("start_us"), "n", "missing",
        *[F.round(F.coalesce(c, missing), 6).alias(c) for c in temporal.FEATURES])


def similar_windows(spark: SparkSession, d: str) -> DataFrame:
    """The latest window of every series is looked up among all windows of that series."""
    windows = _windows(spark, d)
    probes = windows.groupBy("series_id").agg(F.max_by(F.struct("window_index", *temporal.FEATURES), "window_index").alias("p")).select("series_id", "p.*")
    return temporal.similar_windows(windows, probes)


def requests(spark: SparkSession, d: str) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("route"),
        F.when(failed, 500).otherwise(200).alias("status"), F.when(failed, "failed").otherwise("succeeded").alias("outcome"),
        F.col("value").alias("latency_ms"))


def error_rate_5m(spark: SparkSession, d: str) -> DataFrame:
    return temporal.error_rates(requests(spark, d)).select(
        F.unix_micros("window_start").alias("window_us"), "requests", "errors", F.round("error_rate", 6).alias("error_rate"), "alert")


def error_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return temporal.error_rates(requests(spark, d), window="1 hour", slide="15 minutes").select(
        F.unix_micros("window_start").alias("window_us"), "requests", "errors", F.round("error_rate", 6).alias("error_rate"), "alert")


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return temporal.exclusive_quantile(requests(spark, d), ["route"], "latency_ms").withColumn("p95", F.round("p95", 6))


def op_histogram(spark: SparkSession, d: str) -> DataFrame:
    return temporal.duration_histogram(requests(spark, d), ["route", "outcome"], F.col("latency_ms") / 100).withColumn(
        "sum_seconds", F.round("sum_seconds", 4))


def backlog_age(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("ts").cast("timestamp").alias("due"), (F.col("event_id") % 7 > 3).alias("pending"))
    return temporal.backlog_age(items, ["queue"], F.expr(derived.NOW), F.col("pending"), "due").withColumn("age_seconds", F.round("age_seconds", 3))


QUERIES = {
    f.__name__: f for f in (
        keywords, questions, summaries, toc, artifact_id, raptor_level1, raptor_tree, transcript_segments, graph_entities,
        graph_entity_sources, graph_edges, graph_communities, graph_budget, graph_query, timeline, series_windows, similar_windows,
        error_rate_5m, error_rate_sliding, latency_p95, op_histogram, backlog_age)
}

# ---- check SQL ------------------------------------------------------------------------------
define("keyword_tokens", """
    SELECT chunk_id, replace(lower(t), 'ß', 'ss') AS term, i FROM (
        SELECT chunk_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT chunk_id, regexp_extract_all(content, '[\\p{L}\\p{N}_]{2,}') AS ts FROM chunks))""")
define("keyword_text", """
    SELECT c.chunk_id, CASE WHEN k.n > 0 THEN k.text ELSE left(c.content, 80) END AS text, CAST(coalesce(k.n, 0) AS INTEGER) AS keyword_count
    FROM chunks c LEFT JOIN (
        SELECT chunk_id, string_agg(term, chr(10) ORDER BY r) AS text, count(*) AS n FROM (
            SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i), term) AS r FROM keyword_tokens
            WHERE term NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', '以及', '一个', '进行') GROUP BY chunk_id, term)
        WHERE r <= 10 GROUP BY 1) k ON k.chunk_id = c.chunk_id""")
define("sentences", f"""
    SELECT chunk_id, '文档对“' || left(trim(s, ' 。.!?'), 72) || '”说明了什么?' AS q, i FROM (
        SELECT chunk_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
            SELECT chunk_id, string_split(regexp_replace(content, '([。.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM chunks)) WHERE {strip('s')} <> ''""")
define("question_ranks", """
    SELECT chunk_id, q, row_number() OVER (PARTITION BY chunk_id ORDER BY min(i)) AS r FROM sentences GROUP BY chunk_id, q""")
define("chunk_words", r"""
    SELECT tenant_id, document_version_id, chunk_id, sequence, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS w FROM chunks""")
define("version_words", "SELECT document_version_id, flatten(list(w ORDER BY sequence)) AS w FROM chunk_words GROUP BY 1")
define("leaf_counts", "SELECT document_version_id, count(*) AS n FROM chunks GROUP BY 1")
_LEVEL = r"""
    SELECT document_version_id, {level} AS level, p // 2 AS p, 'raptor_b1_' || document_version_id || '_{level}_' || (p // 2) AS node_id,
           array_to_string(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY p), '\s+'), lambda w: w <> '')[1:96], ' ') AS text,
           string_agg(sources, ',' ORDER BY p) AS sources, string_agg(node_id, ',' ORDER BY p) AS children
    FROM {below} SEMI JOIN (SELECT document_version_id FROM {below} GROUP BY 1 HAVING count(*) > 1) m USING (document_version_id) GROUP BY document_version_id, p // 2"""
define("tree0", "SELECT document_version_id, 0 AS level, sequence AS p, 'raptor_leaf_' || chunk_id AS node_id, content AS text, chunk_id AS sources, '' AS children FROM chunks")
for _n in (1, 2, 3):
    define(f"tree{_n}", _LEVEL.format(level=_n, below=f"tree{_n - 1}"))
_TREE = "SELECT document_version_id, CAST(level AS INTEGER) AS level, p AS position, node_id, text, sources, children FROM "
define("mentions0", """
    SELECT tenant_id, knowledge_base_id, chunk_id, list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda z: list_position(k, z[1]) = z[2])[1:32], lambda z: z[1]) AS names
    FROM (SELECT *, regexp_extract_all(content, '[A-Z][A-Za-z0-9_-]{2,}|[一-鿿]{2,12}') AS k FROM chunks)""")
define("mentions", "SELECT tenant_id, knowledge_base_id, chunk_id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM mentions0")
define("entity_rows", "SELECT tenant_id, knowledge_base_id, name, count(*) AS n_sources, min(chunk_id) AS first_source FROM mentions GROUP BY ALL")
define("edge_rows", """
    SELECT tenant_id, knowledge_base_id, source, target, count(*) AS n_sources, min(chunk_id) AS first_source FROM (
        SELECT DISTINCT a.tenant_id, a.knowledge_base_id, a.chunk_id, least(a.name, b.name) AS source, greatest(a.name, b.name) AS target
        FROM mentions a JOIN mentions b ON b.chunk_id = a.chunk_id AND b.i = a.i + 1) GROUP BY ALL""")
define("pts", "SELECT user_id AS series_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
define("win", f"""
    SELECT p.series_id, CAST(floor((p.us - a.anchor) / {WINDOW_SECONDS}000000) AS BIGINT) AS window_index, a.anchor,
           count(value) AS n, count(*) - count(value) AS missing, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean,
           CASE WHEN count(value) >= 2 THEN (max_by(value, row(us, event_id)) FILTER (WHERE value IS NOT NULL) - min_by(value, row(us, event_id)) FILTER (WHERE value IS NOT NULL)) / (count(value) - 1) END AS trend
    FROM pts p JOIN (SELECT series_id, min(us) AS anchor FROM pts GROUP BY 1) a ON a.series_id = p.series_id GROUP BY ALL""")
define("reqs", """
    SELECT *, epoch_us(ts) AS us, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END AS bad FROM events""")
define("ordered_latency", "SELECT event_type AS route, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1")

ORACLE = {
    "keywords": query("SELECT * FROM keyword_text"),
    "questions": query("""
        SELECT c.chunk_id, coalesce(string_agg(q.q, chr(10) ORDER BY q.r), '该片段的主要信息是什么?') AS text, CAST(greatest(1, count(q.q)) AS INTEGER) AS question_count
        FROM chunks c LEFT JOIN question_ranks q ON q.chunk_id = c.chunk_id AND q.r <= 5 GROUP BY 1"""),
    "summaries": query(f"""
        SELECT document_version_id, 'chunk' AS level, chunk_id AS item, 'chunk: ' || array_to_string(w[1:{SUMMARY_WORDS}], ' ') AS text, CAST(least(len(w), {SUMMARY_WORDS}) AS INTEGER) AS token_count FROM chunk_words
        UNION ALL SELECT document_version_id, l, '', l || ': ' || array_to_string(w[1:n], ' '), CAST(least(len(w), n) AS INTEGER)
        FROM version_words, (VALUES ('document', {SUMMARY_WORDS}), ('hierarchical', {3 * SUMMARY_WORDS})) t(l, n)"""),
    "toc": query(f"""
        SELECT 'toc_' || b.document_version_id || '_' || b.n AS node_id, b.document_version_id, {strip('b.text')} AS title, CAST(len(b.heading_path) AS INTEGER) AS level,
               b.n AS "order", b.id AS block_id, b.page, coalesce(string_agg(c.chunk_id, ',' ORDER BY c.chunk_id), '') AS chunk_ids
        FROM blocks b LEFT JOIN chunks c ON c.document_version_id = b.document_version_id AND c.id = b.id WHERE b.kind = 'heading' GROUP BY ALL"""),
    "artifact_id": query("""
        SELECT c.chunk_id, 'adv_' || left(sha256(concat_ws(chr(31), 'keywords', c.tenant_id, c.document_version_id, 'b1', c.chunk_id, """ + strip("k.text") + """)), 32) AS artifact_id
        FROM chunks c JOIN keyword_text k ON k.chunk_id = c.chunk_id"""),
    "raptor_level1": query(_TREE + "tree1"),
    "raptor_tree": query(" UNION ALL ".join(f"{_TREE} tree{n}" for n in range(4))),
    "transcript_segments": """
        SELECT media_id, CAST(i - 1 AS INTEGER) AS segment, text, printf('%.3f', (i - 1) * (duration / n)) AS start_seconds, printf('%.3f', i * (duration / n)) AS end_seconds
        FROM (SELECT doc_id AS media_id, n_chars / 10.0::DOUBLE AS duration, len(s) AS n, unnest(s) AS text, generate_subscripts(s, 1) AS i
              FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS s FROM documents))""",
    "graph_entities": query("SELECT * FROM entity_rows"),
    "graph_entity_sources": query("SELECT tenant_id, knowledge_base_id, chunk_id, name FROM mentions"),
    "graph_edges": query("SELECT * FROM edge_rows"),
    "graph_communities": query("""
        SELECT DISTINCT tenant_id, knowledge_base_id, unnest([source, source, target, target]) AS vertex, unnest([source, target, source, target]) AS member FROM edge_rows"""),
    "graph_budget": query("""
        SELECT c.tenant_id, c.knowledge_base_id, n_chunks, coalesce(n_entities, 0) AS n_entities, coalesce(n_edges, 0) AS n_edges,
               CASE WHEN n_chunks > 700 THEN 'source_budget_exceeded' WHEN coalesce(n_entities, 0) > 1100 OR coalesce(n_edges, 0) > 3000 THEN 'graph_budget_exceeded' ELSE 'succeeded' END AS status
        FROM (SELECT tenant_id, knowledge_base_id, count(*) AS n_chunks FROM chunks GROUP BY ALL) c
        LEFT JOIN (SELECT tenant_id, knowledge_base_id, count(*) AS n_entities FROM entity_rows GROUP BY ALL) e ON e.tenant_id = c.tenant_id AND e.knowledge_base_id = c.knowledge_base_id
        LEFT JOIN (SELECT tenant_id, knowledge_base_id, count(*) AS n_edges FROM edge_rows GROUP BY ALL) g ON g.tenant_id = c.tenant_id AND g.knowledge_base_id = c.knowledge_base_id"""),
    "graph_query": query("""
        SELECT q.query_id, q.tenant_id, e.knowledge_base_id, e.name, e.n_sources
        FROM (SELECT DISTINCT query_id, tenant_id, lower(unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9_-]{2,}|[一-鿿]{2,12}'))) AS f FROM queries) q
        JOIN entity_rows e ON e.tenant_id = q.tenant_id AND replace(lower(e.name), 'ß', 'ss') = q.f"""),
    "timeline": "SELECT user_id AS series_id, event_id, epoch_us(ts) AS at_us, event_type AS text FROM events",
    "series_windows": query(f"""
        SELECT series_id, window_index, anchor + window_index * {WINDOW_SECONDS}000000 AS start_us, n, missing, round(coalesce(minimum, -1), 6) AS minimum,
               round(coalesce(maximum, -1), 6) AS maximum, round(coalesce(mean, -1), 6) AS mean, round(coalesce(trend, -1), 6) AS trend FROM win"""),
    "similar_windows": query("""
        SELECT series_id, probe_index, window_index, distance, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY distance, window_index) AS rank FROM (
                SELECT w.series_id, p.window_index AS probe_index, w.window_index,
                       round(sqrt(pow(coalesce(w.minimum, 0) - coalesce(p.minimum, 0), 2) + pow(coalesce(w.maximum, 0) - coalesce(p.maximum, 0), 2)
                                + pow(coalesce(w.mean, 0) - coalesce(p.mean, 0), 2) + pow(coalesce(w.trend, 0) - coalesce(p.trend, 0), 2)), 6) AS distance
                FROM win w JOIN (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY window_index DESC) = 1) p ON p.series_id = w.series_id)) WHERE rank <= 5"""),
    "error_rate_5m": query("""
        SELECT us // 300000000 * 300000000 AS window_us, count(*) AS requests, CAST(sum(bad) AS BIGINT) AS errors, round(sum(bad) / count(*), 6) AS error_rate, sum(bad) / count(*) >= 0.01 AS alert FROM reqs GROUP BY 1"""),
    "error_rate_sliding": query("""
        SELECT us // 900000000 * 900000000 - k * 900000000 AS window_us, count(*) AS requests, CAST(sum(bad) AS BIGINT) AS errors, round(sum(bad) / count(*), 6) AS error_rate, sum(bad) / count(*) >= 0.01 AS alert
        FROM reqs, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1"""),
    "latency_p95": query("""
        SELECT route, n, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (100 - ((n + 1) * 95 - j * 100)) + v[j + 1] * ((n + 1) * 95 - j * 100)) / 100 END, 6) AS p95
        FROM (SELECT *, greatest(1, least((n + 1) * 95 // 100, n - 1)) AS j FROM ordered_latency)"""),
    "op_histogram": """
        SELECT event_type AS route, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome, """
        + ", ".join(f"count(*) FILTER (WHERE value / 100 <= {b}) AS {f'le_{b:g}'.replace('.', '_')}" for b in temporal.DURATION_BOUNDS)
        + ", count(*) AS total, round(sum(value / 100), 4) AS sum_seconds FROM events GROUP BY ALL",
    "backlog_age": """
        SELECT event_type AS queue, round(age, 3) AS age_seconds, age > 300 AS stale FROM (
            SELECT event_type, coalesce(greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01') - min(CASE WHEN event_id % 7 > 3 THEN epoch_us(ts) END)) / 1000000), 0) AS age FROM events GROUP BY 1)""",
}
