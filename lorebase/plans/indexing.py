"""Registered index build and maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import ids
from lorebase.functions.vectors import hash_embedding as hashed
from lorebase.operators import index, search
from lorebase.plans.sqlkit import define, query
from lorebase.session import shared_dir
from lorebase.sources import derived, files, sinks, staging
from lorebase.sources.tables import spread, table
from lorebase.streaming import indexing

DIMS = 64


def _vector_columns(df: DataFrame, key: str) -> DataFrame:
    """Long form (key, position, value) of the non-zero entries, rounded for comparison."""
    return df.select(key, F.posexplode("embedding").alias("position", "value")).filter("value <> 0").select(
        key, "position", F.round("value", 6).alias("value")
    )


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _vector_columns(index.embed(derived.chunks(spark, d).select("chunk_id", "content"), dims=DIMS), "chunk_id")


def batch_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The user-function hook, with a length/word-count model standing in for a network."""
    chunks = derived.chunks(spark, d).select("chunk_id", "content")
    made = index.embed_with(chunks, "chunk_id", "content", lambda texts: [[len(t), t.count(" ")] for t in texts], dims=2)
    return made.select("chunk_id", F.col("embedding")[0].alias("length"), F.col("embedding")[1].alias("blanks"))


def _defective_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    versions = derived.kb_versions(spark, d).select("document_version_id", "status")
    docs = derived.kb_documents(spark, d).select(F.col("document_version_id").alias("id"), "doc_id")
    vectors = versions.select(F.col("document_version_id").alias("id"), "status").withColumn(
        "embedding", F.when(F.col("status") == "deleted", F.array_repeat(F.lit(0.0), 3)).otherwise(F.array_repeat(F.lit(0.0), 4))
    )
    lost = F.when(F.col("doc_id") % 23 == 0, F.concat("id", F.lit("_lost"))).otherwise(F.col("id"))
    return docs.select(lost.alias("id")), vectors


def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    inputs, vectors = _defective_vectors(spark, d)
    return index.embedding_coverage(inputs, vectors, "id", 4)


def _records(spark: SparkSession, d: str) -> DataFrame:
    chunks = derived.chunks(spark, d).select(
        "tenant_id", "document_id", "document_version_id", "chunk_id", "sequence", "content", "token_count")
    vectors = index.embed(derived.chunks(spark, d).select("chunk_id", "content"), dims=DIMS).drop("content")
    documents = derived.kb_documents(spark, d).select(
        "tenant_id", "document_id", "knowledge_base_id", "owner_id", "visibility", "document_deleted")
    versions = derived.kb_versions(spark, d).select(
        "tenant_id", "document_id", "document_version_id", F.col("status").alias("version_status"))
    return index.assemble_records(chunks, vectors, documents, versions, "g1")


def index_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select(
        "index_version_id", "tenant_id", "knowledge_base_id", "document_id", "document_version_id", "chunk_id",
        "owner_id", "visibility", "version_status", "active", F.size("embedding").alias("dims"), "token_count",
    )


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(derived.chunks(spark, d)).select("term", "chunk_id", "tf", "length")


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus_statistics(derived.chunks(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequencies(index.postings(derived.chunks(spark, d)))


def generation_health(spark: SparkSession, d: str) -> DataFrame:
    records = derived.chunks(spark, d).select(*index.RECORD_COLUMNS)
    expected = (
        derived.block_rows(spark, d).groupBy("tenant_id", "knowledge_base_id")
        .agg(F.count(F.lit(1)).alias("blocks"))
        .join(
            records.groupBy("tenant_id", "knowledge_base_id").agg(F.count(F.lit(1)).alias("made")),
            ["tenant_id", "knowledge_base_id"],
        )
        .select(F.lit("g1").alias("index_version_id"), "tenant_id", "knowledge_base_id",
                (F.col("made") + F.when(F.col("blocks") % 3 == 0, 1).otherwise(0)).alias("expected_count"))
    )
    return index.generation_health(records, expected, 2)


def _pointer_log(spark: SparkSession, d: str) -> DataFrame:
    return derived.kb_versions(spark, d).join(
        derived.kb_documents(spark, d).select("document_id", "knowledge_base_id", "doc_id"), "document_id"
    ).select("tenant_id", "knowledge_base_id", (F.col("doc_id") * 2 + F.length("document_version_id") % 2).alias("generation"),
             F.concat(F.lit("idx_"), "document_version_id").alias("index_version_id"))


def generation_current(spark: SparkSession, d: str) -> DataFrame:
    return index.current_generation(_pointer_log(spark, d))


def index_activate(spark: SparkSession, d: str) -> DataFrame:
    """Activate version 1 of every document (absent where only version 2 is indexed)."""
    records = derived.chunks(spark, d).select("document_id", "document_version_id", "chunk_id", "active")
    chosen = derived.kb_versions(spark, d).filter(F.col("document_version_id").endswith("_v1")).select(
        "document_id", F.col("document_version_id").alias("activate_version"))
    switched, errors = index.activate(records, chosen, ["document_id"])
    return switched.select("document_id", "chunk_id", "active", F.lit("").alias("error_code")).unionByName(
        errors.select("document_id", F.lit("").alias("chunk_id"), F.lit(False).alias("active"), "error_code")
    )


def _fence_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    state = derived.kb_documents(spark, d).select(
        "document_id", F.col("document_version_id").alias("version"),
        F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 5).cast("long")).alias("token"))
    updates = table(spark, d, "orders").select(
        F.concat(F.lit("d"), "o_custkey").alias("document_id"),
        F.concat(F.lit("op"), "o_orderkey").alias("new_version"),
        (F.lit(1) + F.col("o_orderkey") % 5).cast("long").alias("new_token"))
    return state, updates


def fenced_promote(spark: SparkSession, d: str) -> DataFrame:
    return index.fenced_promote(*_fence_state(spark, d), "document_id").withColumn(
        "token", F.coalesce("token", F.lit(-1).cast("long")))


def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """Retire versions of disabled documents, then delete the deleted versions."""
    chunks = derived.chunks(spark, d).select("document_version_id", "chunk_id", "active", "document_enabled")
    versions = derived.kb_versions(spark, d).filter("status = 'deleted'").select("document_version_id")
    kept = index.delete_keys(chunks, versions, ["document_version_id"])
    disabled = chunks.filter(~F.col("document_enabled")).select("document_version_id")
    return index.retire(kept, disabled).select("chunk_id", "active")


def projection_count(spark: SparkSession, d: str) -> DataFrame:
    return index.projection_counts(derived.chunks(spark, d))


def projection_versions(spark: SparkSession, d: str) -> DataFrame:
    return index.projection_versions(derived.chunks(spark, d))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Re-index labelled documents over the existing records (last write wins)."""
    base = derived.chunks(spark, d).select(
        "tenant_id", "index_version_id", "chunk_id", "doc_id", F.length("content").alias("size"), F.lit(1).alias("write_no"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    incoming = base.join(labels, "doc_id").select(
        *[c for c in base.columns if c not in ("size", "write_no")],
        (F.col("size") + 1000).alias("size"), (F.lit(1) + F.col("quality")).cast("int").alias("write_no"))
    merged = index.upsert(base, incoming, ["tenant_id", "index_version_id", "chunk_id"], "write_no")
    return merged.select("tenant_id", "chunk_id", "doc_id", "size", "write_no")


def index_reject(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a write that names its tenant by document, some foreign, some with a cut vector."""
    written = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("t"), F.col("doc_id") % 4).alias("tenant_id"), F.concat(F.lit("t"), F.col("doc_id") % 12 % 5).alias("target"),
        F.slice(hashed(F.col("text"), DIMS), 1, F.when(F.col("doc_id") % 9 == 0, DIMS - 1).otherwise(DIMS)).alias("embedding"))
    return index.scope_violations(written, F.col("target"), DIMS).select("doc_id", "error_code")


def _generation_summary(spark: SparkSession, root: str, label: str, generation: int) -> DataFrame:
    """Counts and a checksum per scope, from the current generation's tables as read back."""
    tables = sinks.read_tables(spark, root, indexing.INDEX, indexing.TABLES)
    scope = ["tenant_id", "knowledge_base_id"]
    mark = F.conv(F.substring("chunk_id", 5, 8), 16, 10).cast("long")
    records = tables["records"].groupBy(*scope).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("active").alias("active"), F.sum(mark).alias("checksum"))
    posted = tables["postings"].groupBy(*scope).agg(F.sum("tf").alias("occurrences"))
    return records.join(posted, scope).select(
        F.lit(label).alias("state"), F.lit(generation).alias("generation"), *scope, "records", "active", "checksum", "occurrences")


def generation_publish(spark: SparkSession, d: str) -> DataFrame:
    """Index records and postings of the corpus as a generation; a merge that rejects rows as the next; two candidates that
    must not be switched to; a rollback. Returns what readers see after the merge and after the rollback."""
    root, dims = shared_dir(spark, "generations"), 16
    records = index.embed(derived.chunks(spark, d), dims=dims)
    carried = ("document_version_id", *search.SCOPE)
    build = {"records": lambda _: records, "postings": lambda done: index.postings(done["records"], carried)}
    first = sinks.publish_tables(build, spark, root, indexing.INDEX, validate=lambda t: indexing.healthy(t, indexing.counts(t["records"])))
    held = sinks.read_tables(spark, root, indexing.INDEX, indexing.TABLES)

    # a write that makes every third document inactive; of every fourth it names a foreign tenant, of every fifth it cuts the vectors
    number = F.substring("document_id", 2, 20).cast("long")
    written = held["records"].filter(number % 3 == 0).withColumns({
        "active": F.lit(False), "embedding": F.when(number % 5 == 0, F.slice("embedding", 1, dims - 1)).otherwise(F.col("embedding"))})
    error = index.scope_error(F.when(number % 4 == 0, "foreign").otherwise(F.col("tenant_id")), dims)
    accepted = written.withColumn("error_code", error).filter("error_code IS NULL").drop("error_code")
    merged = index.upsert_within(
        held["records"].withColumn("write_no", F.lit(1)), accepted.withColumn("write_no", F.lit(2)), "document_version_id",
        ["index_version_id", "chunk_id"], "write_no").drop("write_no")
    expected = indexing.counts(held["records"])
    change = {"records": lambda _: merged.select(*held["records"].columns), "postings": lambda done: index.postings(done["records"], carried)}
    check = lambda t: indexing.healthy(t, expected)
    counted = lambda records: indexing.whole(records, expected)
    second = sinks.publish_tables(change, spark, root, indexing.INDEX, first=counted, validate=check, expected_current=first)
    after_merge = staging.materialized(_generation_summary(spark, root, "merged", second), "merged-summary")

    lossy = {"records": lambda _: held["records"].filter(number % 7 != 0), "postings": build["postings"]}
    rejected = 0
    for tables, options in ((lossy, {}), (change, {"expected_current": first})):  # loses documents; was based on an old generation
        try:
            sinks.publish_tables(tables, spark, root, indexing.INDEX, first=counted, validate=check, **options)
        except ValueError:
            rejected += 1
    restored = sinks.rollback(spark, root, indexing.INDEX, first, validate=lambda place: check(
        {t: spark.read.parquet(f"{place}/{t}") for t in indexing.TABLES}))
    after_rollback = _generation_summary(spark, root, "restored", restored)
    return after_merge.unionByName(after_rollback).withColumn("rejected", F.lit(rejected))


def trace_read(spark: SparkSession, d: str) -> DataFrame:
    """Every user's traces as read by an auditor and by a viewer of tenant t1; the viewer sees no candidates."""
    traces = table(spark, d, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), F.concat(F.lit("tr"), "event_id").alias("trace_id"), F.col("event_type").alias("candidates"))
    read = [sinks.visible_traces(traces, "t1", role, ("auditor",)).withColumn("role", F.lit(role)) for role in ("auditor", "viewer")]
    return read[0].unionByName(read[1], allowMissingColumns=True).select("role", "trace_id", F.coalesce("candidates", F.lit("")).alias("candidates"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    c = derived.chunks(spark, d)
    return c.select(
        "document_version_id",
        ids.artifact_id(F.lit("summaries"), F.col("tenant_id"), F.col("document_version_id"), F.lit("b1"),
                        F.array("chunk_id"), F.col("content")).alias("artifact_id"),
    )


def artifact_delete_version(spark: SparkSession, d: str) -> DataFrame:
    gone = derived.kb_versions(spark, d).filter("status = 'deleted'").select("document_version_id")
    return index.delete_keys(artifacts(spark, d), gone, ["document_version_id"])


def trace_expire(spark: SparkSession, d: str) -> DataFrame:
    """Traces (one per event) live thirty days; what is still kept at the end of January."""
    traces = table(spark, d, "events").select(
        F.concat(F.lit("tr"), "event_id").alias("trace_id"),
        (F.col("ts").cast("timestamp") + F.expr("interval 30 days")).alias("expires_at"))
    return sinks.live_traces(traces, F.expr(derived.NOW) + F.expr("interval 5 days")).select(
        "trace_id", F.unix_micros("expires_at").alias("expires_us"))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Backup manifest of all versions against the present objects (changed, lost, extra)."""
    versions = derived.kb_versions(spark, d).select(F.col("object_key").alias("path"), "size_bytes", F.col("content_hash").alias("sha256"), "status")
    recorded = versions.drop("status")
    found = versions.select(
        F.when(F.col("status") == "deleted", F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"),
        "size_bytes",
        F.when(F.col("status") == "superseded", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return files.manifest_diff(recorded, found)


def object_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the table files themselves."""
    return files.objects(spark, d, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256")


QUERIES = {
    "hash_embedding": hash_embedding,
    "batch_embedding": batch_embedding,
    "embedding_coverage": embedding_coverage,
    "index_records": index_records,
    "postings": postings,
    "corpus_statistics": corpus_statistics,
    "document_frequencies": document_frequencies,
    "generation_health": generation_health,
    "generation_current": generation_current,
    "index_activate": index_activate,
    "fenced_promote": fenced_promote,
    "index_delete": index_delete,
    "projection_count": projection_count,
    "projection_versions": projection_versions,
    "index_upsert": index_upsert,
    "index_reject": index_reject,
    "generation_publish": generation_publish,
    "trace_read": trace_read,
    "artifact_delete_version": artifact_delete_version,
    "trace_expire": trace_expire,
    "manifest_diff": manifest_diff,
    "object_checksums": object_checksums,
}

# ---- check SQL ------------------------------------------------------------------------------
define("terms", """
    SELECT chunk_id, document_id, tenant_id, knowledge_base_id, owner_id, visibility, allowed_actor_ids, allowed_roles,
           active, document_enabled, document_deleted, length, term, count(*) AS tf
    FROM (SELECT *, unnest(ts) AS term, len(ts) AS length
          FROM (SELECT *, regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS ts FROM chunks))
    GROUP BY ALL""")
define("term_slots", f"""
    SELECT chunk_id, ('0x' || left(sha256(term), 8))::BIGINT % {DIMS} AS position, sum(tf) AS n FROM terms GROUP BY ALL""")
define("chunk_norms", "SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM term_slots GROUP BY 1")
define("pointer_log", """
    SELECT v.tenant_id, d.knowledge_base_id, d.doc_id * 2 + length(v.document_version_id) % 2 AS generation, 'idx_' || v.document_version_id AS index_version_id
    FROM kb_versions v JOIN kb_documents d ON d.document_id = v.document_id""")
define("fence_best", """
    SELECT document_id, max(row(new_token, new_version)) AS u FROM (
        SELECT 'd' || o_custkey AS document_id, 'op' || o_orderkey AS new_version, 1 + o_orderkey % 5 AS new_token FROM orders)
    GROUP BY 1""")

ORACLE = {
    "hash_embedding": query("""
        SELECT s.chunk_id, CAST(s.position AS INTEGER) AS position, round(s.n / c.norm, 6) AS value
        FROM term_slots s JOIN chunk_norms c ON c.chunk_id = s.chunk_id"""),
    "batch_embedding": query("""
        SELECT chunk_id, CAST(length(content) AS DOUBLE) AS length, CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS blanks FROM chunks"""),
    "embedding_coverage": query("""
        SELECT id, violation FROM (
            SELECT CASE WHEN doc_id % 23 = 0 THEN document_version_id || '_lost' ELSE document_version_id END AS id, 'missing_vector' AS violation FROM kb_documents WHERE doc_id % 23 = 0
            UNION ALL SELECT document_version_id, 'unknown_input' FROM kb_versions
              WHERE document_version_id NOT IN (SELECT document_version_id FROM kb_documents WHERE doc_id % 23 <> 0)
            UNION ALL SELECT document_version_id, 'wrong_dimensions' FROM kb_versions WHERE status = 'deleted')"""),
    "index_records": query(f"""
        SELECT 'g1' AS index_version_id, c.tenant_id, c.knowledge_base_id, c.document_id, c.document_version_id, c.chunk_id, c.owner_id,
               c.visibility, v.status AS version_status, false AS active, {DIMS} AS dims, c.token_count
        FROM chunks c JOIN kb_versions v ON v.document_version_id = c.document_version_id"""),
    "postings": query("SELECT term, chunk_id, tf, length FROM terms"),
    "corpus_statistics": query("""
        SELECT count(*) AS n_chunks, round(avg(len(regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'))), 6) AS avg_length FROM chunks"""),
    "document_frequencies": query("SELECT term, count(*) AS df FROM terms GROUP BY 1"),
    "generation_health": query("""
        SELECT 'g1' AS index_version_id, b.tenant_id, b.knowledge_base_id, made + CASE WHEN blocks % 3 = 0 THEN 1 ELSE 0 END AS expected_count,
               made AS chunk_count, '2:' || made || ':11' AS checksum, blocks % 3 <> 0 AS healthy
        FROM (SELECT tenant_id, knowledge_base_id, count(*) AS blocks FROM blocks0 GROUP BY ALL) b
        JOIN (SELECT tenant_id, knowledge_base_id, count(*) AS made FROM chunks GROUP BY ALL) c
          ON c.tenant_id = b.tenant_id AND c.knowledge_base_id = b.knowledge_base_id"""),
    "generation_current": query("""
        SELECT tenant_id, knowledge_base_id, max_by(index_version_id, row(generation, index_version_id)) AS index_version_id, max(generation) AS generation
        FROM pointer_log GROUP BY 1, 2"""),
    "index_activate": query("""
        SELECT document_id, chunk_id, CASE WHEN document_version_id LIKE '%_v1' THEN true ELSE active END AS active, '' AS error_code FROM chunks
        UNION ALL SELECT document_id, '', false, 'index_activation_empty' FROM kb_documents
        WHERE document_id NOT IN (SELECT document_id FROM chunks WHERE document_version_id LIKE '%_v1')"""),
    "fenced_promote": query("""
        SELECT document_id, CASE WHEN applied THEN u[2] ELSE version END AS version,
               coalesce(CASE WHEN applied THEN u[1] ELSE token END, -1) AS token, applied
        FROM (SELECT s.*, b.u, coalesce(b.u IS NOT NULL AND (token IS NULL OR token <= b.u[1]), false) AS applied
              FROM (SELECT document_id, document_version_id AS version, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 END AS token FROM kb_documents) s
              LEFT JOIN fence_best b ON b.document_id = s.document_id)"""),
    "index_delete": query("""
        SELECT chunk_id, active AND document_version_id NOT IN (SELECT document_version_id FROM chunks WHERE NOT document_enabled) AS active FROM chunks
        WHERE document_version_id NOT IN (SELECT document_version_id FROM kb_versions WHERE status = 'deleted')"""),
    "projection_count": query("SELECT document_version_id, count(*) AS chunk_count FROM chunks WHERE NOT coalesce(document_deleted, false) GROUP BY 1"),
    "projection_versions": query("SELECT DISTINCT knowledge_base_id, document_id, document_version_id FROM chunks"),
    "index_upsert": query("""
        SELECT c.tenant_id, c.chunk_id, c.doc_id, CASE WHEN l.doc_id IS NULL THEN length(content) ELSE length(content) + 1000 END AS size,
               CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS write_no
        FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id"""),
    "index_reject": """
        SELECT doc_id, CASE WHEN doc_id % 4 <> doc_id % 12 % 5 THEN 'index_scope_mismatch' ELSE 'index_dimension_mismatch' END AS error_code
        FROM documents WHERE doc_id % 4 <> doc_id % 12 % 5 OR doc_id % 9 = 0""",
    "generation_publish": query("""
        SELECT * FROM (WITH named AS (
            SELECT *, CAST(substr(document_id, 2) AS BIGINT) AS n, ('0x' || substr(chunk_id, 5, 8))::BIGINT AS mark,
                   len(regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS words FROM chunks
        ), states AS (
            SELECT 'merged' AS state, 2 AS generation, tenant_id, knowledge_base_id, mark, words,
                   active AND NOT (n % 3 = 0 AND n % 4 <> 0 AND n % 5 <> 0) AS active FROM named
            UNION ALL SELECT 'restored', 3, tenant_id, knowledge_base_id, mark, words, active FROM named
        )
        SELECT state, generation, tenant_id, knowledge_base_id, count(*) AS records, count(*) FILTER (WHERE active) AS active,
               CAST(sum(mark) AS BIGINT) AS checksum, CAST(sum(words) AS BIGINT) AS occurrences, 2 AS rejected FROM states GROUP BY ALL)"""),
    "trace_read": """
        SELECT role, 'tr' || event_id AS trace_id, CASE role WHEN 'auditor' THEN event_type ELSE '' END AS candidates
        FROM events, (SELECT unnest(['auditor', 'viewer']) AS role) WHERE user_id % 4 = 1""",
    "artifact_delete_version": query("""
        SELECT document_version_id, 'adv_' || left(sha256(concat_ws(chr(31), 'summaries', tenant_id, document_version_id, 'b1', chunk_id, content)), 32) AS artifact_id
        FROM chunks WHERE document_version_id NOT IN (SELECT document_version_id FROM kb_versions WHERE status = 'deleted')"""),
    "trace_expire": """
        SELECT 'tr' || event_id AS trace_id, epoch_us(ts + INTERVAL 30 DAY) AS expires_us FROM events
        WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-06'""",
    "manifest_diff": query("""
        SELECT object_key AS path, 'missing' AS state FROM kb_versions WHERE status = 'deleted'
        UNION ALL SELECT object_key || '.bak', 'extra' FROM kb_versions WHERE status = 'deleted'
        UNION ALL SELECT object_key, 'changed' FROM kb_versions WHERE status = 'superseded'"""),
}
