"""Registered streaming queries over the raw files of a scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import predicates
from lorebase.functions.text import text_sections, words
from lorebase.operators import chunk, index, lexical
from lorebase.plans import operations
from lorebase.plans.retrieval import ORACLE as RETRIEVAL
from lorebase.plans.sqlkit import define, query, windows
from lorebase.session import shared_dir
from lorebase.sources import derived
from lorebase.sources.tables import table
from lorebase.streaming import indexing, jobs


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Every document message delivered twice: parse, chunk, embed, upsert."""
    schema = table(spark, d, "documents").schema
    once = jobs.file_stream(spark, d, "documents.parquet", schema)
    n = F.col("doc_id")
    messages = once.unionByName(jobs.file_stream(spark, d, "documents.parquet", schema)).withColumn(
        "sent_at", F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval((n % 60).cast("int")))

    def process(batch: DataFrame) -> DataFrame:
        block = lambda text, i: F.struct(
            F.concat(F.lit("b"), i).alias("id"), F.lit("text").alias("kind"), i.alias("order"), F.lit(None).cast("int").alias("level"),
            text.alias("text"), F.lit(1).alias("page"),
            F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double,space:string>").alias("box"),
            F.expr("cast(array() as array<string>)").alias("heading_path"))
        parsed = batch.select(
            F.concat(F.lit("t"), n % 4).alias("tenant_id"), F.concat(F.lit("d"), n, F.lit("_v1")).alias("document_version_id"),
            F.transform(text_sections(F.col("text")), block).alias("blocks"))
        chunks = chunk.chunk_documents(parsed, "general", limit=64, overlap=8)
        return index.embed(chunks, dims=16).select("chunk_id", "document_version_id", "sequence", "content", "token_count", "embedding")

    table_rows = jobs.ingest(
        messages, process, message_id="doc_id", event_time="sent_at", delay="90 days", keys=["chunk_id"], **jobs.locations(spark, "ingest"))
    return table_rows.select("chunk_id", "document_version_id", "sequence", "content", "token_count", F.size("embedding").alias("dims"))


def streamed_index(spark: SparkSession, d: str) -> str:
    """Every document message delivered twice, indexed by micro-batches and compacted; returns the index's folder."""
    schema = table(spark, d, "documents").schema
    files = lambda: jobs.file_stream(spark, d, "documents.parquet", schema)
    n = F.col("doc_id")
    messages = files().unionByName(files()).withColumn("document_id", F.concat(F.lit("d"), n)).withColumn(
        "sent_at", F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval((n % 60).cast("int")))
    root = shared_dir(spark, "streamed-index")
    indexing.ingest(
        messages, lambda batch: derived.chunk_rows(derived.document_rows(batch)), message_id="doc_id", event_time="sent_at", delay="90 days",
        root=root, checkpoint=shared_dir(spark, "streamed-index-checkpoint"), dims=16)
    indexing.compact(spark, root)
    return root


def stream_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The best ten chunks per query in the published generation of a streamed index.

    Postings give frequencies and lengths; the records are scanned, so no pair of a query and a chunk is shuffled.
    """
    tables = indexing.read(spark, streamed_index(spark, d))
    records, postings = tables["records"], tables["postings"]
    asked = derived.queries(spark, d).select(
        "query_id", F.array("tenant_id").alias("tenant"), F.col("knowledge_base_ids").alias("kb"), predicates.held_tokens().alias("access"),
        words(F.col("text")).alias("words"))
    held = records.filter(predicates.searchable()).select(
        F.concat_ws("|", "chunk_id", "document_id").alias("vector_id"), F.array("tenant_id").alias("tenant"),
        F.array("knowledge_base_id").alias("kb"), predicates.access_tokens().alias("access"), words(F.col("content")).alias("words"))
    terms = asked.select(F.explode("words").alias("term")).distinct()
    counted = index.document_frequencies(postings.join(F.broadcast(terms), "term"))
    n_chunks, n_words = records.count(), postings.agg(F.sum("tf")).first()[0] or 0
    hits = lexical.bm25_topk(asked, held, counted, n_chunks, n_words / max(1, n_chunks), 10, facets=("tenant", "kb", "access"))
    found = F.split("vector_id", r"\|")
    return hits.select("query_id", found[0].alias("chunk_id"), found[1].alias("document_id"), "score", "rank")


def stream_index_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage that every document reached, with its chunks in the streamed index."""
    return indexing.stages(spark, streamed_index(spark, d))


def stream_error_rate(spark: SparkSession, d: str) -> DataFrame:
    events = jobs.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    requests = events.select(F.col("ts").cast("timestamp").alias("at"), F.when(failed, 500).otherwise(200).alias("status"))
    return jobs.error_rates(requests, event_time="at", delay="10 minutes", **jobs.locations(spark, "error-rate")).select(
        F.unix_micros("window_start").alias("window_us"), "requests", "errors", F.round("error_rate", 6).alias("error_rate"), "alert")


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    events = jobs.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return jobs.replay_status(operations.status_of(events), **jobs.locations(spark, "status"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_index_search, stream_index_stages, stream_error_rate, stream_status)}

# ---- check SQL ------------------------------------------------------------------------------
define("stream_chunks", windows(
    "(SELECT 't' || (doc_id % 4) AS tenant_id, 'd' || doc_id || '_v1' AS document_version_id, 0 AS n, text FROM documents)",
    "tenant_id, document_version_id", "n", "text"))
ORACLE = {
    # the documents hold no blank line, so each is one text block b0
    "stream_ingest": query("""
        SELECT 'chk_' || left(sha256(concat_ws(chr(31), 'sha256-v1', tenant_id, document_version_id, CAST(sequence AS VARCHAR), 'b0', sha256(content))), 32) AS chunk_id,
               document_version_id, sequence, content, token_count, 16 AS dims FROM stream_chunks"""),
    "stream_index_search": RETRIEVAL["bm25_blocks"],
    "stream_index_stages": query("""
        SELECT document_id, count(chunk_id) AS chunks, '' AS error_code, CASE WHEN count(chunk_id) = 0 THEN 'empty' ELSE 'indexed' END AS stage
        FROM kb_documents LEFT JOIN chunks USING (document_id) GROUP BY 1"""),
    "stream_error_rate": query("""
        SELECT us // 300000000 * 300000000 AS window_us, count(*) AS requests, CAST(sum(bad) AS BIGINT) AS errors, round(sum(bad) / count(*), 6) AS error_rate, sum(bad) / count(*) >= 0.01 AS alert FROM reqs
        GROUP BY 1 HAVING us // 300000000 * 300000000 + 300000000 <= (SELECT max(us) - 600000000 FROM reqs)"""),
    "stream_status": query("SELECT entity_id, seq, from_status, to_status, outcome FROM walked"),
}
