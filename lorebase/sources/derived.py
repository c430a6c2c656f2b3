"""Knowledge-base tables derived from the raw tables.

These stand in for the operational stores of a knowledge base. Every derivation is row-local on a
whole raw table (no row is left out, no text is cut), so the work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import arrays, ids, text as tx
from lorebase.operators import chunk
from lorebase.sources.tables import spread, table

EPOCH = "timestamp'2024-01-01 00:00:00'"
NOW = "timestamp'2024-02-01 00:00:00'"


def _days(col: Column) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(col.cast("int"))


def kb_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_rows(spread(table(spark, d, "documents")))


def document_rows(documents: DataFrame) -> DataFrame:
    """Document records of raw documents, be they a table or a batch of messages."""
    n = F.col("doc_id")
    deleted = n % 11 == 0
    version = F.concat(F.lit("d"), n, F.when(n % 5 == 0, "_v2").otherwise("_v1"))
    return documents.select(
        "doc_id",
        F.concat(F.lit("t"), n % 4).alias("tenant_id"),
        F.col("source").alias("knowledge_base_id"),
        F.concat(F.lit("d"), n).alias("document_id"),
        version.alias("document_version_id"),
        F.when(~deleted, version).alias("current_version_id"),
        F.concat(F.lit("u"), n % 7).alias("owner_id"),
        F.when(n % 3 == 0, "private").otherwise("tenant").alias("visibility"),
        F.array(F.concat(F.lit("u"), (n + 1) % 7)).alias("allowed_actor_ids"),
        F.when(n % 9 == 0, F.array(F.lit("editor")))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("allowed_roles"),
        F.when(deleted, "delete_pending").otherwise("active").alias("status"),
        (~deleted).alias("active"),
        F.when(n % 13 == 0, F.lit(None)).otherwise(n % 17 != 0).alias("document_enabled"),
        F.when(n % 19 == 0, F.lit(None)).otherwise(deleted).alias("document_deleted"),
        (F.lit(1) + n % 3).cast("int").alias("revision"),
        F.when(n % 4 == 0, "text/html").when(n % 4 == 1, "text/markdown").otherwise("text/plain").alias("media_type"),
        F.col("lang").alias("language"),
        _days(n % 60).alias("created_at"),
        F.when(deleted, _days(n % 60)).alias("purge_after"),
        F.col("text"),
    )


def kb_versions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    count = F.when(n % 5 == 0, 2).otherwise(1)
    return (
        table(spark, d, "documents")
        .select("doc_id", "text", F.explode(F.sequence(F.lit(1), count)).alias("number"), count.alias("newest"))
        .select(
            F.concat(F.lit("t"), n % 4).alias("tenant_id"),
            F.concat(F.lit("d"), n).alias("document_id"),
            F.concat(F.lit("d"), n, F.lit("_v"), F.col("number")).alias("document_version_id"),
            F.when(n % 11 == 0, "deleted")
            .when(F.col("number") < F.col("newest"), "superseded")
            .otherwise("ready")
            .alias("status"),
            F.sha2(F.concat_ws("#", F.col("number").cast("string"), F.col("text")), 256).alias("content_hash"),
            F.concat(F.lit("tenants/t"), n % 4, F.lit("/d"), n, F.lit("/v"), F.col("number")).alias("object_key"),
            F.octet_length("text").cast("long").alias("size_bytes"),
            _days(n % 60 + F.col("number")).alias("created_at"),
        )
    )


def _block_struct(line: Column, n: Column) -> Column:
    """Block number ``n`` of a document: kinds, pages and boxes follow the line number."""

    def grid(words: Column) -> Column:
        rows = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 2).cast("int"))
        return F.array_join(
            F.transform(rows, lambda i: F.array_join(F.slice(words, i * 2 + 1, F.lit(2)), "\t")), "\n"
        )

    kind = (
        F.when(n % 4 == 0, "heading")
        .when(n % 8 == 2, "table")
        .when(n % 8 == 6, "image")
        .otherwise("text")
    )
    x0, y0 = (n % 5 * 10).cast("double"), (n % 6 * 12).cast("double")
    return F.struct(
        F.concat(F.lit("b"), n).alias("id"),
        kind.alias("kind"),
        n.alias("order"),
        F.when(n % 4 == 0, F.lit(1) + (F.floor(n / 4) * 7) % 4).cast("int").alias("level"),
        F.when(n % 8 == 2, tx.let(F.split(line, r"\s+"), grid)).otherwise(line).alias("text"),
        (F.lit(1) + F.floor(n / 6)).cast("int").alias("page"),
        F.when(n % 7 != 3, F.struct(
            x0.alias("x0"), y0.alias("y0"), (x0 + 100).alias("x1"), (y0 + 10).alias("y1"),
            F.when(n % 17 == 0, "pixel").otherwise("point").alias("space"),
        )).alias("box"),
    )


def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsed_rows(kb_documents(spark, d))


def parsed_rows(documents: DataFrame) -> DataFrame:
    """One row per document with its ordered ``blocks`` array (heading paths attached)."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda s: s != "")
    blocks = arrays.with_heading_paths(F.transform(lines, _block_struct))
    return documents.withColumn("blocks", chunk.flatten_paths(blocks)).drop("text")


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    return parsed_documents(spark, d).select(
        "tenant_id", "knowledge_base_id", "document_id", "document_version_id",
        F.explode("blocks").alias("b"),
    ).select("tenant_id", "knowledge_base_id", "document_id", "document_version_id", "b.*")


def chunks(spark: SparkSession, d: str, limit: int = 64, overlap: int = 8) -> DataFrame:
    """General chunks of every document, with the document's scope and access columns."""
    return chunk_rows(kb_documents(spark, d), limit, overlap)


def chunk_rows(documents: DataFrame, limit: int = 64, overlap: int = 8) -> DataFrame:
    return chunk.chunk_documents(
        parsed_rows(documents), "general", limit=limit, overlap=overlap
    ).withColumn("index_version_id", F.lit("g1"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """One search request per benchmark item: the whole item text, a tenant, an actor, roles.

    A request may search three of four sources, whichever sources the documents have.
    """
    n = F.col("item_id")
    sources = table(spark, d, "documents").agg(F.sort_array(F.collect_set("source")).alias("s")).scalar()
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), n).alias("query_id"),
        n.alias("item_id"),
        F.concat(F.lit("t"), n % 4).alias("tenant_id"),
        F.concat(F.lit("u"), n % 7).alias("actor_id"),
        F.when(n % 2 == 0, F.array(F.lit("editor"))).otherwise(F.array(F.lit("reader"))).alias("roles"),
        sources.alias("all_kbs"),
        "text",
        F.when(n % 6 == 5, F.array(F.lit("xx"))).when(n % 3 == 1, F.array(F.lit("en"), F.lit("fr"))).alias("languages"),
    ).withColumn("knowledge_base_ids", F.filter("all_kbs", lambda s, i: (i + F.col("item_id")) % 4 != 0)).drop("all_kbs")


ANCHOR_WIDTH = 5
GRAM = 3


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain the item text; relevance 2 when the document has quality label 1.

    Containment is found by an equi-join on an anchor and verified on the full texts, so no pair of
    unrelated rows is ever formed. The inner words of an item stand between blanks and so are whole
    words of any containing document: up to five of them are the anchor. An item of one or two words has
    no inner word; its anchor is its first three characters. An empty item is in no document.
    """
    items = (
        table(spark, d, "benchmark")
        .select("item_id", F.col("text").alias("item_text"), F.split("text", r"\s+").alias("w"))
        .filter("item_text <> ''")
        .withColumn("width", F.greatest(F.lit(0), F.least(F.lit(ANCHOR_WIDTH), F.size("w") - 2)))
        .withColumn("anchor", F.when(F.col("width") > 0, F.xxhash64(F.slice("w", 2, F.greatest(F.col("width"), F.lit(1)))))
                    .otherwise(F.xxhash64(F.substring("item_text", 1, GRAM))))
        .withColumn("gram", F.when(F.col("width") == 0, F.least(F.lit(GRAM), F.length("item_text"))).otherwise(0))
        .drop("w")
    )
    documents = table(spark, d, "documents").select("doc_id", "text")

    def runs(width: int, gram: int) -> Column:
        if width:
            words = F.split("text", r"\s+")
            hashes = tx.let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(width)))))
            fits = F.size(words) >= width
        else:
            hashes = F.transform(F.sequence(F.lit(1), F.length("text") - gram + 1), lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(gram))))
            fits = F.length("text") >= gram
        return F.explode(F.when(fits, F.array_distinct(hashes)))

    kinds = sorted(map(tuple, items.select("width", "gram").distinct().collect()))  # at most five widths and three grams
    pairs = None
    for width, gram in kinds or [(ANCHOR_WIDTH, 0)]:
        spans = spread(documents).select("doc_id", runs(width, gram).alias("anchor"))
        met = spans.join(items.filter((F.col("width") == width) & (F.col("gram") == gram)), "anchor").select("doc_id", "item_id", "item_text")
        pairs = met if pairs is None else pairs.unionByName(met)
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return (
        pairs.join(documents, "doc_id")
        .filter(F.contains("text", "item_text"))
        .join(labels, "doc_id", "left")
        .select(
            F.concat(F.lit("q"), "item_id").alias("query_id"),
            F.concat(F.lit("d"), "doc_id").alias("document_id"),
            F.when(F.col("quality") == 1, 2).otherwise(1).alias("relevance"),
        )
    )
