"""Registered source, parsing and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import text as tx
from lorebase.operators import parse
from lorebase.plans.sqlkit import WS, define, query, strip
from lorebase.sources import derived
from lorebase.sources.tables import list_prefix, scan, spread, table

PAGE_WORDS = 400
PAGE_WIDTH = 760.0


def object_prefix(spark: SparkSession, d: str) -> DataFrame:
    versions = derived.kb_versions(spark, d)
    return list_prefix(versions, F.lit("t1"), F.lit("tenants/t1/d1")).select("object_key", "size_bytes")


def scan_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Newest fifty active documents of a tenant (the limit is the feature)."""
    docs = derived.kb_documents(spark, d)
    return scan(
        docs.select("tenant_id", "document_id", "status", "revision", "created_at"),
        where=(F.col("tenant_id") == "t1") & (F.col("status") == "active"),
        order=[F.col("created_at").desc(), F.col("document_id")],
        limit=50,
    ).select("document_id", "status", "revision", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with line ends mixed and every third line end doubled, so sections exist."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda s, i: F.concat(s, F.when(i % 3 == 2, "\r\n\r\n").otherwise("\r\n")))
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(marked, "").alias("text"))


def parse_text(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_text(paragraphs(spark, d), "doc_id")


def md_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as light Markdown: every third line is a heading whose level runs 1,4,3,2."""
    lines = F.split("text", "\n")
    level = lambda i: (F.lit(1) + (F.floor(i / 3) * 7) % 4).cast("int")
    marked = F.transform(
        lines,
        lambda s, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), s)).otherwise(s),
    )
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(marked, "\n\n").alias("text"))


def parse_markdown(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_markdown(md_documents(spark, d), "doc_id").withColumn(
        "heading_path", F.array_join("heading_path", " > ")
    )


def parse_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    marked = F.transform(
        lines,
        lambda s, i: F.when(i % 5 == 0, F.concat(F.lit("# "), s))
        .when(i % 5 == 1, F.concat(F.lit("- "), s))
        .when(i % 5 == 2, F.concat(F.lit("```\n"), s, F.lit("\n```")))
        .when(i % 5 == 3, F.concat(F.lit("| a | b |\n|---|---|\n| "), F.replace(s, F.lit("|"), F.lit(" ")), F.lit(" | x |")))
        .otherwise(s),
    )
    docs = spread(table(spark, d, "documents")).select("doc_id", F.array_join(marked, "\n\n").alias("text"))
    blocks = parse.parse_markdown_blocks(docs, "doc_id")
    return blocks.select(
        "doc_id", "kind", "block_order", "text", F.array_join("heading_path", " > ").alias("heading_path"),
        F.coalesce("table_rows", F.lit(0)).alias("table_rows"), F.coalesce("table_columns", F.lit(0)).alias("table_columns"))


def parse_html(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    return parse.parse_html(spread(table(spark, d, "pages")), "page_id").select(
        "page_id", "kind", "block_order", "text", F.array_join("heading_path", " > ").alias("heading_path"),
        F.coalesce("table_rows", zero).alias("table_rows"), F.coalesce("table_columns", zero).alias("table_columns"),
        F.coalesce("has_header", F.lit(False)).alias("has_header"), F.coalesce("image_ref", F.lit("")).alias("image_ref"),
    )


GRID = ("l_partkey", "l_suppkey", "l_returnflag", "ship", "cents")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a sheet, every line item a row; some trailing cells are empty."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sheet"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("row"),
        F.array(
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.col("l_returnflag")),
            F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")),
            F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(
                F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")),
        ).alias("v"),
    )
    return rows.select("sheet", "row", F.posexplode("v").alias("col", "value"))


def cells_to_table(spark: SparkSession, d: str) -> DataFrame:
    """One table block per sheet; a sheet over the row limit is a row with an error code instead."""
    tables, rejected = parse.cells_to_tables(cells(spark, d))
    failed = rejected.select("sheet", F.lit("").alias("text"), F.col("sheet_rows").alias("table_rows"), F.lit(0).alias("table_columns"), "error_code")
    return tables.withColumn("error_code", F.lit("")).unionByName(failed)


def words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every document on a grid of ten per line and 400 per page."""
    n, pos = F.col("ord"), F.col("ord") % PAGE_WORDS
    x0 = ((pos % 10) * 60 + F.when((F.col("doc_id") % 2 == 0) & (pos % 10 >= 5), 80).otherwise(0)).cast("double")
    y0 = (F.floor(pos / 10) * 14 + (F.col("doc_id") + n) % 3).cast("double")
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return (
        spread(table(spark, d, "documents"))
        .select("doc_id", F.posexplode(tokens).alias("ord", "text"))
        .select(
            "doc_id", (F.lit(1) + F.floor(n / PAGE_WORDS)).cast("int").alias("page"), "ord", "text",
            x0.alias("x0"), y0.alias("y0"), (x0 + 50).alias("x1"), (y0 + 10).alias("y1"),
            (F.lit(0.5) + (n % 50) / 100).alias("confidence"),
        )
    )


def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return parse.words_to_lines(words(spark, d)).withColumn("confidence", F.round("confidence", 6))


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    return (
        parse.page_columns(words(spark, d), PAGE_WIDTH)
        .groupBy("doc_id", "page", "column")
        .agg(F.count(F.lit(1)).alias("words"), F.max("x1").alias("right_edge"))
    )


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return parse.reading_order(words(spark, d), "doc_id", "page", ["y0", "x0", "ord"]).select(
        "doc_id", "page", "ord", "reading_order"
    )


def route_requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("request_id"),
        F.when(n % 5 == 0, "text/plain").when(n % 5 == 1, "text/markdown").when(n % 5 == 2, "text/html")
        .when(n % 5 == 3, "image/png").otherwise("application/x-unknown").alias("media_type"),
        F.when(n % 7 == 0, ".pdf").when(n % 5 == 0, ".txt").when(n % 5 == 1, ".md").when(n % 5 == 2, ".htm")
        .otherwise(".png").alias("extension"),
        F.when(n % 11 == 0, "independent-text").when(n % 13 == 0, "no-such-parser").alias("parser_override"),
    )


def route_parser(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    return parse.route_parser(route_requests(spark, d), parse.parser_table(spark)).select(
        "request_id", F.coalesce("parser_id", none).alias("parser_id"),
        F.coalesce("chunk_strategy", none).alias("chunk_strategy"), F.coalesce("error_code", none).alias("error_code"),
    )


LIMITS = {"size_bytes": 9_000, "pages": 4, "rows": 25}


def limit_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = derived.parsed_documents(spark, d).join(
        table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes")), "doc_id"
    ).select("document_id", "size_bytes",
             F.coalesce(F.array_max(F.transform("blocks", lambda b: b["page"])), F.lit(0)).alias("pages"), F.size("blocks").alias("rows"))
    accepted, rejected = parse.limit_guard(docs, LIMITS)
    return accepted.select("document_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("document_id", F.concat_ws(":", "error_code", "resource").alias("outcome"))
    )


def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("source").alias("knowledge_base_id"),
        F.when(F.col("lang") == "en", "ASCII").when(F.col("lang") == "de", "utf_8").otherwise("latin_1").alias("encoding"),
        (F.length("text") % 3).alias("formula_cells"), (F.col("doc_id") % 2).alias("merged_ranges"),
    )
    return parse.warning_counts(docs, "knowledge_base_id")


QUERIES = {
    "object_prefix": object_prefix,
    "scan_by_status": scan_by_status,
    "parse_text": parse_text,
    "parse_markdown": parse_markdown,
    "parse_markdown_blocks": parse_markdown_blocks,
    "parse_html": parse_html,
    "cells_to_table": cells_to_table,
    "words_to_lines": words_to_lines,
    "page_columns": page_columns,
    "reading_order": reading_order,
    "route_parser": route_parser,
    "limit_guard": limit_guard,
    "warning_counts": warning_counts,
}

# ---- check SQL ------------------------------------------------------------------------------
define("words", f"""
    SELECT doc_id, CAST(1 + ord // {PAGE_WORDS} AS INTEGER) AS page, ord, text,
           CAST(pos % 10 * 60 + CASE WHEN doc_id % 2 = 0 AND pos % 10 >= 5 THEN 80 ELSE 0 END AS DOUBLE) AS x0,
           CAST(pos // 10 * 14 + (doc_id + ord) % 3 AS DOUBLE) AS y0
    FROM (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS ord, (generate_subscripts(w, 1) - 1) % {PAGE_WORDS} AS pos
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))""")
define("md_lines", """
    SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
define("md_sections", f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_order, kind, level, text,
           sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS h
    FROM (SELECT doc_id, i, CASE WHEN i % 3 = 0 AND {strip('s')} <> '' THEN 'heading' ELSE 'text' END AS kind, 1 + (i // 3 * 7) % 4 AS level,
                 CASE WHEN i % 3 = 0 AND {strip('s')} = '' THEN repeat('#', CAST(1 + (i // 3 * 7) % 4 AS BIGINT)) ELSE {strip('s')} END AS text
          FROM md_lines)
    WHERE text <> ''""")
define("md_paths", """
    SELECT doc_id, h, [text] AS path FROM md_sections WHERE kind = 'heading' AND h = 1
    UNION ALL
    SELECT s.doc_id, s.h, list_concat(p.path[1:s.level - 1], [s.text])
    FROM md_paths p JOIN md_sections s ON s.doc_id = p.doc_id AND s.h = p.h + 1 AND s.kind = 'heading'""")
define("row_cells", """
    SELECT l_orderkey AS sheet, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r,
           [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
            CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE l_returnflag END,
            CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END,
            CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END] AS v
    FROM lineitem""")
define("sweep", """
    SELECT doc_id, page, x0, x0 + 50 AS x1,
           max(x0 + 50) OVER (PARTITION BY doc_id, page ORDER BY x0, x0 + 50, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
    FROM words""")
define("dividers", f"""
    SELECT doc_id, page, max(CASE WHEN x0 > reached THEN x0 - reached END) AS gap,
           max_by((x0 + reached) / 2, row(x0 - reached, (x0 + reached) / 2)) FILTER (WHERE x0 > reached) AS divider
    FROM sweep GROUP BY ALL""")
define("sides", f"""
    SELECT w.*, CASE WHEN d.gap >= {max(48.0, PAGE_WIDTH * 0.08)} AND w.x0 + 25 >= d.divider THEN 1 ELSE 0 END AS side
    FROM words w JOIN dividers d ON d.doc_id = w.doc_id AND d.page = w.page""")
define("caps", "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{media}', '{ext}', '{strategy}')"
    for name, medias, exts, _, strategy in parse.PARSERS for media in medias for ext in exts
) + ") t(parser_id, media_type, extension, strategy)")
define("route_in", """
    SELECT doc_id AS request_id,
           CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/html' WHEN 3 THEN 'image/png' ELSE 'application/x-unknown' END AS media_type,
           CASE WHEN doc_id % 7 = 0 THEN '.pdf' ELSE CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.htm' ELSE '.png' END END AS extension,
           CASE WHEN doc_id % 11 = 0 THEN 'independent-text' WHEN doc_id % 13 = 0 THEN 'no-such-parser' END AS ov
    FROM documents""")

define("md_blocks", f"""
    SELECT *, max(CASE WHEN kind = 'heading' THEN i END) OVER (PARTITION BY doc_id ORDER BY i, part) AS head FROM (
        SELECT doc_id, i, part, kind, CASE WHEN kind = 'table' THEN 'a' || chr(9) || 'b' || chr(10) || {strip("replace(s, '|', ' ')")} || chr(9) || 'x'
                                           WHEN kind = 'code' THEN rtrim(s, {WS}) ELSE {strip('s')} END AS text
        FROM md_lines, (VALUES (0, 0, 'heading'), (1, 0, 'list'), (1, 1, 'text'), (2, 0, 'code'), (3, 0, 'table'), (4, 0, 'text')) k(m, part, kind)
        WHERE i % 5 = m) WHERE text <> ''""")

ORACLE = {
    "parse_markdown_blocks": query("""
        SELECT b.doc_id, b.kind, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY b.i, b.part) - 1 AS INTEGER) AS block_order, b.text, coalesce(h.text, '') AS heading_path,
               CASE WHEN b.kind = 'table' THEN 2 ELSE 0 END AS table_rows, CASE WHEN b.kind = 'table' THEN 2 ELSE 0 END AS table_columns
        FROM md_blocks b LEFT JOIN md_blocks h ON h.doc_id = b.doc_id AND h.i = b.head AND h.kind = 'heading'"""),
    "object_prefix": query("SELECT object_key, size_bytes FROM kb_versions WHERE object_key LIKE 'tenants/t1/d1%'"),
    "scan_by_status": query("""
        SELECT document_id, status, revision, strftime(created_at, '%Y-%m-%d') AS created FROM kb_documents
        WHERE tenant_id = 't1' AND status = 'active' ORDER BY created_at DESC, document_id LIMIT 50"""),
    "parse_text": query(f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block_order, text
        FROM (SELECT doc_id, i // 3 AS g, {strip("string_agg(s, chr(10) ORDER BY i)")} AS text FROM md_lines GROUP BY ALL)
        WHERE text <> ''"""),
    "parse_markdown": query("""
        SELECT s.doc_id, s.block_order, s.kind, s.text, coalesce(array_to_string(p.path, ' > '), '') AS heading_path
        FROM md_sections s LEFT JOIN md_paths p ON p.doc_id = s.doc_id AND p.h = s.h"""),
    # pages hold h1, p and li blocks only, none inside another; a text belongs to the block opened or closed last
    "parse_html": ("""
        WITH tokens AS (
            SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (
                SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(?:script|style)>.*?</(?:script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>|[^<]+') AS t FROM pages)
        ), marked AS (
            SELECT *, CASE WHEN regexp_matches(token, '^<(?:h1|p|li)>$') THEN token
                           WHEN regexp_matches(token, '^</?(?:h1|p|li|ul|div|article|nav|footer)(?: [^>]*)?>$') THEN '' END AS mark FROM tokens
        ), grouped AS (SELECT *, count(mark) OVER (PARTITION BY page_id ORDER BY pos) AS g FROM marked
        ), blocks AS (
            SELECT page_id, g, max(mark) AS mark, string_agg(v, ' ' ORDER BY pos) AS text
            FROM (SELECT *, CASE WHEN token NOT LIKE '<%' THEN nullif(""" + strip("replace(replace(replace(replace(replace(token, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')") + """, '') END AS v FROM grouped)
            GROUP BY ALL HAVING max(mark) <> '' AND count(v) > 0
        )
        SELECT page_id, CASE mark WHEN '<h1>' THEN 'heading' WHEN '<p>' THEN 'text' ELSE 'list' END AS kind,
               CAST(row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS INTEGER) AS block_order, text,
               coalesce(last_value(CASE WHEN mark = '<h1>' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY g), '') AS heading_path,
               0 AS table_rows, 0 AS table_columns, false AS has_header, '' AS image_ref
        FROM blocks"""),
    "cells_to_table": query("""
        SELECT sheet, CASE WHEN any_value(total) > 100000 THEN '' ELSE string_agg(array_to_string(v[1:last], chr(9)), chr(10) ORDER BY r) END AS text,
               CASE WHEN any_value(total) > 100000 THEN any_value(total) ELSE count(*) END AS table_rows,
               CASE WHEN any_value(total) > 100000 THEN 0 ELSE max(last) END AS table_columns,
               CASE WHEN any_value(total) > 100000 THEN 'parser_resource_limit' ELSE '' END AS error_code
        FROM (SELECT *, count(*) OVER (PARTITION BY sheet) AS total, list_max(list_transform(range(1, 6), lambda i: CASE WHEN v[i] <> '' THEN i END)) AS last FROM row_cells)
        WHERE last IS NOT NULL GROUP BY sheet"""),
    # lines of the grid are 14 apart and words jitter by at most 2, so a grid line is a visual line
    "words_to_lines": query(f"""
        SELECT doc_id, page, CAST(ord % {PAGE_WORDS} // 10 AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x0, ord) AS text,
               min(x0) AS x0, min(y0) AS y0, max(x0 + 50) AS x1, max(y0 + 10) AS y1,
               round(avg(0.5 + (ord % 50) / 100.0), 6) AS confidence
        FROM words GROUP BY ALL"""),
    "page_columns": query("""
        SELECT doc_id, page, CASE WHEN lowest = 1 THEN 0 ELSE side END AS "column", count(*) AS words, max(x0 + 50) AS right_edge
        FROM (SELECT *, min(side) OVER (PARTITION BY doc_id, page) AS lowest FROM sides) GROUP BY ALL"""),
    "reading_order": query("""
        SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, ord) - 1 AS reading_order FROM words"""),
    "route_parser": query("""
        SELECT request_id, CASE WHEN error_code = '' THEN coalesce(o.parser_id, c.parser_id) ELSE '' END AS parser_id,
               CASE WHEN error_code = '' THEN coalesce(o.strategy, c.strategy) ELSE '' END AS chunk_strategy, error_code
        FROM (SELECT r.*, CASE
                WHEN ov IS NOT NULL AND ov NOT IN (SELECT parser_id FROM caps) THEN 'parser_override_unknown'
                WHEN ov IS NOT NULL AND NOT EXISTS (SELECT 1 FROM caps c WHERE c.parser_id = ov AND c.media_type = r.media_type AND c.extension = r.extension) THEN 'parser_override_incompatible'
                WHEN ov IS NOT NULL THEN ''
                WHEN EXISTS (SELECT 1 FROM caps c WHERE c.media_type = r.media_type AND c.extension = r.extension) THEN ''
                WHEN r.media_type IN (SELECT media_type FROM caps) THEN 'parser_extension_media_type_mismatch'
                ELSE 'parser_media_type_unsupported' END AS error_code FROM route_in r) r
        LEFT JOIN caps c ON c.media_type = r.media_type AND c.extension = r.extension
        LEFT JOIN caps o ON o.media_type = r.media_type AND o.extension = r.extension AND o.parser_id = r.ov"""),
    "limit_guard": query(f"""
        SELECT d.document_id, CASE WHEN strlen(d.text) > {LIMITS['size_bytes']} THEN 'parser_resource_limit:size_bytes'
               WHEN b.pages > {LIMITS['pages']} THEN 'parser_resource_limit:pages'
               WHEN b.n > {LIMITS['rows']} THEN 'parser_resource_limit:rows' ELSE 'accepted' END AS outcome
        FROM kb_documents d LEFT JOIN (SELECT document_id, max(page) AS pages, count(*) AS n FROM blocks0 GROUP BY 1) b ON b.document_id = d.document_id"""),
    "warning_counts": """
        SELECT source AS knowledge_base_id, code, count(*) AS documents FROM (
            SELECT source, unnest(['text_encoding_detected']) AS code FROM documents WHERE lang NOT IN ('en', 'de')
            UNION ALL SELECT source, 'xlsx_formula_preserved_not_evaluated' FROM documents WHERE length(text) % 3 > 0
            UNION ALL SELECT source, 'xlsx_merged_cells_present' FROM documents WHERE doc_id % 2 > 0) GROUP BY ALL""",
}
