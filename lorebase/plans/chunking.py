"""Registered chunking queries (token windows, nine strategies, ids, contract checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import ids, text as tx
from lorebase.operators import chunk
from lorebase.plans.sqlkit import define, query, strip, windows
from lorebase.sources import derived
from lorebase.sources.tables import spread, table

LIMIT, OVERLAP = 64, 8
LAW = "'(?i)^(?:第[一二三四五六七八九十百千万零〇\\d]+条|Article\\s+\\d+)'"


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(
        "doc_id", F.posexplode(tx.token_windows(F.col("text"), LIMIT, OVERLAP)).alias("window_index", "w")
    ).select("doc_id", "window_index", "w.content", "w.token_count")


def _strategy(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return chunk.chunk_documents(
            derived.parsed_documents(spark, d), name, limit=LIMIT, overlap=OVERLAP
        ).select(
            "document_version_id", "sequence", "content", "token_count", "chunk_id",
            F.array_join("source_block_ids", ",").alias("sources"),
        )

    return run


def law_documents(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose sentences are lines; every third line opens an article."""
    def articled(block):
        return F.array_join(
            F.transform(
                F.split(block["text"], r"\. "),
                lambda s, i: F.when(i % 3 == 1, F.concat(F.lit("Article "), i, F.lit(" "), s)).otherwise(s),
            ),
            "\n",
        )

    return derived.parsed_documents(spark, d).withColumn(
        "blocks", F.transform("blocks", lambda b: b.withField("text", articled(b)))
    )


def qa_documents(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks rewritten as question and answer pairs, sentence by sentence."""
    def paired(block):
        return F.array_join(
            F.transform(
                F.split(block["text"], r"\. "),
                lambda s, i: F.concat(F.when(i % 2 == 0, F.lit("Q: ")).otherwise(F.lit("A: ")), s),
            ),
            "\n",
        )

    return derived.parsed_documents(spark, d).withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: F.when(b["kind"] == "text", b.withField("text", paired(b))).otherwise(b),
        ),
    )


def chunk_laws(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_documents(law_documents(spark, d), "laws", limit=LIMIT, overlap=OVERLAP).select(
        "document_version_id", "sequence", "content", "token_count", "chunk_id"
    )


def chunk_qa(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_documents(qa_documents(spark, d), "qa", limit=LIMIT, overlap=OVERLAP).select(
        "document_version_id", "sequence", "content", "token_count", "chunk_id"
    )


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = "metadata."
    none = F.lit("none")
    edge = lambda name: F.coalesce(F.col(m + "box")[name].cast("int").cast("string"), none)
    return chunk.chunk_documents(
        derived.parsed_documents(spark, d), "manual", limit=LIMIT, overlap=OVERLAP
    ).select(
        "document_version_id", "sequence",
        F.array_join(m + "heading_path", " > ").alias("heading_path"),
        m + "page_start", m + "page_end", m + "source_order_start", m + "source_order_end",
        F.array_join(m + "block_kinds", ",").alias("block_kinds"),
        F.concat_ws("/", edge("x0"), edge("y0"), edge("x1"), edge("y1"),
                    F.coalesce(F.col(m + "box.space"), none)).alias("box"),
        m + "contains_table", m + "contains_image",
    )


REQUESTED = ("auto", "general", "manual", "table", "picture", "unknown", "book", "laws", "resume")


def chunk_requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return (
        derived.parsed_documents(spark, d)
        .withColumn("strategy_id", F.element_at(F.array(*[F.lit(s) for s in REQUESTED]), (n % len(REQUESTED) + 1).cast("int")))
        .withColumn("strategy_version", F.when(n % 10 == 3, "9").when(n % 2 == 0, "1").otherwise("auto"))
        .withColumn("recommended_chunk_strategy", F.when(F.col("media_type") == "text/plain", "general").otherwise("manual"))
    )


def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    done, rejected = chunk.dispatch(chunk_requests(spark, d), limit=LIMIT, overlap=OVERLAP)
    return (
        done.groupBy("document_version_id")
        .agg(F.max("chosen_strategy").alias("outcome"), F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
        .unionByName(
            rejected.select("document_version_id", F.col("error_code").alias("outcome"),
                            F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("tokens"))
        )
    )


def chunk_ids(version: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = derived.block_rows(spark, d)
        args = (F.col("tenant_id"), F.col("document_version_id"))
        tail = (F.col("order"), F.array("id"), F.col("text"))
        made = (
            ids.chunk_id_v1(*args, *tail)
            if version == 1
            else ids.chunk_id_v2(*args, F.lit("manual"), F.lit("1"), *tail)
        )
        return rows.select("document_version_id", "id", made.alias("chunk_id"))

    return run


def defective(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and chunks with defects that depend on the row, to exercise the contract checks."""
    blocks = derived.block_rows(spark, d).select(
        "document_version_id",
        F.when(F.col("order") % 31 == 30, F.lit("b1")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("order") % 37 == 36, F.lit(2)).otherwise(F.col("order")).alias("order"),
    )
    chunks = derived.chunks(spark, d).select(
        "document_version_id",
        F.when(F.col("sequence") % 41 == 40, F.col("sequence") + 1000).otherwise(F.col("sequence")).alias("sequence"),
        "chunk_id",
        F.when(F.col("sequence") % 43 == 42, F.lit(" \n")).otherwise(F.col("content")).alias("content"),
    )
    return blocks, chunks


def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_violations(*defective(spark, d))


QUERIES = {
    "token_windows": token_windows,
    "chunk_general": _strategy("general"),
    "chunk_manual": _strategy("manual"),
    "chunk_paper": _strategy("paper"),
    "chunk_resume": _strategy("resume"),
    "chunk_book": _strategy("book"),
    "chunk_laws": chunk_laws,
    "chunk_qa": chunk_qa,
    "chunk_table": _strategy("table"),
    "chunk_picture": _strategy("picture"),
    "chunk_dispatch": chunk_dispatch,
    "chunk_metadata": chunk_metadata,
    "chunk_id_v1": chunk_ids(1),
    "chunk_id_v2": chunk_ids(2),
    "chunk_violations": chunk_violations,
}

# ---- check SQL ------------------------------------------------------------------------------
KEYS = "tenant_id, document_version_id, sources"


def _v2(strategy: str) -> str:
    return f"""'chk_' || left(sha256(concat_ws(chr(31), 'sha256-v2', tenant_id, document_version_id,
        '{strategy}', '1', CAST(sequence AS VARCHAR), sources, sha256(content))), 32)"""


def _islands(flag: str, blocks: str = "blocks0") -> str:
    """Heading sections: a running sum over the start flag numbers the groups."""
    return f"""
        SELECT tenant_id, document_version_id, g, string_agg({strip('text')}, chr(10)||chr(10) ORDER BY n) AS content,
               string_agg(id, ',' ORDER BY n) AS sources
        FROM (SELECT *, sum(CASE WHEN {flag} THEN 1 ELSE 0 END)
                        OVER (PARTITION BY document_version_id ORDER BY n) AS g
              FROM (SELECT *, lag(kind) OVER (PARTITION BY document_version_id ORDER BY n) AS before FROM {blocks}))
        GROUP BY ALL"""


ISOLATE = "before IS NULL OR kind IN ('heading','table','image') OR before IN ('table','image')"
HEADING = "before IS NULL OR kind = 'heading'"
define("manual_groups", _islands(ISOLATE))
define("section_groups", _islands(HEADING))
define("table_groups", f"""
    SELECT tenant_id, document_version_id, id AS sources, n * 100000 + j AS g, content FROM (
        SELECT *, unnest(cs) AS content, generate_subscripts(cs, 1) AS j FROM (
            SELECT *, CASE WHEN kind <> 'table' THEN [{strip('text')}] WHEN len(r) < 2 THEN r
                      ELSE list_transform(r[2:], lambda x: r[1] || chr(10) || x) END AS cs
            FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '') AS r FROM blocks0)))""")
define("page_images", "SELECT document_version_id, page FROM blocks0 WHERE kind = 'image' GROUP BY ALL")
define("picture_groups", f"""
    SELECT b.tenant_id, b.document_version_id, b.page * 1000 AS g,
           string_agg(b.text, chr(10) ORDER BY b.kind <> 'image', b.n) AS content,
           string_agg(b.id, ',' ORDER BY b.kind <> 'image', b.n) AS sources
    FROM blocks0 b SEMI JOIN page_images p ON p.document_version_id = b.document_version_id AND p.page = b.page
    GROUP BY ALL
    UNION ALL
    SELECT b.tenant_id, b.document_version_id, b.page * 1000 + b.n % 6, {strip('b.text')}, b.id
    FROM blocks0 b ANTI JOIN page_images p ON p.document_version_id = b.document_version_id AND p.page = b.page""")
define("law_lines", f"""
    SELECT *, sum(CASE WHEN regexp_matches(line, {LAW}) THEN 1 ELSE 0 END)
              OVER (PARTITION BY document_version_id, n ORDER BY j) AS run
    FROM (SELECT *, {strip("CASE WHEN (j - 1) % 3 = 1 THEN 'Article ' || (j - 1) || ' ' || s ELSE s END")} AS line
          FROM (SELECT *, unnest(ss) AS s, generate_subscripts(ss, 1) AS j
                FROM (SELECT *, string_split(replace(text, '. ', chr(2)), chr(2)) AS ss FROM blocks0)))
    WHERE line <> ''""")
define("law_split", f"""
    SELECT tenant_id, document_version_id, id, n, string_split(line, chr(10)) AS pieces, j, run FROM law_lines""")
define("law_groups", """
    SELECT tenant_id, document_version_id, id AS sources, n * 100000 + run AS g,
           string_agg(line, chr(10) ORDER BY j) AS content
    FROM law_lines GROUP BY ALL""")

define("qa_sentences", """
    SELECT *, string_split(replace(text, '. ', chr(2)), chr(2)) AS ss FROM blocks0 WHERE kind = 'text'""")
define("qa_groups", f"""
    SELECT tenant_id, document_version_id, id AS sources, n * 100000 + j AS g,
           'Question: ' || {strip('ss[2*j-1]')} || chr(10) || 'Answer: ' || {strip('ss[2*j]')} AS content
    FROM (SELECT *, unnest(range(1, len(ss) // 2 + 1)) AS j FROM qa_sentences)
    UNION ALL
    SELECT tenant_id, document_version_id, id, n * 100000, 'Q: ' || text FROM qa_sentences WHERE len(ss) = 1
    UNION ALL
    SELECT tenant_id, document_version_id, id, n * 100000, text FROM blocks0 WHERE kind IN ('heading', 'image')
    UNION ALL
    SELECT tenant_id, document_version_id, id, n * 100000 + j,
           'Question: ' || c[1] || chr(10) || 'Answer: ' || c[2]
    FROM (SELECT *, string_split(r, chr(9)) AS c
          FROM (SELECT *, unnest(rows) AS r, generate_subscripts(rows, 1) AS j
                FROM (SELECT *, string_split(text, chr(10)) AS rows FROM blocks0 WHERE kind = 'table')))
    WHERE (j > 1 OR len(rows) = 1) AND len(c) >= 2 AND c[1] <> '' AND c[2] <> ''""")


def _chunk_sql(groups: str, strategy: str, keep: str = "sources, ") -> str:
    return query(f"""
        SELECT document_version_id, sequence, content, token_count, {keep}{_v2(strategy)} AS chunk_id
        FROM ({windows(groups, KEYS, "g")})""")


define("dispatch_docs", """
    SELECT *, CASE WHEN doc_id % 9 = 0 THEN recommended
                   ELSE ['auto','general','manual','table','picture','unknown','book','laws','resume'][doc_id % 9 + 1] END AS chosen,
           CASE WHEN doc_id % 9 = 5 THEN 'chunk_strategy_unknown'
                WHEN doc_id % 9 <> 0 AND doc_id % 10 = 3 THEN 'chunk_strategy_version_unknown' END AS error_code
    FROM (SELECT *, CASE WHEN media_type = 'text/plain' THEN 'general' ELSE 'manual' END AS recommended FROM kb_documents)""")
_PER = "SELECT document_version_id, '{s}' AS s, count(*) AS chunks, sum(token_count) AS tokens FROM ({w}) GROUP BY 1"
define("law_block_groups", f"""
    SELECT tenant_id, document_version_id, id AS sources, n * 100000 + run AS g, string_agg(line, chr(10) ORDER BY j) AS content
    FROM (SELECT *, sum(CASE WHEN regexp_matches(line, {LAW}) THEN 1 ELSE 0 END) OVER (PARTITION BY document_version_id, n ORDER BY j) AS run
          FROM (SELECT *, {strip('l')} AS line FROM (SELECT *, unnest(ls) AS l, generate_subscripts(ls, 1) AS j
                FROM (SELECT *, string_split(text, chr(10)) AS ls FROM blocks0))) WHERE line <> '')
    GROUP BY ALL""")
define("all_strategy_counts", " UNION ALL ".join([
    "SELECT document_version_id, 'general' AS s, count(*) AS chunks, sum(token_count) AS tokens FROM general GROUP BY 1",
    _PER.format(s="manual", w=windows("manual_groups", KEYS, "g")),
    _PER.format(s="resume", w=windows("section_groups", KEYS, "g")),
    _PER.format(s="book", w=windows("section_groups", KEYS, "g")),
    _PER.format(s="table", w=windows("table_groups", KEYS, "g")),
    _PER.format(s="picture", w=windows("picture_groups", KEYS, "g")),
    _PER.format(s="laws", w=windows("law_block_groups", KEYS, "g")),
]))
define("manual_members", f"""
    SELECT *, sum(CASE WHEN {ISOLATE} THEN 1 ELSE 0 END) OVER (PARTITION BY document_version_id ORDER BY n) AS g
    FROM (SELECT *, lag(kind) OVER (PARTITION BY document_version_id ORDER BY n) AS before FROM blocks)""")
define("manual_meta", """
    SELECT document_version_id, g, array_to_string(min_by(heading_path, n), ' > ') AS heading_path,
           min(page) AS page_start, max(page) AS page_end, min(n) AS source_order_start, max(n) AS source_order_end,
           bool_or(kind = 'table') AS contains_table, bool_or(kind = 'image') AS contains_image,
           CASE WHEN count(DISTINCT page) = 1 AND count(DISTINCT space) = 1 THEN
                concat_ws('/', CAST(min(x0) AS INTEGER), CAST(min(y0) AS INTEGER), CAST(max(x1) AS INTEGER), CAST(max(y1) AS INTEGER), min(space))
                ELSE 'none/none/none/none/none' END AS box
    FROM manual_members GROUP BY ALL""")
define("manual_kinds", """
    SELECT document_version_id, g, string_agg(kind, ',' ORDER BY first_n) AS block_kinds
    FROM (SELECT document_version_id, g, kind, min(n) AS first_n FROM manual_members GROUP BY ALL) GROUP BY ALL""")
define("bad_blocks", """
    SELECT document_version_id, CASE WHEN n % 31 = 30 THEN 'b1' ELSE id END AS id,
           CASE WHEN n % 37 = 36 THEN 2 ELSE n END AS n FROM blocks0""")
define("bad_chunks", """
    SELECT document_version_id, CASE WHEN sequence % 41 = 40 THEN sequence + 1000 ELSE sequence END AS sequence, chunk_id,
           CASE WHEN sequence % 43 = 42 THEN ' ' ELSE content END AS content FROM chunks""")

ORACLE = {
    "token_windows": query(f"""
        SELECT document_version_id AS doc_id, sequence AS window_index, content, token_count
        FROM ({windows("(SELECT doc_id AS document_version_id, 0 AS n, text FROM documents)", "document_version_id", "n", "text")})"""),
    "chunk_general": query("SELECT document_version_id, sequence, content, token_count, chunk_id, id AS sources FROM chunks"),
    "chunk_manual": _chunk_sql("manual_groups", "manual"),
    "chunk_paper": _chunk_sql("manual_groups", "paper"),
    "chunk_resume": _chunk_sql("section_groups", "resume"),
    "chunk_book": _chunk_sql("section_groups", "book"),
    "chunk_laws": _chunk_sql("law_groups", "laws", ""),
    "chunk_qa": _chunk_sql("qa_groups", "qa", ""),
    "chunk_table": _chunk_sql("table_groups", "table"),
    "chunk_picture": _chunk_sql("picture_groups", "picture"),
    "chunk_dispatch": query("""
        SELECT d.document_version_id, d.chosen AS outcome, c.chunks, CAST(c.tokens AS BIGINT) AS tokens
        FROM dispatch_docs d JOIN all_strategy_counts c ON c.document_version_id = d.document_version_id AND c.s = d.chosen
        WHERE d.error_code IS NULL
        UNION ALL SELECT document_version_id, error_code, 0, 0 FROM dispatch_docs WHERE error_code IS NOT NULL"""),
    "chunk_metadata": query(f"""
        SELECT w.document_version_id, w.sequence, m.heading_path, m.page_start, m.page_end, m.source_order_start,
               m.source_order_end, k.block_kinds, m.box, m.contains_table, m.contains_image
        FROM ({windows("manual_groups", KEYS + ", g AS grp", "g")}) w
        JOIN manual_meta m ON m.document_version_id = w.document_version_id AND m.g = w.grp
        JOIN manual_kinds k ON k.document_version_id = w.document_version_id AND k.g = w.grp"""),
    "chunk_id_v1": query("""
        SELECT document_version_id, id, 'chk_' || left(sha256(concat_ws(chr(31), 'sha256-v1', tenant_id, document_version_id,
               CAST(n AS VARCHAR), id, sha256(text))), 32) AS chunk_id FROM blocks0"""),
    "chunk_id_v2": query("""
        SELECT document_version_id, id, 'chk_' || left(sha256(concat_ws(chr(31), 'sha256-v2', tenant_id, document_version_id,
               'manual', '1', CAST(n AS VARCHAR), id, sha256(text))), 32) AS chunk_id FROM blocks0"""),
    "chunk_violations": query(f"""
        SELECT document_version_id, 'duplicate_block_id' AS violation, id AS item FROM bad_blocks GROUP BY 1, 3 HAVING count(*) > 1
        UNION ALL SELECT document_version_id, 'duplicate_block_order', CAST(n AS VARCHAR) FROM bad_blocks GROUP BY 1, n HAVING count(*) > 1
        UNION ALL SELECT min(document_version_id), 'duplicate_chunk_id', chunk_id FROM bad_chunks GROUP BY chunk_id HAVING count(*) > 1
        UNION ALL SELECT document_version_id, 'sequence_not_dense', CAST(max(sequence) AS VARCHAR) FROM bad_chunks
                  GROUP BY 1 HAVING min(sequence) <> 0 OR max(sequence) + 1 <> count(DISTINCT sequence) OR count(*) <> count(DISTINCT sequence)
        UNION ALL SELECT document_version_id, 'empty_content', chunk_id FROM bad_chunks WHERE {strip('content')} = ''"""),
}
