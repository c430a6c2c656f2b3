"""Registered queries of the corpus operators, with check SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lorebase.llm import (
    decontaminate, htmltext, jaccard, licenses, packing, quality, records, secretscan, spelling, tokens, urls, warc, whitening,
)
from lorebase.llm.common import table

QUERIES = {
    "op1_urls": lambda spark, d: urls.judge(table(spark, d, "pages")),
    "op2_licenses": lambda spark, d: licenses.scan(table(spark, d, "documents")).drop("detections"),
    "op3_jaccard": lambda spark, d: jaccard.join(table(spark, d, "documents")),
    "op4_quality": lambda spark, d: quality.rate(table(spark, d, "documents")),
    "op5_main_text": lambda spark, d: htmltext.main_text(table(spark, d, "pages")),
    "op6_token_counts": lambda spark, d: tokens.token_counts(table(spark, d, "documents")),
    "op7_warc": lambda spark, d: warc.archive_and_read(table(spark, d, "pages")).drop("url"),
    "op8_pack": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op9_leaks": lambda spark, d: decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_records": lambda spark, d: records.write_and_read(table(spark, d, "documents")),
    "op11_spelling": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op12_whitening": lambda spark, d: whitening.whiten(table(spark, d, "embeddings")),
    "op13_secrets": lambda spark, d: secretscan.scan(table(spark, d, "documents")).drop("findings"),
    "pipeline": corpus_pipeline.run,
}

UPPER, LOWER = urls.UPPER, urls.LOWER
JACCARD_SQL = f"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
    ), pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
    ), reached AS (SELECT doc_id AS node, doc_id AS origin FROM docs UNION SELECT v, origin FROM reached JOIN edges ON node = u)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(origin) AS component_id FROM reached GROUP BY 1) USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op1_urls": urls.check_sql(),
    "op3_jaccard": JACCARD_SQL,
    "op4_quality": quality.check_sql(),
    "op11_spelling": spelling.check_sql(),
}
