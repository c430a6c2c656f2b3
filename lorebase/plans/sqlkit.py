"""Shared common table expressions of the check SQL (DuckDB dialect).

The SQL is written from the definitions, independently of the Spark code: windows, gaps-and-islands
and recursion instead of array expressions.
"""

from __future__ import annotations

import re

WS = "' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
PIECE = r"'\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])'"
WORD = r"'[\p{L}\p{N}_]+'"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def fold(expr: str) -> str:
    return f"replace(lower({expr}), 'ß', 'ss')"


def windows(source: str, keys: str, order: str, text: str = "content", limit: int = 64, overlap: int = 8) -> str:
    """Token windows of every group of ``source``; numbered over the whole document version."""
    step = limit - min(overlap, limit - 1)
    return f"""
        SELECT {keys}, content, token_count,
               row_number() OVER (PARTITION BY document_version_id ORDER BY {order}, st) - 1 AS sequence
        FROM (SELECT {keys}, {order}, st,
                     {strip(f"array_to_string(p[st+1:st+{limit}], '')")} AS content,
                     least({limit}, len(p) - st) AS token_count
              FROM (SELECT *, unnest(range(0, greatest(cast(ceil((len(p) - {limit - step}) / {step}.0) AS BIGINT), 1) * {step}, {step})) AS st
                    FROM (SELECT *, regexp_extract_all({text}, {PIECE}) AS p FROM {source}) WHERE len(p) > 0))
        WHERE content <> ''"""


CTE: dict[str, str] = {
    "kb_documents": """
        SELECT doc_id, 't' || (doc_id % 4) AS tenant_id, source AS knowledge_base_id,
               'd' || doc_id AS document_id,
               'd' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_v2' ELSE '_v1' END AS document_version_id,
               CASE WHEN doc_id % 11 <> 0 THEN 'd' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_v2' ELSE '_v1' END END AS current_version_id,
               'u' || (doc_id % 7) AS owner_id,
               CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'tenant' END AS visibility,
               ['u' || ((doc_id + 1) % 7)] AS allowed_actor_ids,
               CASE WHEN doc_id % 9 = 0 THEN ['editor'] ELSE CAST([] AS VARCHAR[]) END AS allowed_roles,
               CASE WHEN doc_id % 11 = 0 THEN 'delete_pending' ELSE 'active' END AS status,
               doc_id % 11 <> 0 AS active,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 17 <> 0 END AS document_enabled,
               CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 11 = 0 END AS document_deleted,
               CAST(1 + doc_id % 3 AS INTEGER) AS revision,
               CASE doc_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS media_type,
               lang AS language,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS created_at,
               CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) END AS purge_after,
               text
        FROM documents""",
    "kb_versions": """
        SELECT 't' || (doc_id % 4) AS tenant_id, 'd' || doc_id AS document_id,
               'd' || doc_id || '_v' || number AS document_version_id,
               CASE WHEN doc_id % 11 = 0 THEN 'deleted'
                    WHEN number < CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END THEN 'superseded' ELSE 'ready' END AS status,
               sha256(number || '#' || text) AS content_hash,
               'tenants/t' || (doc_id % 4) || '/d' || doc_id || '/v' || number AS object_key,
               CAST(strlen(text) AS BIGINT) AS size_bytes,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 + number AS INTEGER)) AS created_at
        FROM documents, (SELECT unnest([1, 2]) AS number)
        WHERE number = 1 OR doc_id % 5 = 0""",
    "lines": f"""
        SELECT * EXCLUDE (ls), unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS n
        FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS ls
              FROM kb_documents)""",
    "blocks0": """
        SELECT * EXCLUDE (line, text), 'b' || n AS id, n AS "order",
               CASE WHEN n % 4 = 0 THEN 'heading' WHEN n % 8 = 2 THEN 'table' WHEN n % 8 = 6 THEN 'image' ELSE 'text' END AS kind,
               CASE WHEN n % 4 = 0 THEN 1 + (n // 4 * 7) % 4 END AS level,
               CASE WHEN n % 8 = 2 THEN array_to_string(list_transform(range(0, (len(w) + 1) // 2),
                    lambda i: array_to_string(w[2*i+1:2*i+2], chr(9))), chr(10)) ELSE line END AS text,
               1 + n // 6 AS page,
               CASE WHEN n % 7 <> 3 THEN CAST(n % 5 * 10 AS DOUBLE) END AS x0,
               CASE WHEN n % 7 <> 3 THEN CAST(n % 6 * 12 AS DOUBLE) END AS y0,
               CASE WHEN n % 7 <> 3 THEN CASE WHEN n % 17 = 0 THEN 'pixel' ELSE 'point' END END AS space
        FROM (SELECT *, regexp_split_to_array(line, '\\s+') AS w FROM lines)""",
    "heads": """
        SELECT document_version_id, n // 4 AS i, level, text FROM blocks0 WHERE kind = 'heading'""",
    "paths": """
        SELECT document_version_id, i, [text] AS path FROM heads WHERE i = 0
        UNION ALL
        SELECT h.document_version_id, h.i, list_concat(p.path[1:h.level - 1], [h.text])
        FROM paths p JOIN heads h ON h.document_version_id = p.document_version_id AND h.i = p.i + 1""",
    "blocks": """
        SELECT b.*, p.path AS heading_path, x0 + 100 AS x1, y0 + 10 AS y1
        FROM blocks0 b JOIN paths p ON p.document_version_id = b.document_version_id AND p.i = b.n // 4""",
    "general": windows(
        "blocks0",
        "doc_id, tenant_id, knowledge_base_id, document_id, document_version_id, id, kind, page, owner_id, visibility, "
        "allowed_actor_ids, allowed_roles, status, active, document_enabled, document_deleted, language, media_type, created_at",
        "n", "text"),
    "chunks": """
        SELECT *, 'chk_' || left(sha256(concat_ws(chr(31), 'sha256-v1', tenant_id, document_version_id,
               CAST(sequence AS VARCHAR), id, sha256(content))), 32) AS chunk_id
        FROM general""",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_0-9]+\b", sql))


def define(name: str, sql: str) -> None:
    """Register one more shared expression."""
    if name in CTE:
        raise ValueError(f"already defined: {name}")
    CTE[name] = sql


# expressions several queries read; anything scanned twice is computed once
MATERIALIZED = {"chunks", "blocks", "blocks0", "terms", "bm25", "text_hits", "vector_hits", "fused", "selected"}


class Body(str):
    """A query body whose shared expressions are added by :func:`render`, once all are defined."""


def query(body: str) -> Body:
    return Body(body)


def render(sql: str) -> str:
    """Prefix a body with the shared expressions it (transitively) names, dependencies first."""
    if not isinstance(sql, Body):
        return sql
    ordered: dict[str, None] = {}

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in sorted(_names(text) & CTE.keys()):
            if name not in ordered and name not in path:  # a recursive expression names itself
                visit(CTE[name], (*path, name))
                ordered[name] = None

    visit(str(sql), ())
    parts = [f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({CTE[name]})" for name in ordered]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else str(sql)
