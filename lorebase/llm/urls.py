"""URL filter: host and path rules, and trust propagated over the link graph for the rest.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are blocked seeds.
Trust is a personalised PageRank along the links; distrust is one against them, from blocked hosts to
the hosts that link to them. A host whose distrust outweighs its trust by a threshold is blocked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import stage

Rule = tuple[str, str, str]  # action, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 30, 1e-9, 0.5  # ROUNDS: steps of the check SQL


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ranked(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent of it) and path, and its action; null if none."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in reversed(_ranked(rules)):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name, action = F.when(fits, domain + start).otherwise(name), F.when(fits, kind).otherwise(action)
    return name, action


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: ``src, dst, links``. Counted in the map tasks before the shuffle."""
    target = F.explode(F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda u: F.concat(F.lit(":"), F.regexp_replace(u, "^[^/]*", ""))))
    pairs = pages.select(host_of(F.col("url")).alias("src"), target.alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    return pairs.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """Scores ``host, kind, score`` when no score moves by more than ``tolerance``, or after ``rounds`` steps if given.

    The sum of all moves falls by ``damping`` a step, so the steps to the tolerance are bounded by the seeds' total.

    ``seeds`` has ``host, kind, score`` with kind ``trust`` or ``distrust``. One equi-join and one
    pre-aggregated sum per step for both kinds; every step is written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("total"))
    forward = edges.join(out, "src").select(
        F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), (F.col("links") / F.col("total")).alias("share")
    )
    backward = edges.join(into, "dst").select(
        F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), (F.col("links") / F.col("total")).alias("share")
    )
    moves = stage(forward.unionByName(backward), "moves")
    scores = seeds
    if rounds is None:
        total = seeds.agg(F.sum("score")).first()[0] or 0.0
        rounds = max(1, math.ceil(math.log(tolerance / max(total, tolerance)) / math.log(damping)))
    for _ in range(rounds):
        passed = scores.join(moves, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (damping * F.col("score") * F.col("share")).alias("score"))
        following = stage(seeds.unionByName(passed).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
        moved = (
            following.select("host", "kind", "score").unionByName(scores.select("host", "kind", (-F.col("score")).alias("score")))
            .groupBy("host", "kind").agg(F.abs(F.sum("score")).alias("moved")).agg(F.max("moved")).first()[0]
        )
        scores = following
        if moved is None or moved <= tolerance:
            break
    return scores


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, *, damping: float = DAMPING, rounds: int | None = None,
    tolerance: float = TOLERANCE, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A seed's weight is the share of the host's pages that rules allow (trust) or block (distrust), so a
    score of 1 is that of a host that is wholly allowed or blocked. Pages without a rule are blocked when
    distrust minus trust of their host is over ``threshold``. A null url (or one without ``://``) has empty
    host and path, no rule, no edges, and is allowed; a null html has no links. Repeated rows count as often as they
    occur; ties cannot arise between rules of equal length that fit one url unless they are equal. An
    empty table gives no rows; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", name).withColumn("action", action)
    shares = judged.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocked"),
    )
    seeds = stage(
        shares.select("host", F.expr("stack(2, 'trust', allowed / n, 'distrust', blocked / n) AS (kind, score)")).filter("score > 0"), "seeds"
    )
    scores = propagate(stage(host_edges(pages), "edges"), seeds, damping=damping, rounds=rounds, tolerance=tolerance)
    signed = F.when(F.col("kind") == "distrust", F.col("score")).otherwise(-F.col("score"))
    distrusted = scores.groupBy("host").agg(F.sum(signed).alias("excess")).filter(F.col("excess") > threshold)
    blocked = stage(distrusted.select("host", F.lit(True).alias("distrusted")), "blocked")
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("distrusted"), "block").otherwise("allow")).alias("verdict"),
    )


def check_sql(rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same verdicts in DuckDB SQL; the propagation is a recursive query of ``rounds`` steps."""

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"

    ranked = _ranked(rules)
    fits = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN " for _, d, p in ranked]
    name = " ".join(f"{f}'{d}{p}'" for f, (_, d, p) in zip(fits, ranked, strict=True))
    action = " ".join(f"{f}'{a}'" for f, (a, _, _) in zip(fits, ranked, strict=True))
    href = HREF.replace("'", "''")
    return f"""
    WITH RECURSIVE parts AS (
        SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
    ), ruled AS (SELECT *, CASE {name} END AS rule, CASE {action} END AS action FROM parts
    ), links AS (
        SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM parts
    ), pairs AS (
        SELECT src, {host("':' || regexp_replace(link, '^[^/]*', '')")} AS dst FROM links
    ), edges AS (
        SELECT src, dst, count(*) AS links FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
    ), moves AS (
        SELECT src AS host, dst AS dest, 'trust' AS kind, links / sum(links) OVER (PARTITION BY src) AS share FROM edges
        UNION ALL SELECT dst, src, 'distrust', links / sum(links) OVER (PARTITION BY dst) FROM edges
    ), shares AS (
        SELECT host, count(*) FILTER (action = 'allow') / count(*) AS allowed, count(*) FILTER (action = 'block') / count(*) AS blocked
        FROM ruled WHERE host <> '' GROUP BY host
    ), seeds AS (
        SELECT host, 'trust' AS kind, allowed AS score FROM shares WHERE allowed > 0
        UNION ALL SELECT host, 'distrust', blocked FROM shares WHERE blocked > 0
    ), walks AS (
        SELECT 0 AS step, host, kind, score FROM seeds
        UNION ALL
        SELECT step + 1, dest, kind, sum({damping} * score * share) FROM walks JOIN moves USING (host, kind)
        WHERE step < {rounds} GROUP BY step, dest, kind
    ), distrusted AS (
        SELECT host FROM walks GROUP BY host HAVING sum(CASE kind WHEN 'distrust' THEN score ELSE -score END) > {threshold}
    )
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN host IN (SELECT host FROM distrusted) THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled"""
