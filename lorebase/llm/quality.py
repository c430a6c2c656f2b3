"""Quality rules: text statistics and robust multivariate outliers, in DataFrame and SQL functions only.

Transformed statistics of a text form a vector. For every language and source the minimum covariance
determinant estimate is approached by concentration steps: keep the share of rows with the smallest
Mahalanobis distances, take their mean and covariance, repeat. Rows beyond a cutoff are rejected.

The vector is kept in whole thousandths, so all sums are exact whatever the partitioning, and the
values of a group are few enough for exact percentiles in bounded memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import let
from lorebase.llm.common import stage, stage_lookup

SPACE, SPACE_CLASS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WIDTH = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20
# The vector: log words, log mean word length, log symbols per word, share of repeated words; in thousandths.
VECTOR = (
    "ln(1.0 + n_words)", "ln(1.0 + word_chars / greatest(n_words, 1))",
    "ln(1.0 + n_symbols / greatest(n_words, 1))", "n_repeat_words / greatest(n_words, 1)",
)
DIMS = len(VECTOR)
# Standard deviations (thousandths) that a group is assumed to have at least, and that count as PRIOR rows of evidence:
# without them a statistic that is constant in a group would reject every other value.
FLOOR = (800.0, 100.0, 50.0, 100.0)
PRIOR = 20.0
SHARE = 0.75  # rows that a concentration step keeps
CONSISTENCY = 1.49  # makes the covariance of the kept share of normal rows that of all (4 dimensions, 75 %)
STEPS = 3
CUTOFF = 60.0  # squared distance; far out for normal vectors, since word counts have long tails
GRID, FARTHEST = 16, 4000.0  # distances are ranked in steps of 1/16 up to FARTHEST
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            same = lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
            return F.array_sort(F.transform(F.filter(pairs, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"]))

        zero = F.struct(F.lit(0).alias("n"), F.lit(-WIDTH).alias("last"))
        add = lambda a, i: F.struct((a["n"] + F.least(F.lit(WIDTH), i - a["last"])).alias("n"), i.alias("last"))
        repeated = F.aggregate(let(ordered, starts), zero, add)["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(repeated)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WIDTH))))
    return F.when(F.size(words) < 2 * WIDTH - (WIDTH - 1), 0).otherwise(let(hashes, covered)).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the base statistics of every whole text; row-local, null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    stripped = F.btrim("t", F.lit(SPACE))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE_CLASS))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    without = lambda drop: F.length(F.translate("t", drop, ""))
    return (
        docs.select(*keep, text.alias("t"))
        .select(
            *keep,
            let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _count_repeated(w).alias("r"))).alias("w"),
            without(SPACE).cast("long").alias("word_chars"),
            (F.length("t") - without(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )
        .select(*keep, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
        .withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))
    )


# --- pieces of SQL that the jobs and the check SQL share ---------------------------------------
VALUES = [f"cast(floor(1000 * {v} + 0.5) AS bigint) AS x{k}" for k, v in enumerate(VECTOR)]
PAIRS = [(a, b) for a in range(DIMS) for b in range(a + 1)]
SUMS = ["count(*) AS n", *(f"sum(x{k}) AS s{k}" for k in range(DIMS)), *(f"sum(x{a} * x{b}) AS q{a}{b}" for a, b in PAIRS)]
MEANS = ["n", *(f"cast(s{k} AS double) / n AS m{k}" for k in range(DIMS)), *(
    f"(n * {CONSISTENCY} * (cast(q{a}{b} AS double) / n - cast(s{a} AS double) / n * (cast(s{b} AS double) / n))"
    f" + {PRIOR * FLOOR[a] ** 2 if a == b else 0.0}) / (n + {PRIOR}) AS c{a}{b}"
    for a, b in PAIRS
)]


def _factor() -> list[list[str]]:
    """Cholesky factor l of the covariance c, one list of column expressions per row of the factor."""
    rows = []
    for a in range(DIMS):
        row = []
        for b in range(a):
            less = "".join(f" - l{a}{k} * l{b}{k}" for k in range(b))
            row.append(f"(c{a}{b}{less}) / l{b}{b} AS l{a}{b}")
        less = "".join(f" - l{a}{k} * l{a}{k}" for k in range(a))
        rows += [[item] for item in row] + [[f"sqrt(greatest(c{a}{a}{less}, {FLOOR[a] ** 2 / 100})) AS l{a}{a}"]]
    return rows


def _solved() -> list[str]:
    """Forward substitution, one column per dimension; squared distance is the sum of their squares."""
    return [f"(x{a} - m{a}{''.join(f' - l{a}{k} * y{k}' for k in range(a))}) / l{a}{a} AS y{a}" for a in range(DIMS)]


DISTANCE = " + ".join(f"y{k} * y{k}" for k in range(DIMS))
RANKED = f"cast(floor({GRID} * least({DISTANCE}, {FARTHEST})) AS bigint)"
START = [f"(x{k} - d{k}) / greatest(1.4826 * a{k}, {FLOOR[k]}) AS y{k}" for k in range(DIMS)]


def _group() -> Column:
    # lengths keep apart names that hold the marks themselves
    return F.concat(*(F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")))


def _distances(vectors: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance of every row (columns g, x0..) to its group's estimate."""
    joined = vectors.join(estimate, "g", how)
    for item in _solved():
        joined = joined.selectExpr("*", item)
    return joined.selectExpr("*", f"{DISTANCE} AS distance")


def _estimates(vectors: DataFrame) -> DataFrame:
    """One row per group: mean m and Cholesky factor l of its minimum covariance determinant estimate."""
    middle = [F.expr(f"percentile(x{k}, 0.5) AS d{k}") for k in range(DIMS)]
    medians = stage(vectors.groupBy("g").agg(*middle), "medians")
    spread = [F.expr(f"percentile(abs(x{k} - d{k}), 0.5) AS a{k}") for k in range(DIMS)]
    joined = vectors.join(medians, "g")
    scales = stage(joined.groupBy("g").agg(*(F.expr(f"first(d{k}) AS d{k}") for k in range(DIMS)), *spread), "scales")
    distances = vectors.join(scales, "g").selectExpr("*", *START)
    for _ in range(STEPS + 1):
        ranked = distances.selectExpr("g", *(f"x{k}" for k in range(DIMS)), f"{RANKED} AS r")
        cut = stage(ranked.groupBy("g").agg(F.expr(f"percentile(r, {SHARE}) AS cut")), "cuts")
        kept = ranked.join(cut, "g").filter("r <= cut")
        estimate = kept.groupBy("g").agg(*map(F.expr, SUMS)).selectExpr("g", *MEANS)
        for items in _factor():
            estimate = estimate.selectExpr("*", *items)
        estimate = stage(estimate.select("g", *(f"m{k}" for k in range(DIMS)), *(f"l{a}{b}" for a, b in PAIRS)), "estimates")
        distances = _distances(vectors, estimate)
    return estimate


def _judged(docs: DataFrame, cutoff: float) -> DataFrame:
    """Every row in a struct ``row``, beside its statistics, ``base_failed`` and ``kept``."""
    grouped = docs.select(_group().alias("g"), "text")
    # filtered after it is written: a filter that Spark pushes below the statistics would compute them again
    vectors = stage(statistics(grouped, "g").selectExpr("g", "base_failed", *VALUES), "vectors").filter("NOT base_failed")
    estimate = stage_lookup(_estimates(vectors.drop("base_failed")), "estimate")
    rows = statistics(docs.select(_group().alias("g"), "text", F.struct("*").alias("row")), "g", "row").selectExpr("*", *VALUES)
    return _distances(rows, estimate, "left").withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false ELSE distance <= {cutoff} END"))


def annotate(docs: DataFrame, *, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``base``: a struct of the statistics, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rules fail and else tells whether the vector lies within ``cutoff``
    of the estimate for its language and source. A null text is empty; a null language or source is a group
    of its own; null keys and repeated rows are rows like others. Rows that fail the base rules do not
    enter the estimates. An empty table gives no rows. The statistics are computed twice, for the estimates and
    for the rows, so that texts are neither written nor shuffled (unless the table of one row per group is
    too large to broadcast).
    """
    return _judged(docs, cutoff).select("row.*", F.struct(*BASE, "base_failed", "kept").alias("base"))


def keep(docs: DataFrame, *, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that ``annotate`` would mark as kept, with their own columns, whatever the names of these."""
    return _judged(docs, cutoff).filter("kept").select("row.*")


def rate(docs: DataFrame, *, cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: ``doc_id``, the base statistics, ``base_failed`` and ``kept``; see ``annotate``.

    Texts are dropped before anything is written.
    """
    rows = stage(statistics(docs.select("doc_id", _group().alias("g"), "text"), "doc_id", "g"), "statistics")
    good = rows.filter("NOT base_failed").selectExpr("doc_id", "g", *BASE, "base_failed", *VALUES)
    judged = _distances(good, _estimates(good.select("g", *(f"x{k}" for k in range(DIMS)))))
    passed = judged.selectExpr("doc_id", *BASE, "base_failed", f"distance <= {cutoff} AS kept")
    return passed.unionByName(rows.filter("base_failed").selectExpr("doc_id", *BASE, "base_failed", "false AS kept"))


def check_sql(cutoff: float = CUTOFF) -> str:
    """The same result in DuckDB SQL; the statistics are computed by unnesting, the estimates by the same formulas."""
    q = lambda what, share: f"quantile_cont({what}, {share})"
    xs = ", ".join(f"x{k}" for k in range(DIMS))
    steps, last = [], "start"
    for i in range(STEPS + 1):
        chain = f"est{i}"
        steps += [
            f"ranked{i} AS (SELECT rid, g, {xs}, {RANKED} AS r FROM {last})",
            f"cut{i} AS (SELECT g, {q('r', SHARE)} AS cut FROM ranked{i} GROUP BY g)",
            f"sums{i} AS (SELECT g, {', '.join(SUMS)} FROM ranked{i} JOIN cut{i} USING (g) WHERE r <= cut GROUP BY g)",
            f"{chain} AS (SELECT g, {', '.join(MEANS)} FROM sums{i})",
        ]
        for j, items in enumerate(_factor()):
            steps.append(f"{chain}f{j} AS (SELECT *, {', '.join(items)} FROM {chain}{f'f{j - 1}' if j else ''})")
        steps.append(f"d{i} AS (SELECT v.*, e.* EXCLUDE (g, n) FROM vectors v JOIN {chain}f{len(_factor()) - 1} e USING (g))")
        for j, item in enumerate(_solved()):
            steps.append(f"d{i}y{j} AS (SELECT *, {item} FROM d{i}{f'y{j - 1}' if j else ''})")
        last = f"d{i}y{DIMS - 1}"
    group = " || ".join(f"coalesce('=' || {c}, '-')" for c in ("lang", "source"))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {group} AS g, coalesce(text, '') AS t FROM documents
    ), split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs
    ), win AS (
        SELECT rid, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s FROM split, unnest(range(1, len(w) - {WIDTH - 2})) AS u(i)
    ), again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
    ), repeats AS (
        SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(range(0, {WIDTH})) AS o(k) GROUP BY rid
    ), base AS (
        SELECT rid, doc_id, g, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
        FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS l FROM split) LEFT JOIN repeats USING (rid)
    ), ruled AS (
        SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM base
    ), vectors AS (SELECT rid, g, {', '.join(VALUES)} FROM ruled WHERE NOT base_failed
    ), medians AS (SELECT g, {', '.join(f"{q(f'x{k}', 0.5)} AS d{k}" for k in range(DIMS))} FROM vectors GROUP BY g
    ), scales AS (
        SELECT g, {', '.join(f'd{k}' for k in range(DIMS))}, {', '.join(f"{q(f'abs(x{k} - d{k})', 0.5)} AS a{k}" for k in range(DIMS))}
        FROM vectors JOIN medians USING (g) GROUP BY ALL
    ), start AS (SELECT v.*, {', '.join(START)} FROM vectors v JOIN scales USING (g)
    ), {', '.join(steps)}
    SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND {DISTANCE} <= {cutoff} AS kept
    FROM ruled LEFT JOIN {last} USING (rid)"""
