"""Query plans, evidence decisions and answers over tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import fold, injection_flag, let, lexical_keywords, strip

# fixed values: markers, connectors and the fixed answers
COMPLEX_MARKERS = ("并且", "以及", "比较", "对比", "分别", " and ", " compare ")
CONNECTORS = "并且|以及|同时|;|,"
VERIFY_PREFIX = "核对并补充: "
PARTIAL_PREFIX = "仅获得部分证据:\n"
CONFLICT_ANSWER = "检索到尚未解决的冲突证据, 无法给出单一确定结论。"
NO_EVIDENCE_ANSWER = "未检索到足够的授权证据。"
BUDGET_ANSWER = "运行预算已耗尽, 且没有足够证据完成回答。"
MAX_PLAN_STEPS = 8


def query_variants(queries: DataFrame, provided: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """Canonical text, rewrites, translations, keyword text, provided keywords; distinct ignoring case.

    ``provided`` (query_id, kind, item_no, text) holds what a transform model returned; a missing
    row is a provider failure and leaves the canonical variant. Variants of a query are few, so
    they are ordered inside one row.
    """
    keywords = F.array_join(lexical_keywords(F.col("text")), " ")
    base = queries.select("query_id", "text", keywords.alias("lexical"))
    if provided is not None:
        order = F.when(F.col("kind") == "rewrite", 1).when(F.col("kind") == "translation", 2).otherwise(4)
        extra = provided.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct(order.alias("place"), F.col("item_no").alias("item"), "kind", "text"))).alias("extra"))
        base = base.join(extra, "query_id", "left")
    else:
        base = base.withColumn("extra", F.expr("cast(null as array<struct<place:int,item:int,kind:string,text:string>>)"))
    variant = lambda place, kind, text: F.struct(
        F.lit(place).alias("place"), F.lit(0).alias("item"), F.lit(kind).alias("kind"), text.alias("text"))
    own = F.array(variant(0, "canonical", F.col("text")), variant(3, "keyword", F.col("lexical")))
    merged = F.array_sort(F.concat(own, F.coalesce("extra", F.slice(own, 1, 0))))

    def distinct(items: Column) -> Column:
        usable = F.filter(items, lambda v: (v["text"] != "") & ~((v["place"] == 3) & (v["text"] == fold(F.col("text")))))
        return let(
            usable,
            lambda xs: let(
                F.transform(xs, lambda v: fold(v["text"])),
                lambda keys: F.filter(xs, lambda v, i: F.array_position(keys, fold(v["text"])) == i + 1),
            ),
        )

    return base.select("query_id", F.posexplode(F.slice(let(merged, distinct), 1, limit)).alias("variant_no", "v")).select(
        "query_id", "variant_no", "v.kind", "v.text")


def plan_steps(queries: DataFrame) -> DataFrame:
    """Split complex questions into at most three critical steps."""
    question = strip(F.col("text"))
    lower = F.lower(question)
    complex_ = F.lit(False)
    for marker in COMPLEX_MARKERS:
        complex_ = complex_ | F.contains(lower, F.lit(marker))
    unified = F.replace(F.replace(question, F.lit("，"), F.lit(",")), F.lit("；"), F.lit(";"))
    parts = F.transform(
        F.filter(F.split(unified, CONNECTORS), lambda p: strip(p) != ""), lambda p: F.trim(p, F.lit(" ,;")))
    steps = F.when(
        complex_,
        let(parts, lambda xs: F.when(F.size(xs) < 2, F.array(question, F.concat(F.lit(VERIFY_PREFIX), question))).otherwise(F.slice(xs, 1, 3))),
    ).otherwise(F.array(question))
    return queries.select("query_id", (~complex_).alias("is_simple"), F.posexplode(steps).alias("pos", "question")).select(
        "query_id", "is_simple", F.concat(F.lit("q"), F.col("pos") + 1).alias("step_id"), "question")


def plan_violations(steps: DataFrame) -> DataFrame:
    """Defects of plans ``(run_id, pos, step_id, depends_on[], is_simple)``."""
    key = ["run_id", "step_id"]
    per_run = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("is_simple").alias("simple"))
    too_many = per_run.filter(F.col("n") > MAX_PLAN_STEPS).select(
        "run_id", F.lit("").alias("step_id"), F.lit("too_many_steps").alias("violation"))
    simple = per_run.filter(F.col("simple") & (F.col("n") != 1)).select(
        "run_id", F.lit("").alias("step_id"), F.lit("simple_plan_has_many_steps").alias("violation"))
    repeated = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *key, F.lit("duplicate_step_id").alias("violation"))
    first = steps.groupBy("run_id", F.col("step_id").alias("parent")).agg(F.min("pos").alias("parent_pos"))
    needed = steps.select("run_id", "step_id", "pos", F.explode("depends_on").alias("parent"))
    backwards = needed.join(first, ["run_id", "parent"], "left").filter(
        F.col("parent_pos").isNull() | (F.col("parent_pos") >= F.col("pos"))
    ).select(*key, F.lit("dependency_not_earlier").alias("violation")).distinct()
    return too_many.unionByName(simple).unionByName(repeated).unionByName(backwards)


def eligible(evidence: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Authorised, current, scored, cited evidence of the run's tenant without injected text."""
    return evidence.filter(
        (F.col("tenant_id") == F.col("run_tenant_id"))
        & F.col("authorized")
        & F.col("active_version")
        & (F.col("score") >= minimum)
        & ~F.col("injection_detected")
        & ~injection_flag(F.col("excerpt"))
        & ((F.col("source_kind") != "knowledge") | F.col("citation_id").isNotNull())
    )


def decide(evidence: DataFrame, steps: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Sufficiency per run: conflict, then none, then partial, then sufficient.

    Pure aggregations per (run, step) and (run, fact); a hot run is combined map-side.
    """
    usable = eligible(evidence, minimum)
    covered = usable.groupBy("run_id", "step_id").agg(F.count(F.lit(1)).alias("n"))
    critical = steps.filter("critical").select("run_id", "step_id").distinct()
    coverage = critical.join(covered, ["run_id", "step_id"], "left").groupBy("run_id").agg(
        F.count_if(F.col("n").isNotNull()).alias("covered_steps"), F.count_if(F.col("n").isNull()).alias("missing_steps"))
    stance = F.lower(strip(F.col("stance")))
    conflicts = (
        usable.filter((F.coalesce("fact_key", F.lit("")) != "") & (F.coalesce("stance", F.lit("")) != ""))
        .groupBy("run_id", "fact_key").agg(F.min(stance).alias("lo"), F.max(stance).alias("hi"))
        .filter("lo <> hi").groupBy("run_id").agg(F.count(F.lit(1)).alias("conflicts"))
    )
    counts = usable.groupBy("run_id").agg(F.count(F.lit(1)).alias("eligible"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(zero("conflicts") > 0, "conflicting_evidence")
        .when(zero("eligible") == 0, "no_evidence")
        .when(zero("missing_steps") > 0, "partial_evidence")
        .otherwise("sufficient")
    )
    runs = steps.select("run_id").distinct()
    return (
        runs.join(coverage, "run_id", "left").join(conflicts, "run_id", "left").join(counts, "run_id", "left")
        .select("run_id", zero("eligible").alias("eligible"), zero("covered_steps").alias("covered_steps"),
                zero("missing_steps").alias("missing_steps"), zero("conflicts").alias("conflicts"), status.alias("status"))
    )


def retry_decision(status: Column, rounds: Column, max_rounds: Column, last_tool_status: Column) -> Column:
    return (
        status.isin("partial_evidence", "no_evidence")
        & (rounds < max_rounds)
        & (last_tool_status.isNull() | (last_tool_status != "reused"))
    )


def assemble_answers(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answer text per run: cited excerpts in order, or the fixed text of the status.

    Evidence of one run is bounded by the retrieval and tool budgets of a run.
    """
    lines = (
        evidence.filter(F.col("citation_id").isNotNull())
        .select("run_id", "evidence_no", F.concat(F.lit("["), "citation_id", F.lit("] "), "excerpt").alias("line"))
        .groupBy("run_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_no", "line"))), lambda e: e["line"]), "\n").alias("lines"))
    )
    body = F.coalesce("lines", F.lit(""))
    answer = (
        F.when(F.col("status") == "sufficient", body)
        .when(F.col("status") == "partial_evidence", F.concat(F.lit(PARTIAL_PREFIX), body))
        .when(F.col("status") == "conflicting_evidence", F.lit(CONFLICT_ANSWER))
        .when(F.col("status") == "no_evidence", F.lit(NO_EVIDENCE_ANSWER))
        .otherwise(F.lit(BUDGET_ANSWER))
    )
    return decisions.join(lines, "run_id", "left").select("run_id", "status", answer.alias("answer"))
