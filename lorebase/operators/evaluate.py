"""Retrieval and answer metrics, scenario reports and release gates.

A run is ``(query_id, rank, item_id)``, judgements are ``(query_id, item_id, relevance)``; both join
on (query, item). ``queries`` lists every query, so those without results or judgements count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: gate thresholds
RELEASE_CHECKS = (
    ("cross_tenant_violations", "zero", 0.0), ("critical_security_violations", "zero", 0.0),
    ("recovery_failures", "zero", 0.0), ("retrieval_recall_at_10", "at_least", 0.90),
    ("answer_faithfulness", "at_least", 0.90), ("citation_recall", "at_least", 0.95),
    ("internal_error_rate", "below", 0.01),
)
SCENARIO_MINIMUM = {
    "overall_pass_rate": 0.90, "tool_validity": 0.90, "evidence_accuracy": 0.95, "citation_coverage": 0.95, "groundedness": 0.90}


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["query_id", "item_id"], "left").withColumn("hit", F.col("relevance").isNotNull())


def _per_query(queries: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = queries.select("query_id").distinct()
    for part in parts:
        out = out.join(part, "query_id", "left")
    return out


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def precision_at_k(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Hits in the first ``k`` divided by ``k``, however few were retrieved."""
    hits = _judged(run.filter(F.col("rank") <= k), qrels).groupBy("query_id").agg(F.count_if("hit").alias("hits"))
    return _per_query(queries, [hits]).select("query_id", (_zero("hits") / k).alias("precision"))


def recall_at_k(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Distinct relevant items found; without relevant items 1 if nothing was retrieved, else 0."""
    top = run.filter(F.col("rank") <= k).groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    found = _judged(top, qrels).groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("retrieved"))
    wanted = qrels.groupBy("query_id").agg(F.count_distinct("item_id").alias("wanted"))
    recall = F.when(_zero("wanted") == 0, F.when(_zero("retrieved") == 0, 1.0).otherwise(0.0)).otherwise(_zero("hits") / F.col("wanted"))
    return _per_query(queries, [found, wanted]).select("query_id", recall.alias("recall"))


def reciprocal_ranks(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    scoped = run if k is None else run.filter(F.col("rank") <= k)
    first = _judged(scoped, qrels).filter("hit").groupBy("query_id").agg(F.min("rank").alias("first"))
    return _per_query(queries, [first]).select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_reciprocal_rank(queries: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    return reciprocal_ranks(queries, run, qrels).agg(F.avg("reciprocal_rank").alias("mrr"))


def ndcg_at_k(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Graded nDCG with gain 2^rel - 1; 0 when nothing is relevant.

    The ideal order only needs how many items of each grade exist, so it is a sum over positions of
    at most ``k`` per query.
    """
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    dcg = _judged(run.filter(F.col("rank") <= k), qrels).groupBy("query_id").agg(
        F.sum(gain(F.coalesce("relevance", F.lit(0)), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "item_id")
    ideal = qrels.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).groupBy("query_id").agg(
        F.sum(gain(F.col("relevance"), F.col("place"))).alias("ideal"))
    value = F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"))
    return _per_query(queries, [dcg, ideal]).select("query_id", value.alias("ndcg"))


def binary_ranking(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Binary metrics: repeated hits count, reciprocal rank stops at ``k``, empty relevance scores 1."""
    discount = 1 / F.log2(F.col("rank") + 1)
    found = _judged(run.filter(F.col("rank") <= k), qrels).groupBy("query_id").agg(
        F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit"), discount)).alias("dcg"))
    wanted = qrels.groupBy("query_id").agg(F.count_distinct("item_id").alias("wanted"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(_zero("wanted").cast("int"), F.lit(k)), F.lit(1))),
        F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))
    none = _zero("wanted") == 0
    return _per_query(queries, [found, wanted]).select(
        "query_id",
        F.when(none, 1.0).otherwise(_zero("hits") / F.col("wanted")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(none, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def citation_scores(queries: DataFrame, predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision and recall of cited items. Precision is 1 when neither side cites anything, recall
    is 1 when nothing was expected."""
    p, e = predicted.select("query_id", "item_id").distinct(), expected.select("query_id", "item_id").distinct()
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    both = p.join(e, ["query_id", "item_id"], "left_semi")
    joined = _per_query(queries, [count(p, "np"), count(e, "ne"), count(both, "nb")])
    no_claim = (_zero("np") == 0) & (_zero("ne") == 0)
    precision = F.when(no_claim, 1.0).otherwise(_zero("nb") / F.greatest(F.lit(1), _zero("np")))
    recall = F.when(_zero("ne") == 0, 1.0).otherwise(_zero("nb") / F.col("ne"))
    return joined.select("query_id", precision.alias("citation_precision"), recall.alias("citation_recall"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Scores of ``(answer_id, expected, stated, supported [arrays], should_refuse, refused)`` rows."""
    share = lambda a, b, base: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(base)))
    return answers.select(
        "answer_id", share("stated", "expected", "expected").alias("correctness"),
        share("stated", "supported", "stated").alias("faithfulness"),
        (F.col("should_refuse") == F.col("refused")).alias("refusal_correct"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def scenario_report(results: DataFrame) -> DataFrame:
    """One row of scenario metrics and the gate; a single partial aggregation."""
    tool = F.col("tool_expected").isNotNull()
    tool_ok = tool & F.col("tool_selected").eqNullSafe(F.col("tool_expected")) & F.coalesce("parameters_valid", F.lit(True))
    weak = F.col("expected_status").isin("no_evidence", "partial_evidence")
    counted = results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"),
        F.count_if(tool).alias("tools"), F.count_if(tool_ok).alias("tools_ok"),
        F.count_if(weak).alias("weak"), F.count_if(weak & (F.col("expected_status") == F.col("actual_status"))).alias("weak_ok"),
        F.sum("important").alias("important"), F.sum("cited").alias("cited"), F.sum("grounded").alias("grounded"),
        F.count_if(F.col("safety_critical") & F.col("violation")).alias("violations"),
        F.count_if(F.col("safety_critical") & ~F.col("passed")).alias("unsafe_failures"))
    c = F.col
    metrics = counted.select(
        _ratio(c("ok"), c("n")).alias("overall_pass_rate"), _ratio(c("tools_ok"), c("tools")).alias("tool_validity"),
        _ratio(c("weak_ok"), c("weak")).alias("evidence_accuracy"), _ratio(c("cited"), c("important")).alias("citation_coverage"),
        _ratio(c("grounded"), c("important")).alias("groundedness"), "violations", "unsafe_failures")
    gate = (c("violations") == 0) & (c("unsafe_failures") == 0)
    for name, minimum in SCENARIO_MINIMUM.items():
        gate = gate & (c(name) >= minimum)
    return metrics.withColumn("gate_passed", gate).drop("unsafe_failures")


def release_gate(metrics: DataFrame, checks=RELEASE_CHECKS) -> DataFrame:
    """Every check per release; a missing metric fails. ``metrics``: release, metric, value."""
    spark = metrics.sparkSession
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(checks)], "check_no int, metric string, rule string, bound double")
    every = metrics.select("release").distinct().withColumn("metric", F.explode(F.array(*[F.lit(c[0]) for c in checks])))
    failed = (
        F.when(F.col("value").isNull(), True)
        .when(F.col("rule") == "zero", F.col("value").cast("long") != 0)
        .when(F.col("rule") == "at_least", F.col("value") < F.col("bound"))
        .otherwise(F.col("value") >= F.col("bound"))
    )
    return (
        every.join(F.broadcast(table), "metric").join(metrics, ["release", "metric"], "left").withColumn("failed", failed)
        .groupBy("release").agg(
            F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("check_no", "metric")))).alias("f"))
        .select("release", (F.size("f") == 0).alias("passed"), F.array_join(F.transform("f", lambda x: x["metric"]), ",").alias("failures"))
    )


def ablation(queries: DataFrame, runs: dict[str, DataFrame], qrels: DataFrame, k: int) -> DataFrame:
    """Mean metrics per channel side by side. All channels run as one: channel is part of the key."""
    names = list(runs)
    tag = lambda df, name: df.withColumn("query_id", F.concat_ws("@", F.lit(name), "query_id"))
    every = F.explode(F.array(*[F.lit(n) for n in names])).alias("channel")
    widen = lambda df: df.select("*", every).withColumn("query_id", F.concat_ws("@", "channel", "query_id")).drop("channel")
    run = None
    for name, df in runs.items():
        part = tag(df.select("query_id", "rank", "item_id"), name)
        run = part if run is None else run.unionByName(part)
    q, rels = widen(queries.select("query_id")), widen(qrels.select("query_id", "item_id", "relevance"))
    scored = binary_ranking(q, run, rels, k)
    return scored.withColumn("channel", F.split("query_id", "@")[0]).groupBy("channel").agg(
        F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg("ndcg").alias("ndcg"))
