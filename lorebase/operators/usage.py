"""Usage budgets, run costs, and consent-governed memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import FORBIDDEN_MEMORY, strip

# fixed values: default limits, in the order in which one event is charged
LIMITS = {
    "agent_iterations": 8, "model_calls": 6, "total_tokens": 50_000, "generated_tokens": 8_000,
    "known_cost": 0.50, "retrieval_rounds": 3, "tool_attempts": 10, "active_runtime": 120.0,
}
MEMORY_DAYS, MEMORY_LENGTH = 90, 2_000
SEGMENT = 10_000


def event_cost(rate_in: float, rate_out: float) -> Column:
    return (F.col("input_tokens") * rate_in + F.col("generated_tokens") * rate_out) / 1_000_000


def running_totals(events: DataFrame, amounts: dict[str, Column], segment: int = SEGMENT) -> DataFrame:
    """Running sums per run over ``seq`` (unique in a run).

    A run is cut at multiples of ``segment``; sums run inside a piece and are shifted by the totals
    of earlier pieces, so even one endless run is never a single task.
    """
    df = events.withColumns({name: amount for name, amount in amounts.items()}).withColumn(
        "piece", F.floor(F.col("seq") / segment))
    before = Window.partitionBy("run_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("run_id", "piece").agg(*[F.sum(n).alias(n) for n in amounts]).select(
        "run_id", "piece", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in amounts])
    within = Window.partitionBy("run_id", "piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{n}_within": F.sum(n).over(within) for n in amounts}).join(offsets, ["run_id", "piece"]).withColumns(
        {f"{n}_total": F.col(f"{n}_within") + F.col(f"{n}_before") for n in amounts})


def first_breach(events: DataFrame, amounts: dict[str, Column], limits: dict[str, float] = LIMITS) -> DataFrame:
    """The event and the dimension at which each run first exceeds a limit."""
    totals = running_totals(events, amounts)
    dimension = F.lit(None).cast("string")
    for name in reversed([n for n in limits if n in amounts]):
        dimension = F.when(F.round(F.col(f"{name}_total"), 9) > limits[name], name).otherwise(dimension)
    breached = totals.withColumn("dimension", dimension).filter(F.col("dimension").isNotNull())
    return breached.groupBy("run_id").agg(F.min(F.struct("seq", "dimension")).alias("b")).select("run_id", "b.seq", "b.dimension")


def run_cost(events: DataFrame, cost: Column) -> DataFrame:
    """Known cost and merged status: any unknown wins, then any known, else local."""
    status = F.col("cost_status")
    return events.groupBy("run_id").agg(
        F.sum(F.when(status == "known", cost).otherwise(0.0)).alias("known_cost_usd"),
        F.sum(F.col("input_tokens") + F.col("generated_tokens")).alias("total_tokens"),
        F.when(F.max(status == "unknown"), "unknown").when(F.max(status == "known"), "known").otherwise("local").alias("cost_status"))


def active_memories(memories: DataFrame, consents: DataFrame, now: Column, days: int = MEMORY_DAYS) -> DataFrame:
    """Memories that exist and may be read at ``now``.

    Revoking consent deletes what the user had; storing needs consent at that moment, a valid
    length and no secret-like words; reading needs the latest consent and an unexpired memory. The
    consent history of a user is reduced to two instants by aggregation.
    """
    state = consents.groupBy("user_id").agg(
        F.max_by("enabled", F.struct("at", "enabled")).alias("enabled"),
        F.max(F.when(~F.col("enabled"), F.col("at"))).alias("revoked_at"))
    since = (
        consents.filter("enabled").join(state.filter("enabled").select("user_id", "revoked_at"), "user_id")
        .filter(F.col("revoked_at").isNull() | (F.col("at") > F.col("revoked_at")))
        .groupBy("user_id").agg(F.min("at").alias("consented_at"))
    )
    content = strip(F.col("content"))
    valid = (content != "") & (F.length(content) <= MEMORY_LENGTH) & ~content.rlike(FORBIDDEN_MEMORY)
    kept = memories.filter(
        valid & F.col("deleted_at").isNull() & (F.col("created_at") + F.make_dt_interval(F.lit(days)) > now))
    return kept.join(since, "user_id").filter(F.col("created_at") >= F.col("consented_at"))
