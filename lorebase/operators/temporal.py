"""Series windows, similar windows, timelines, and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.sources.staging import materialized

# fixed values: alert rules and histogram bounds (seconds)
ERROR_RATE_LIMIT = 0.01
BACKLOG_LIMIT_SECONDS = 300
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def timeline(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Global order per series as a sort (range partitioned), not a per-series window."""
    return events.orderBy(*keys, at, tie)


def series_windows(points: DataFrame, window_seconds: int) -> DataFrame:
    """Tumbling windows anchored at the first point of each series.

    ``points``: series_id, event_id, at (timestamp), value (nullable). The anchor is an aggregate
    joined back (one row per series) and the features are partial aggregates, so a series with a
    third of all points is combined before it is shuffled.
    """
    anchor = points.groupBy("series_id").agg(F.min("at").alias("anchor"))
    width = window_seconds * 1_000_000
    index = F.floor((F.unix_micros("at") - F.unix_micros("anchor")) / width)
    order = F.struct(F.unix_micros("at").alias("t"), F.col("event_id"))
    edge = lambda pick: pick(F.when(F.col("value").isNotNull(), F.struct(order.alias("o"), "value")))["value"]
    present = F.count("value")
    return (
        points.join(anchor, "series_id")
        .groupBy("series_id", "anchor", index.alias("window_index"))
        .agg(
            present.alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
            F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"),
            F.when(present >= 2, (edge(F.max) - edge(F.min)) / (present - 1)).alias("trend"),
        )
        .withColumn("start_at", F.timestamp_micros(F.unix_micros("anchor") + F.col("window_index") * width))
        .drop("anchor")
    )


FEATURES = ("minimum", "maximum", "mean", "trend")


def similar_windows(windows: DataFrame, probes: DataFrame, top_k: int = 5) -> DataFrame:
    """Nearest windows of the same series by Euclidean distance on the features, itself included.

    ``probes`` are windows to look up (series_id, probe_index and the features).
    """
    w = windows.select("series_id", "window_index", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES]).alias("w")
    p = probes.select("series_id", F.col("window_index").alias("probe_index"), *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES]).alias("p")
    square = F.lit(0.0)
    for name in FEATURES:
        square = square + F.pow(F.col(f"w.{name}") - F.col(f"p.{name}"), 2)
    pairs = p.join(w, "series_id").select("series_id", "probe_index", "window_index", F.round(F.sqrt(square), 6).alias("distance"))
    order = Window.partitionBy("series_id", "probe_index").orderBy("distance", "window_index")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def error_rates(requests: DataFrame, at: str = "at", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Internal error share per window and whether it reaches the alert limit."""
    grouped = requests.groupBy(F.window(at, window, slide)) if slide else requests.groupBy(F.window(at, window))
    rate = F.col("errors") / F.col("requests")
    return (
        grouped.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
        .select(F.col("window.start").alias("window_start"), "requests", "errors", rate.alias("error_rate"),
                (rate >= ERROR_RATE_LIMIT).alias("alert"))
    )


def _bracketed(samples: DataFrame, states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The samples inside the bracket of their group, with its state; a null edge is open."""
    v = F.col(value)
    inside = (F.col("low").isNull() | (v >= F.col("low"))) & (F.col("high").isNull() | (v <= F.col("high")))
    return samples.select(*keys, value).join(states, keys).filter(inside)


def _narrowed(samples: DataFrame, states: DataFrame, keys: list[str], value: str, accuracy: int) -> DataFrame:
    """One round: the bracket shrinks to about three hundredths of its samples around the wanted rank.

    Edges come from a mergeable sketch; what lies below and between them is then counted exactly. Where the sketch missed the rank,
    or equal values leave nothing to cut, the group keeps its bracket and is done.
    """
    grid = F.percentile_approx(value, F.array(*(F.lit(i / 100) for i in range(101))), accuracy)
    held = _bracketed(samples, states, keys, value)
    at = F.floor(100 * (F.col("j") - F.col("skipped")) / F.col("inside"))
    edges = held.groupBy(*keys).agg(grid.alias("grid")).join(states, keys).select(
        *keys, F.get("grid", F.greatest(F.lit(0), at - 1).cast("int")).alias("new_low"), F.get("grid", F.least(F.lit(100), at + 2).cast("int")).alias("new_high"))
    v = F.col(value)
    counts = held.join(edges, keys).groupBy(*keys, "new_low", "new_high").agg(
        F.count_if(v < F.col("new_low")).alias("under"), F.count_if((v >= F.col("new_low")) & (v <= F.col("new_high"))).alias("within"))
    reached = F.col("skipped") + F.col("under")
    good = (reached < F.col("j")) & (reached + F.col("within") >= F.least(F.col("j") + 1, F.col("n"))) & (F.col("within") < F.col("inside"))
    pick = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
    return states.join(counts, keys).select(
        *keys, "n", "j", pick(F.col("new_low"), "low"), pick(F.col("new_high"), "high"), pick(reached, "skipped"),
        pick(F.col("within"), "inside"), (~good).alias("done"))


def exclusive_quantile(
    samples: DataFrame, keys: list[str], value: str, q: float = 0.95, *, accuracy: int = 10_000, bracket_rows: int = 10_000
) -> DataFrame:
    """Exclusive quantile: position (n+1)q, clamped to [1, n-1], linear between neighbours.

    With few samples it may extrapolate beyond the maximum; a single sample is its own quantile.

    Exact without sorting a group: a bracket around the wanted rank is narrowed, round by round, until it holds at most
    ``bracket_rows`` samples or equal ones only; what lies below is counted. The running count of values is taken inside the
    bracket, so no task orders more than that, however large a group.
    """
    m = q * 100
    position = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * m / 100), F.col("n") - 1))
    kind = dict(samples.dtypes)[value]
    states = materialized(
        samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
            *keys, "n", position.alias("j"), F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"), F.lit(0).cast("long").alias("skipped"),
            F.col("n").alias("inside"), F.lit(False).alias("done")),
        "quantile-brackets")
    while True:
        wide = (F.col("inside") > bracket_rows) & ~F.col("done")
        if states.filter(wide).isEmpty():
            break
        states = materialized(states.filter(~wide).unionByName(_narrowed(samples, states.filter(wide), keys, value, accuracy)), "quantile-brackets")
    counted = _bracketed(samples, states, keys, value).groupBy(*keys, "n", "j", "skipped", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("c").over(running) + F.col("skipped"))
    first_at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    picked = upto.groupBy(*keys, "n", "j").agg(first_at(F.col("j")).alias("lo"), first_at(F.col("j") + 1).alias("hi"))
    delta = (F.col("n") + 1) * m - F.col("j") * 100
    return picked.select(
        *keys, "n",
        F.when(F.col("n") == 1, F.col("lo")).otherwise((F.col("lo") * (100 - delta) + F.col("hi") * delta) / 100).alias("p95"),
    )


def duration_histogram(samples: DataFrame, keys: list[str], seconds: Column, bounds: tuple[float, ...] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative bucket counts, total and sum per label set; one aggregation."""
    buckets = [F.count_if(seconds <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return samples.groupBy(*keys).agg(*buckets, F.count(F.lit(1)).alias("total"), F.sum(seconds).alias("sum_seconds"))


def backlog_age(items: DataFrame, keys: list[str], now: Column, pending: Column, due: str) -> DataFrame:
    """Age of the oldest pending item per queue and whether it is stale."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.min(F.when(pending, F.col(due))))) / 1_000_000)
    return items.groupBy(*keys).agg(F.coalesce(age, F.lit(0.0)).alias("age_seconds")).withColumn(
        "stale", F.col("age_seconds") > BACKLOG_LIMIT_SECONDS)
