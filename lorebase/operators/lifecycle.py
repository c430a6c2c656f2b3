"""Document lifecycle as set operations over tables of commands, operations and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import ids
from lorebase.sources.staging import materialized

# fixed values: legal status edges, retention, retry policy
VERSION_EDGES = {
    "registered": ("ingesting", "deleted"),
    "ingesting": ("ready", "failed", "deleted"),
    "ready": ("superseded", "deleted"),
    "failed": ("ingesting", "deleted"),
    "superseded": ("ready", "deleted"),
    "deleted": (),
}
INGESTION_EDGES = {
    "pending": ("running", "cancelled"),
    "running": ("succeeded", "failed", "cancelled"),
    "succeeded": (),
    "failed": (),
    "cancelled": (),
}
RETENTION_DAYS = 30
UNFINISHED = ("pending", "running", "waiting_retry", "cancel_requested")
CONCURRENCY_CODES = (
    "document_revision_conflict", "lifecycle_fencing_conflict", "index_alias_conflict", "operation_lease_lost")
RETRYABLE_HTTP = (408, 409, 425, 429)
MAX_ATTEMPTS, CONCURRENCY_ATTEMPTS, BASE_SECONDS, MAX_SECONDS = 6, 3, 1, 300
SEGMENT = 1_024


def idempotent_commands(commands: DataFrame) -> DataFrame:
    """Outcome per command ``(tenant_id, key, seq, fingerprint)``: accepted, duplicate or conflict.

    The first command of a key is one aggregated row joined back; a hot key is combined map-side.
    """
    first = commands.groupBy("tenant_id", "key").agg(F.min(F.struct("seq", "fingerprint")).alias("first"))
    outcome = (
        F.when(F.col("seq") == F.col("first.seq"), "accepted")
        .when(F.col("fingerprint") == F.col("first.fingerprint"), "duplicate")
        .otherwise("conflict")
    )
    return commands.join(first, ["tenant_id", "key"]).select(
        "tenant_id", "key", "seq", ids.job_id(F.col("tenant_id"), F.col("key")).alias("job_id"), outcome.alias("outcome"))


def _chained(children: Column, identity: Column) -> Column:
    """The map of a run of maps, in order."""
    return F.aggregate(children, identity, lambda m, child: F.transform(m, lambda s: F.get(child["map"], s)))


def _befores(children: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state before every child of a run that begins in ``start``."""
    begin = F.struct(start.cast("int").alias("state"), F.expr("cast(array() AS array<int>)").alias("before"))
    passed = lambda acc, child: F.struct(
        step(acc["state"], child).cast("int").alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before"))
    return F.aggregate(children, begin, passed)["before"]


def replay(
    log: DataFrame,
    *,
    edges: dict[str, tuple[str, ...]] = VERSION_EDGES,
    initial: str = "registered",
    segment: int = SEGMENT,
    states: DataFrame | None = None,
) -> DataFrame:
    """Replay ``(entity_id, seq, status)`` through the status machine; one row per log entry.

    An illegal change (also to an unknown status) is rejected and leaves the state alone, so each entry depends on all before
    it. A run of entries acts on the state as a map from state to state, and such maps compose: the log is cut
    at multiples of ``segment`` of the unique ``seq``, every piece is reduced to its map, pieces to pieces of pieces, until one
    is left per entity; from there start states go back down. A row holds at most ``segment`` entries or maps, however hot
    the entity. ``states`` (``entity_id, state``) may give entities another start than ``initial``.
    """
    names = list(edges)
    number = {name: i for i, name in enumerate(names)}
    steps = [[t if names[t] in edges[names[s]] else s for t in range(len(names))] for s in range(len(names))]
    legal = F.array(*[F.array(*[F.lit(x) for x in row]) for row in steps])
    code = lambda c: F.create_map(*[x for name in names for x in (F.lit(name), F.lit(number[name]))])[c]
    after = lambda s, target: F.coalesce(F.get(F.get(legal, s), target), s)
    identity = F.array(*[F.lit(i) for i in range(len(names))])

    reach = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    low, high = reach["low"] or 0, reach["high"] or 0
    piece = F.floor((F.col("seq") - low) / segment).cast("long")
    entries = F.array_sort(F.collect_list(F.struct("seq", code(F.col("status")).alias("target"), "status")))
    pieces = log.groupBy("entity_id", piece.alias("piece")).agg(entries.alias("children"))
    moved = F.aggregate("children", identity, lambda m, e: F.transform(m, lambda s: after(s, e["target"])))
    levels = [materialized(pieces.select("*", moved.alias("map")), "replay-pieces")]
    width = (high - low) // segment + 1
    while width > 1:
        runs = F.array_sort(F.collect_list(F.struct("piece", "map")))
        upper = levels[-1].groupBy("entity_id", F.floor(F.col("piece") / segment).cast("long").alias("piece")).agg(runs.alias("children"))
        levels.append(materialized(upper.select("*", _chained(F.col("children"), identity).alias("map")), "replay-pieces"))
        width = -(-width // segment)

    starts = levels[-1].select("entity_id", "piece", F.lit(number[initial]).alias("start"))
    if states is not None:
        starts = starts.join(states, "entity_id", "left").select("entity_id", "piece", F.coalesce(code(F.col("state")), "start").alias("start"))
    for level in reversed(levels[1:]):
        before = _befores(F.col("children"), F.col("start"), lambda s, child: F.get(child["map"], s))
        spread = level.join(starts, ["entity_id", "piece"]).select("entity_id", F.explode(F.arrays_zip(F.col("children.piece").alias("piece"), before.alias("start"))).alias("c"))
        starts = spread.select("entity_id", "c.piece", "c.start")
    before = _befores(F.col("children"), F.col("start"), lambda s, e: after(s, e["target"]))
    done = levels[0].join(starts, ["entity_id", "piece"]).select("entity_id", F.explode(F.arrays_zip("children", before.alias("before"))).alias("c"))
    known = F.array(*map(F.lit, names))
    reached = F.get(F.get(legal, F.col("c.before")), F.col("c.children.target"))
    outcome = (
        F.when(F.col("c.before") == F.col("c.children.target"), "unchanged").when(reached == F.col("c.children.target"), "applied")
        .otherwise("document_version_transition_invalid"))
    return done.select(
        "entity_id", F.col("c.children.seq").alias("seq"), F.get(known, F.col("c.before")).alias("from_status"),
        F.col("c.children.status").alias("to_status"), outcome.alias("outcome"))


def replay_summary(replayed: DataFrame) -> DataFrame:
    """Final status, revision (applied changes) and rejected changes per entity."""
    after = F.when(F.col("outcome") == "applied", F.col("to_status")).otherwise(F.col("from_status"))
    return replayed.groupBy("entity_id").agg(
        F.max_by(after, "seq").alias("status"), F.count_if(F.col("outcome") == "applied").alias("revision"),
        F.count_if(F.col("outcome").endswith("invalid")).alias("rejected"))


def publish_versions(operations: DataFrame, documents: DataFrame, versions: DataFrame, projections: DataFrame) -> DataFrame:
    """Compare-and-set publication; one outcome per operation.

    Among valid operations for one revision the highest fencing token wins (then the larger id);
    the others see a newer revision. Delayed operations expect an old revision and cannot win.
    """
    checked = (
        operations.select("operation_id", "document_id", "document_version_id", "expected_revision", "fencing_token")
        .join(documents.select("document_id", "status", "revision"), "document_id", "left")
        .join(versions.select("document_version_id", F.col("document_id").alias("owner_document")), "document_version_id", "left")
        .join(projections, "document_version_id", "left")
        .withColumn("error_code",
            F.when(F.col("status").isNull() | F.col("owner_document").isNull(), "not_found")
            .when(F.col("owner_document") != F.col("document_id"), "document_version_scope_mismatch")
            .when(F.col("status") != "active", "document_deleted")
            .when(F.col("revision") != F.col("expected_revision"), "document_revision_conflict")
            .when(F.coalesce("chunk_count", F.lit(0)) < 1, "lifecycle_candidate_empty"))
    )
    winners = checked.filter(F.col("error_code").isNull()).groupBy("document_id").agg(
        F.max(F.struct("fencing_token", "operation_id")).alias("w"))
    outcome = F.coalesce(
        F.col("error_code"),
        F.when(F.col("operation_id") == F.col("w.operation_id"), "published").otherwise("document_revision_conflict"))
    return checked.join(winners, "document_id", "left").select(
        "operation_id", "document_id", "document_version_id", "expected_revision", outcome.alias("outcome"))


def apply_published(documents: DataFrame, versions: DataFrame, published: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New document and version tables: one ready version, the previous one superseded with a purge date."""
    done = published.filter("outcome = 'published'").select("document_id", F.col("document_version_id").alias("new_version"))
    docs = documents.join(done, "document_id", "left").select(
        "document_id", "status", F.coalesce("new_version", "current_version_id").alias("current_version_id"),
        (F.col("revision") + F.when(F.col("new_version").isNotNull(), 1).otherwise(0)).alias("revision"))
    chosen = F.col("document_version_id") == F.col("new_version")
    retired = F.col("new_version").isNotNull() & ~chosen & (F.col("status") == "ready")
    vers = versions.join(done, "document_id", "left").select(
        "document_id", "document_version_id",
        F.when(chosen, "ready").when(retired, "superseded").otherwise(F.col("status")).alias("status"),
        F.when(retired, now + F.make_dt_interval(F.lit(RETENTION_DAYS))).alias("purge_after"))
    return docs, vers


def rollback_check(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """A rollback target must be a superseded version of the same document."""
    found = versions.select("document_version_id", F.col("document_id").alias("owner_document"), F.col("status").alias("version_status"))
    outcome = (
        F.when(F.col("owner_document").isNull(), "not_found")
        .when((F.col("owner_document") != F.col("document_id")) | (F.col("version_status") != "superseded"), "rollback_target_invalid")
        .otherwise("accepted")
    )
    return requests.join(found, "document_version_id", "left").withColumn("outcome", outcome)


def soft_delete(requests: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Tombstones of the requested documents: status, next revision, purge date, fencing token."""
    wanted = requests.select("document_id").distinct()
    live = (F.col("status") == "active") & F.col("current_version_id").isNotNull()
    return documents.join(wanted, "document_id", "left_semi").select(
        "document_id", F.when(live, "delete_pending").otherwise(F.col("status")).alias("status"),
        (F.col("revision") + F.when(live, 1).otherwise(0)).alias("revision"),
        F.when(live, now + F.make_dt_interval(F.lit(RETENTION_DAYS))).otherwise(F.col("purge_after")).alias("purge_after"),
        F.when(live, "accepted").otherwise("document_deleted").alias("outcome"))


def restore_check(requests: DataFrame, documents: DataFrame, versions: DataFrame, projections: DataFrame, now: Column) -> DataFrame:
    """Restorable only while pending, before the purge date, with a usable, indexed target."""
    target = versions.select("document_version_id", F.col("status").alias("version_status"))
    outcome = (
        F.when(F.col("status").isNull(), "not_found")
        .when(
            (F.col("status") != "delete_pending") | F.col("purge_after").isNull() | (F.col("purge_after") <= now)
            | F.col("version_status").isNull() | (F.col("version_status") == "deleted"),
            "document_restore_expired",
        )
        .when(F.coalesce("chunk_count", F.lit(0)) < 1, "rollback_target_invalid")
        .otherwise("restored")
    )
    return (
        requests.select("operation_id", "document_id", "document_version_id")
        .join(documents.select("document_id", "status", "purge_after"), "document_id", "left")
        .join(target, "document_version_id", "left").join(projections, "document_version_id", "left")
        .withColumn("outcome", outcome)
    )


def purge_due(documents: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Objects to remove, each key once, for documents whose retention is over."""
    due = documents.filter((F.col("status") == "delete_pending") & (F.col("purge_after") <= now)).select("document_id")
    return versions.join(due, "document_id", "left_semi").groupBy("object_key").agg(
        F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("versions"))


def reconcile(
    operations: DataFrame, documents: DataFrame, versions: DataFrame, projections: DataFrame,
    objects: DataFrame, outbox: DataFrame, *, now: Column, stale_before: Column,
) -> DataFrame:
    """All drift findings ``(kind, resource_id)``; nothing is repaired here (dry run)."""
    stale = operations.filter(F.col("status").isin(*UNFINISHED) & (F.col("updated_at") < stale_before))
    known = (
        stale.select("operation_id", "document_id", "document_version_id")
        .join(documents.select("document_id", F.lit(True).alias("has_document")), "document_id", "left")
        .join(versions.select("document_version_id", "object_key"), "document_version_id", "left")
    )
    broken = F.col("has_document").isNull() | F.col("object_key").isNull()
    missing = known.filter(broken).select(F.lit("missing_authoritative_state").alias("kind"), F.col("operation_id").alias("resource_id"))
    counts = projections.groupBy("document_version_id").agg(F.count(F.lit(1)).alias("n"))
    stored = objects.select("object_key", F.lit(True).alias("stored"))
    drift = (
        known.filter(~broken).join(counts, "document_version_id", "left").join(stored, "object_key", "left")
        .filter(F.col("n").isNull() | F.col("stored").isNull())
        .select(F.lit("cross_store_drift").alias("kind"), F.col("operation_id").alias("resource_id"))
    )
    due = outbox.filter((F.col("status") == "pending") & (F.col("available_at") <= now)).select(
        F.lit("outbox_due").alias("kind"), F.col("outbox_id").alias("resource_id"))
    lost_objects = objects.join(versions.select("object_key"), "object_key", "left_anti").select(
        F.lit("orphan_object").alias("kind"), F.col("object_key").alias("resource_id"))
    lost_projections = projections.select("document_version_id").distinct().join(
        versions.select("document_version_id"), "document_version_id", "left_anti"
    ).select(F.lit("orphan_projection").alias("kind"), F.col("document_version_id").alias("resource_id"))
    expired = documents.filter((F.col("status") == "delete_pending") & (F.col("purge_after") <= now)).select(
        F.lit("expired_physical_cleanup").alias("kind"), F.col("document_id").alias("resource_id"))
    found = missing
    for part in (drift, due, lost_objects, lost_projections, expired):
        found = found.unionByName(part)
    return found


def repaired(table: DataFrame, findings: DataFrame, kind: str, key: str) -> DataFrame:
    """The table without the orphans of one finding kind."""
    gone = findings.filter(F.col("kind") == kind).select(F.col("resource_id").alias(key))
    return table.join(gone, key, "left_anti")


def batch_rollup(children: DataFrame, operations: DataFrame) -> DataFrame:
    """Batch status from its children ``(batch_id, operation_id)``; unknown children count as open."""
    status = F.col("status")
    counted = (
        children.join(operations.select("operation_id", "status"), "operation_id", "left")
        .groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "succeeded").alias("succeeded"),
            F.count_if(status.isin("failed", "dead_letter")).alias("failed"),
            F.count_if(status == "cancelled").alias("cancelled"))
    )
    total, ok, bad, cut = (F.col(c) for c in ("total", "succeeded", "failed", "cancelled"))
    return counted.withColumn(
        "status",
        F.when(ok + bad + cut < total, "running").when(cut == total, "cancelled").when(ok == total, "succeeded")
        .when(ok > 0, "partial_success").otherwise("failed"))


def due_outbox(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """Earliest due pending events; ``orderBy().limit()`` is a distributed top-k."""
    return (
        outbox.filter((F.col("status") == "pending") & (F.col("available_at") <= now))
        .orderBy("available_at", "outbox_id").limit(limit)
    )


def classify_failure(error: Column, http_status: Column) -> Column:
    """``struct<class,retryable>`` of a failure by its code, connection kind or HTTP status."""
    made = lambda name, retry: F.struct(F.lit(name).alias("class"), F.lit(retry).alias("retryable"))
    return (
        F.when(error.isNull() & http_status.isNull(), made("none", False))
        .when(error.isin("authorization", "not_found"), made("permanent", False))
        .when(error.isin(*CONCURRENCY_CODES), made("concurrency", True))
        .when(error.isin("TimeoutError", "ConnectionError"), made("transient", True))
        .when(http_status.isin(*RETRYABLE_HTTP) | (http_status >= 500), made("transient", True))
        .when(http_status.isNotNull() | error.contains("conflict"), made("permanent", False))
        .otherwise(made("unknown", False))
    )


def retry_plan(attempts: DataFrame, now: Column, jitter: Column | float = 1.0) -> DataFrame:
    """Next state of dispatched events ``(outbox_id, attempts, error, http_status, retry_after)``.

    ``jitter`` scales the exponential ceiling: ``F.rand()`` in production, 1 gives the ceiling.
    """
    jitter = jitter if isinstance(jitter, Column) else F.lit(jitter)
    attempt = F.col("attempts") + 1
    ceiling = F.least(F.lit(float(MAX_SECONDS)), BASE_SECONDS * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    # least/greatest skip nulls, so the missing header needs its own branch
    delay = F.when(
        F.col("retry_after").isNotNull(), F.least(F.greatest(F.lit(0.0), F.col("retry_after")), F.lit(float(MAX_SECONDS)))
    ).otherwise(ceiling * jitter)
    limit = F.when(F.col("failure.class") == "concurrency", CONCURRENCY_ATTEMPTS).otherwise(MAX_ATTEMPTS)
    again = F.col("failure.retryable") & (attempt < limit)
    return (
        attempts.withColumn("failure", classify_failure(F.col("error"), F.col("http_status")))
        .select(
            "outbox_id", attempt.alias("attempts"), F.col("failure.class").alias("failure_class"),
            F.when(F.col("failure.class") == "none", "published").when(again, "pending").otherwise("dead_letter").alias("status"),
            F.when(again, delay).otherwise(0.0).alias("delay_seconds"))
        .withColumn("available_at", F.when(F.col("status") == "pending", F.timestamp_micros(
            F.unix_micros(now) + (F.col("delay_seconds") * 1_000_000).cast("long"))))
    )
