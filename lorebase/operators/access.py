"""Permission and policy decisions over tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.predicates import access_allowed, permission_reason, searchable
from lorebase.sources.staging import materialized


def scope_filter(records: DataFrame, scopes: DataFrame) -> DataFrame:
    """Records inside the hard scope of each request ``(query_id, tenant_id, knowledge_base_ids)``.

    An equi-join on tenant and knowledge base, with the liveness rules applied to the records
    before the join.
    """
    wanted = scopes.select("query_id", "tenant_id", F.explode("knowledge_base_ids").alias("knowledge_base_id"))
    return records.filter(searchable()).join(wanted, ["tenant_id", "knowledge_base_id"])


def acl_filter(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of the tenant each request may see."""
    r, q = records.alias("r"), requests.alias("q")
    return r.join(
        q,
        (F.col("r.tenant_id") == F.col("q.tenant_id")) & access_allowed("r", F.col("q.actor_id"), F.col("q.roles")),
    )


def permission_decisions(requests: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """Ordered permission rules per (request, resource)."""
    q, r = requests.alias("q"), resources.alias("r")
    reason = permission_reason(
        F.col("q.tenant_id"), F.col("q.actor_id"), F.col("r.tenant_id"), F.col("r.owner_id"),
        F.col("r.visibility"), F.col("q.action"),
    )
    return q.join(r, key).select("q.*", reason.alias("reason")).withColumn(
        "allowed", F.col("reason").endswith("_allowed"))


def policy_audit(calls: DataFrame, registrations: DataFrame) -> DataFrame:
    """Tool policy over a call log: deny rules first, then approval, else allow.

    An empty allow-list means no restriction. Registrations are a handful of rows (checked by the
    planner's size threshold, no forced broadcast).
    """
    r = registrations
    none = lambda c: F.size(c) == 0
    decision = (
        F.when(~none("allowed_tenant_ids") & ~F.array_contains("allowed_tenant_ids", F.col("tenant_id")), "deny:tenant_not_allowed")
        .when(~none("allowed_roles") & ~F.arrays_overlap("roles", "allowed_roles"), "deny:role_not_allowed")
        .when(
            ~none("allowed_scopes") & ~F.coalesce(F.array_contains("allowed_scopes", F.col("business_scope")), F.lit(False)),
            "deny:business_scope_not_allowed",
        )
        .when(
            F.col("requires_hitl") | (F.col("effect") == "side_effecting") | F.col("risk_level").isin("high", "critical"),
            "require_approval:high_risk_or_side_effecting",
        )
        .otherwise("allow:registered_read_only_tool")
    )
    return calls.join(r, "tool_name").withColumn("decision", decision)


def call_reuse(calls: DataFrame) -> DataFrame:
    """Outcome of repeated tool calls ``(tenant_id, actor_id, call_id, seq, tool, digest, ok)``.

    A call id seen before with another digest is a collision; the same id and digest replays; an
    identical signature that already succeeded is reused; anything else runs. All state is a first
    occurrence per key, taken by aggregation and joined back, so no key is sorted in one task.
    """
    call, signature = ["tenant_id", "actor_id", "call_id"], ["tenant_id", "actor_id", "tool", "digest"]
    first_call = calls.groupBy(*call).agg(F.min(F.struct("seq", "digest")).alias("first"))
    ran = calls.join(first_call, call).withColumn("is_first", F.col("seq") == F.col("first.seq"))
    first_ok = ran.filter("is_first and ok").groupBy(*signature).agg(F.min("seq").alias("ok_seq"))
    outcome = (
        F.when(~F.col("is_first") & (F.col("digest") != F.col("first.digest")), "collision")
        .when(~F.col("is_first"), "replayed")
        .when(F.col("ok_seq") < F.col("seq"), "reused")
        .otherwise("executed")
    )
    return ran.join(first_ok, signature, "left").withColumn("outcome", outcome).drop("first", "is_first", "ok_seq")


INVALID_FILTER = "invalid"


def filter_fingerprints(nodes: DataFrame) -> DataFrame:
    """``filter_id, digest, n_leaves``: one digest per filter tree, the same for every order of the children of ``and`` and ``or``.

    ``nodes``: ``filter_id, node_id, parent_id`` (null at the root), ``op, field, value`` (null for groups). Trees are hashed from the
    leaves up, a level a round and all trees at once: a leaf by its field, operator and value, a group by its operator and the sorted
    digests of its children. A tree that never closes (a group without children, a missing parent, a cycle, ``not`` with
    other than one child, several roots) has the digest ``invalid``. The digest is 16 hexadecimal digits long.
    """
    key = ["filter_id", "node_id"]
    rows = materialized(nodes.select(*key, "parent_id", "op", "field", "value"), "filter-nodes")
    leaf = F.sha2(F.to_json(F.struct("field", "op", "value")), 256)
    group = F.col("op").isin("and", "or", "not")
    done = rows.filter(~group).select(*key, "parent_id", leaf.alias("hash"))
    sizes = rows.groupBy("filter_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    open_groups = materialized(
        rows.filter(group).join(sizes, key).filter("op <> 'not' OR children = 1").select(*key, "parent_id", "op", "children"), "filter-groups")
    done = materialized(done, "filter-hashes")
    while not open_groups.isEmpty():
        below = done.groupBy("filter_id", F.col("parent_id").alias("node_id")).agg(
            F.count(F.lit(1)).alias("known"), F.array_sort(F.collect_list("hash")).alias("hashes"))
        closed = open_groups.join(below, key).filter("known = children").select(
            *key, "parent_id", F.sha2(F.concat_ws(",", F.col("op"), F.col("hashes")), 256).alias("hash"))
        closed = materialized(closed, "filter-hashes")
        if closed.isEmpty():
            break
        open_groups = materialized(open_groups.join(closed.select(*key), key, "left_anti"), "filter-groups")
        done = materialized(done.unionByName(closed), "filter-hashes")
    roots = done.filter("parent_id IS NULL").groupBy("filter_id").agg(F.max("hash").alias("hash"))
    shape = rows.groupBy("filter_id").agg(
        F.count_if(~group).alias("n_leaves"), F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"))
    closed = done.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n_closed"))
    groups = rows.filter(group).select("filter_id", F.col("node_id").alias("parent_id"))
    lost = rows.filter("parent_id IS NOT NULL").join(groups, ["filter_id", "parent_id"], "left_anti").groupBy("filter_id").agg(F.lit(True).alias("lost"))
    whole = (F.col("n_roots") == 1) & (F.col("n_closed") == F.col("n_nodes")) & F.col("lost").isNull()
    return shape.join(closed, "filter_id", "left").join(roots, "filter_id", "left").join(lost, "filter_id", "left").select(
        "filter_id", F.when(whole, F.left("hash", F.lit(16))).otherwise(INVALID_FILTER).alias("digest"), "n_leaves")


def filter_summaries(requests: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``query_id, summary``: six content-free lines about the filters of every request.

    ``requests``: ``query_id, knowledge_base_ids, index_version_ids, user_filter_id, inferred_filter_id`` (null for no filter).
    """
    side = lambda name: fingerprints.select(
        F.col("filter_id").alias(f"{name}_filter_id"), F.col("digest").alias(f"{name}_digest"), F.col("n_leaves").alias(f"{name}_leaves"))
    known = requests.join(side("user"), "user_filter_id", "left").join(side("inferred"), "inferred_filter_id", "left")
    line = lambda label, value: F.concat(F.lit(f"{label}:"), value.cast("string"))
    return known.select("query_id", F.array(
        F.lit("hard:tenant"), line("hard:knowledge_bases", F.size("knowledge_base_ids")), line("hard:index_versions", F.size("index_version_ids")),
        line("user_filters", F.coalesce("user_leaves", F.lit(0))), line("user_ast", F.coalesce("user_digest", F.lit("none"))),
        line("inferred_ast", F.coalesce("inferred_digest", F.lit("none"))),
    ).alias("summary"))
