"""Security and metadata predicates compiled to columns, so Catalyst can push them down."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the nine filterable fields and the permission reasons
FILTER_FIELDS = (
    "document_id",
    "document_version_id",
    "media_type",
    "language",
    "created_at",
    "heading_path",
    "contains_table",
    "contains_image",
    "chunk_strategy_id",
)
ARRAY_FIELDS = ("heading_path",)
OPERATORS = ("equals", "in", "gte", "lte")


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Group:
    op: str  # and | or | not
    children: tuple = field(default_factory=tuple)


def compile_leaf(leaf: Leaf, fields: Iterable[str] = FILTER_FIELDS) -> Column:
    if leaf.field not in tuple(fields):
        raise ValueError(f"field is not filterable: {leaf.field}")
    if leaf.op not in OPERATORS:
        raise ValueError(f"unknown filter operator: {leaf.op}")
    col = F.col(leaf.field)
    if leaf.field in ARRAY_FIELDS:
        # equality on an array field means "contains"
        if leaf.op == "equals":
            return F.array_contains(col, leaf.value)
        if leaf.op == "in":
            return F.arrays_overlap(col, F.array(*[F.lit(v) for v in leaf.value]))
        raise ValueError("range filters need a scalar field")
    if leaf.op == "equals":
        return col == leaf.value
    if leaf.op == "in":
        return col.isin(*leaf.value)
    return col >= leaf.value if leaf.op == "gte" else col <= leaf.value


def compile_filter(node: Leaf | Group, fields: Iterable[str] = FILTER_FIELDS) -> Column:
    """Compile a filter tree. A missing field never matches, so NOT keeps rows with nulls."""
    if isinstance(node, Leaf):
        return compile_leaf(node, fields)
    parts = [compile_filter(child, fields) for child in node.children]
    if node.op == "not":
        if len(parts) != 1:
            raise ValueError("not takes exactly one child")
        return ~F.coalesce(parts[0], F.lit(False))
    if not parts or node.op not in ("and", "or"):
        raise ValueError("boolean groups need children and a known operator")
    result = parts[0]
    for part in parts[1:]:
        result = (result & part) if node.op == "and" else (result | part)
    return result


def describe_filter(node: Leaf | Group | None) -> Column:
    """The filter as a nested struct column, for :func:`lorebase.functions.ids.filter_digest`."""
    if node is None:
        return F.lit(None).cast("struct<field:string>")
    if isinstance(node, Leaf):
        return F.struct(
            F.lit(node.field).alias("field"),
            F.lit(node.op).alias("op"),
            F.to_json(F.array(F.lit(str(node.value)))).alias("value"),
        )
    return F.struct(
        F.lit(node.op).alias("op"),
        *[describe_filter(child).alias(f"c{i}") for i, child in enumerate(node.children)],
    )


def searchable(prefix: str = "") -> Column:
    """Active, enabled or unknown, not deleted or unknown."""
    col = lambda name: F.col(prefix + name)
    return (
        F.coalesce(col("active"), F.lit(False))
        & F.coalesce(col("document_enabled"), F.lit(True))
        & ~F.coalesce(col("document_deleted"), F.lit(False))
    )


def access_allowed(record: str, actor: Column, roles: Column) -> Column:
    """Owner, tenant-visible, listed actor, or an allowed role; unknown means no."""
    col = lambda name: F.col(f"{record}.{name}")
    return F.coalesce(
        (col("owner_id") == actor)
        | (col("visibility") == "tenant")
        | F.coalesce(F.array_contains(col("allowed_actor_ids"), actor), F.lit(False))
        | F.coalesce(F.arrays_overlap(col("allowed_roles"), roles), F.lit(False)),
        F.lit(False),
    )


def access_tokens() -> Column:
    """What a record grants, as tokens; a query may see it when it holds one of them."""
    return F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("visibility") == "tenant", F.lit("everyone")),
                F.concat(F.lit("actor:"), F.col("owner_id")),
            ),
            F.transform(
                F.coalesce(F.col("allowed_actor_ids"), F.expr("cast(array() as array<string>)")),
                lambda a: F.concat(F.lit("actor:"), a),
            ),
            F.transform(
                F.coalesce(F.col("allowed_roles"), F.expr("cast(array() as array<string>)")),
                lambda r: F.concat(F.lit("role:"), r),
            ),
        )
    )


def held_tokens() -> Column:
    return F.concat(
        F.array(F.lit("everyone"), F.concat(F.lit("actor:"), F.col("actor_id"))),
        F.transform(F.col("roles"), lambda r: F.concat(F.lit("role:"), r)),
    )


def permission_reason(tenant, actor, res_tenant, owner, visibility, action) -> Column:
    """First matching permission rule; ``*_allowed`` reasons grant access."""
    return (
        F.when(tenant != res_tenant, "tenant_mismatch")
        .when(actor == owner, "owner_allowed")
        .when((visibility == "tenant") & (action == "read"), "tenant_read_allowed")
        .when(visibility == "private", "private_owner_required")
        .otherwise("owner_write_required")
    )
