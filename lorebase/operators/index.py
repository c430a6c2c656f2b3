"""Embedding, index records, postings, and index maintenance as set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import let, words
from lorebase.functions.vectors import hash_embedding
from lorebase.sources.staging import broadcast_within, materialized

RECORD_COLUMNS = (
    "index_version_id", "tenant_id", "knowledge_base_id", "owner_id", "visibility", "document_id",
    "document_version_id", "chunk_id", "content", "active", "document_deleted",
)


def embed(df: DataFrame, text: str = "content", *, dims: int = 64) -> DataFrame:
    """Default deterministic embedding, computed in the JVM."""
    return df.withColumn("embedding", hash_embedding(F.col(text), dims))


def embed_with(
    df: DataFrame, key: str, text: str, batch: Callable[[list[str]], list], *, dims: int
) -> DataFrame:
    """Embed with a user's batch function on Arrow batches; every input must get ``dims`` numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [[float(x) for x in v] for v in batch(frame[text].tolist())]
            if len(vectors) != len(frame) or any(len(v) != dims for v in vectors):
                raise ValueError("embedding batch is partial or has wrong dimensions")
            yield pd.DataFrame({key: frame[key], "embedding": vectors})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def embedding_coverage(inputs: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """Violations: inputs without vector, vectors without input, wrong dimensions."""
    have, want = vectors.select(key), inputs.select(key)
    return (
        want.join(have, key, "left_anti").select(key, F.lit("missing_vector").alias("violation"))
        .unionByName(have.join(want, key, "left_anti").select(key, F.lit("unknown_input").alias("violation")))
        .unionByName(
            vectors.filter(F.size("embedding") != dims).select(key, F.lit("wrong_dimensions").alias("violation"))
        )
    )


def assemble_records(
    chunks: DataFrame, vectors: DataFrame, documents: DataFrame, versions: DataFrame, index_version: str
) -> DataFrame:
    """Chunk, vector, document and version joined into index records, written inactive."""
    return (
        chunks.join(vectors, "chunk_id")
        .join(documents, ["tenant_id", "document_id"])
        .join(versions, ["tenant_id", "document_id", "document_version_id"])
        .withColumn("index_version_id", F.lit(index_version))
        .withColumn("active", F.lit(False))
    )


def postings(chunks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Term frequencies per chunk with the chunk length.

    Counting happens inside the row (distinct terms of a chunk), so building postings multiplies
    rows but does not shuffle. Scope and access columns are carried to filter before scoring.
    """
    keep = ["chunk_id", "document_id", *carried]

    def count(terms: Column) -> Column:
        return F.transform(
            F.array_distinct(terms),
            lambda t: F.struct(
                t.alias("term"), (F.size(terms) - F.size(F.array_remove(terms, t))).alias("tf"), F.size(terms).alias("length")),
        )

    # counted before the explode, so the token array is not copied into every posting
    return chunks.select(*keep, F.explode(let(words(F.col("content")), count)).alias("p")).select("p.term", *keep, "p.tf", "p.length")


def document_frequencies(posting: DataFrame) -> DataFrame:
    """A chunk posts a term once, so the frequency is a plain count (partial aggregation)."""
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and average length in tokens."""
    return chunks.select(F.size(words(F.col("content"))).alias("length")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("avg_length")
    )


def generation_health(records: DataFrame, expected: DataFrame, mapping_version: int) -> DataFrame:
    """Count, scope and required columns of every generation over all of its rows.

    ``expected`` has (index_version_id, tenant_id, knowledge_base_id, expected_count).
    """
    required = all(c in records.columns for c in RECORD_COLUMNS)
    keys = ["index_version_id", "tenant_id", "knowledge_base_id"]
    found = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(F.col("chunk_id").isNull() | F.col("document_version_id").isNull()).alias("broken"),
    )
    n_columns = len(records.columns)
    count = F.coalesce("chunk_count", F.lit(0))
    return expected.join(found, keys, "left").select(
        *keys, "expected_count", count.alias("chunk_count"),
        F.concat_ws(":", F.lit(str(mapping_version)), count.cast("string"), F.lit(str(n_columns))).alias("checksum"),
        ((count > 0) & (count == F.col("expected_count")) & (F.coalesce("broken", F.lit(0)) == 0) & F.lit(required)).alias("healthy"),
    )


def current_generation(pointers: DataFrame) -> DataFrame:
    """Latest switched generation per knowledge base, from the append-only pointer log.

    The log holds only switches that succeeded; ``sinks.publish`` lets one writer per generation succeed.
    """
    return pointers.groupBy("tenant_id", "knowledge_base_id").agg(
        F.max_by("index_version_id", F.struct("generation", "index_version_id")).alias("index_version_id"),
        F.max("generation").alias("generation"),
    )


def activate(records: DataFrame, chosen: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Within each chosen scope make exactly one version active.

    ``chosen`` holds ``scope`` columns plus ``activate_version``. Returns (records, errors); a scope
    whose version has no records is an error row and its records stay as they were.
    """
    present = records.select(*scope, F.col("document_version_id").alias("activate_version")).distinct()
    valid = chosen.join(present, [*scope, "activate_version"], "left_semi")
    errors = chosen.join(present, [*scope, "activate_version"], "left_anti").withColumn(
        "error_code", F.lit("index_activation_empty")
    )
    switched = records.join(valid, scope, "left").withColumn(
        "active",
        F.when(F.col("activate_version").isNotNull(), F.col("document_version_id") == F.col("activate_version"))
        .otherwise(F.col("active")),
    )
    return switched.drop("activate_version"), errors


def fenced_promote(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Apply the strongest update per key when the stored token is null or not newer.

    ``state``: key, version, token; ``updates``: key, new_version, new_token. Ties between updates
    go to the larger version id so replays and reordered input give the same table.
    """
    best = updates.groupBy(key).agg(F.max(F.struct("new_token", "new_version")).alias("u"))
    apply = F.col("u").isNotNull() & (F.col("token").isNull() | (F.col("token") <= F.col("u.new_token")))
    return state.join(best, key, "left").select(
        key,
        F.when(apply, F.col("u.new_version")).otherwise(F.col("version")).alias("version"),
        F.when(apply, F.col("u.new_token")).otherwise(F.col("token")).alias("token"),
        F.coalesce(apply, F.lit(False)).alias("applied"),
    )


def retire(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Make the records of the given versions inactive."""
    marked = versions.select("document_version_id").distinct().withColumn("_retired", F.lit(True))
    return records.join(marked, "document_version_id", "left").withColumn(
        "active", F.col("active") & F.col("_retired").isNull()
    ).drop("_retired")


def delete_keys(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Delete whole versions or single chunks: the rows that are left."""
    return records.join(keys, on, "left_anti")


def projection_counts(records: DataFrame) -> DataFrame:
    return (
        records.filter(~F.coalesce("document_deleted", F.lit(False)))
        .groupBy("document_version_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    )


def projection_versions(records: DataFrame) -> DataFrame:
    return records.select("knowledge_base_id", "document_id", "document_version_id").distinct()


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins per key, as an aggregation with map-side combine (no sorted groups)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both sides with the latest row per key; incoming wins a tie."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest(both, keys, [F.col(order), F.col("_side")]).drop("_side")


def upsert_within(existing: DataFrame, incoming: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """``upsert`` where a key lies in one group, as a chunk in a document version.

    Only groups with incoming rows are merged, and their rows end side by side; the rows of the others stay where they are.
    """
    touched = broadcast_within(materialized(incoming.select(group).distinct(), "touched-groups"))
    both = existing.join(touched, group, "left_semi").withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    merged = latest(both.repartition(group), [group, *keys], [F.col(order), F.col("_side")]).drop("_side")
    return existing.join(touched, group, "left_anti").unionByName(merged)


def scope_error(tenant: Column | str, dims: int) -> Column:
    """Why an index write must reject a row: foreign tenant (against a name or a column) or wrong vector size; null if it need not."""
    return F.when(F.coalesce(F.col("tenant_id") != tenant, F.lit(True)), "index_scope_mismatch").when(
        F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "index_dimension_mismatch"
    )


def scope_violations(incoming: DataFrame, tenant: Column | str, dims: int) -> DataFrame:
    """Rows an index write must reject, with ``error_code``."""
    return incoming.withColumn("error_code", scope_error(tenant, dims)).filter(F.col("error_code").isNotNull())


def newest_segments(segments: DataFrame, order: str = "batch_id") -> DataFrame:
    """Of every document version the rows of the latest segment that holds it, so no chunk of an earlier delivery survives.

    Only versions that several segments hold are joined, so rows of the others stay where they are.
    """
    newest = segments.groupBy("document_version_id").agg(F.min(order).alias("oldest"), F.max(order).alias("newest"))
    repeated = materialized(newest.filter("oldest < newest").drop("oldest"), "repeated-versions")
    marked = segments.join(broadcast_within(repeated), "document_version_id", "left")
    latest_of = F.coalesce("newest", order)
    return marked.filter(F.col("document_version_id").isNotNull() & (F.col(order) == latest_of)).select(*segments.columns)
