"""Exact and approximate vector search for tables of queries.

Exact search multiplies blocks of queries with blocks of vectors and emits only the best ``k``
per query and block; the pairs in between are never rows. A block is bounded whatever the skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import let
from lorebase.functions.vectors import dot, norm
from lorebase.operators.search import top_k

BROADCAST_QUERIES = 2_000
BROADCAST_BYTES = 64 * 1024 * 1024
QUERY_BLOCK = 1_000
VECTOR_BLOCK = 20_000
QUERY_SLICE = 64

# a facet is a pair of string-array columns; a pair of rows passes when the arrays intersect or the
# query side is null (no restriction)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def _round6(values: np.ndarray) -> np.ndarray:
    """Half-up at six digits, after removing the noise of the summation order."""
    return np.floor(np.round(values, 9) * 1e6 + 0.5) / 1e6


def _membership(column, vocabulary: pa.Array) -> np.ndarray:
    """Rows x vocabulary 0/1 matrix of a string-array column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    slots = pc.index_in(array.flatten(), vocabulary)
    rows = np.repeat(np.arange(len(array)), counts)
    known = slots.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(array), len(vocabulary)), dtype=np.float32)
    out[rows[known], slots.drop_null().to_numpy(zero_copy_only=False)] = 1.0
    return out


def _passes(queries: pa.Table, vectors: pa.Table, facets: list[str]) -> np.ndarray | None:
    mask = None
    for facet in facets:
        wanted = queries.column(f"q_{facet}").combine_chunks()
        vocabulary = pc.unique(wanted.flatten())
        free = wanted.is_null().to_numpy(zero_copy_only=False)
        ok = (_membership(wanted, vocabulary) @ _membership(vectors.column(f"v_{facet}"), vocabulary).T) > 0
        ok |= free[:, None]
        mask = ok if mask is None else mask & ok
    return mask


def _select(score: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Per query the positions of its best ``k`` (of those that reach ``least``); ties at the cut go to the smaller id."""
    for i, line in enumerate(score):
        picked = np.flatnonzero(line >= (0.0 if least is None else max(0.0, least[i])))
        if len(picked) > k:
            held = line[picked]
            picked = picked[held >= np.partition(held, len(held) - k)[len(held) - k]]
        if len(picked) > k:
            picked = np.asarray(sorted(picked, key=lambda j: (-line[j], ids[j]))[:k])
        yield i, picked


NOTHING = pa.table({"query_id": pa.array([], pa.string()), "vector_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})


def hits(names: pa.Array, ids: np.ndarray, score: np.ndarray, k: int, least: np.ndarray | None = None) -> pa.Table:
    """``query_id, vector_id, score`` of the best ``k`` per line of a score matrix; scores below zero are none."""
    rows, columns = [], []
    for i, picked in _select(score, ids, k, least):
        rows.extend([i] * len(picked))
        columns.extend(picked.tolist())
    return pa.table({
        "query_id": names.take(pa.array(rows, pa.int64())),
        "vector_id": pa.array([ids[j] for j in columns], pa.string()),
        "score": pa.array(score[rows, columns] if rows else [], pa.float64()),
    })


class Kept:
    """The best ``k`` hits per query of what a task has seen, in memory that the number of batches does not change.

    ``least`` has the k-th score of every query that has as many hits; what does not reach it need not be added.
    """

    def __init__(self, names: pa.Array, k: int) -> None:
        self.names, self.k = names, k
        self.least = np.full(len(names), -1.0)
        self.found, self.waiting = NOTHING, []

    def add(self, found: pa.Table) -> None:
        self.waiting.append(found)
        if sum(t.num_rows for t in self.waiting) > self.k * len(self.names):
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables([self.found, *self.waiting])
        self.waiting = []
        rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("score", "descending"), ("vector_id", "ascending")]))
        asked = pc.index_in(rows.column("query_id"), self.names).to_numpy()
        starts = np.flatnonzero(np.diff(asked, prepend=-1))
        place = np.arange(len(asked)) - np.repeat(starts, np.diff(starts, append=len(asked)))
        last = place == self.k - 1
        self.least[asked[last]] = rows.column("score").to_numpy()[last]
        self.found = rows.filter(pa.array(place < self.k)).combine_chunks()
        return self.found


def _best(queries: pa.Table, vectors: pa.Table, k: int, facets: list[str], additive: bool = False, least: np.ndarray | None = None) -> pa.Table:
    """Top ``k`` vectors per query of one block pair, a slice of queries at a time."""
    ids = np.asarray(vectors.column("vector_id").to_pylist(), dtype=object)
    unit_vectors = _unit(_matrix(vectors.column("v_vector")))
    found: list[pa.Table] = []
    for start in range(0, queries.num_rows if len(ids) else 0, QUERY_SLICE):
        part = queries.slice(start, QUERY_SLICE)
        cosine = _unit(_matrix(part.column("q_vector"))) @ unit_vectors.T
        if additive:
            wanted = part.column("q_words").combine_chunks()
            vocabulary = pc.unique(wanted.flatten())
            shared = _membership(wanted, vocabulary) @ _membership(vectors.column("v_words"), vocabulary).T
            score = _round6(shared.astype(np.float64) + cosine)
            score = np.where(score > 0, score, -1.0)
        else:
            score = (1.0 + cosine) / 2.0
        floor = np.full(len(score), -1.0) if least is None else least[start : start + QUERY_SLICE]
        mask = _passes(part, vectors, facets)
        if not additive:  # what cannot reach the k-th score is not rounded
            near = score + 1e-6 >= floor[:, None]
            near = near if mask is None else near & mask
            rounded = np.full(score.shape, -1.0)
            rounded[near] = _round6(score[near])
            score = rounded
        elif mask is not None:
            score = np.where(mask, score, -1.0)
        found.append(hits(part.column("query_id").combine_chunks(), ids, score, k, floor))
    if not found:
        return NOTHING
    return pa.concat_tables(found)


def _sides(queries: DataFrame, vectors: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    q = queries.select(
        F.col("query_id").cast("string"), F.col("embedding").alias("q_vector"),
        *[F.col(c).alias(f"q_{c}") for c in columns],
    )
    v = vectors.select(
        F.col("vector_id").cast("string"), F.col("embedding").alias("v_vector"),
        *[F.col(c).alias(f"v_{c}") for c in columns],
    )
    return q, v


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    facets: tuple[str, ...] = (),
    additive: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Exact top ``k`` by cosine, reported as (1 + cos) / 2.

    ``queries``: query_id, embedding, facet arrays; ``vectors``: vector_id, embedding, facet
    arrays. Filters act before the cut (pre-filter, not post-filter). With ``additive`` the score
    is the number of shared ``words`` plus the cosine, and non-positive scores are dropped.

    When the queries are at most ``broadcast_queries`` rows and 64 MB (checked), the vectors are scanned
    where they lie and never shuffled, and a task hands on its best ``k`` per query. Otherwise both sides are cut into bounded blocks.
    """
    names = list(facets)
    q, v = _sides(queries, vectors, [*names, "words"] if additive else names)
    head = q.limit(broadcast_queries + 1).toArrow()
    if head.num_rows <= broadcast_queries and head.nbytes <= BROADCAST_BYTES:
        shared = v.sparkSession.sparkContext.broadcast(head)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Kept(shared.value.column("query_id").combine_chunks(), k)
            for batch in batches:
                kept.add(_best(shared.value, pa.Table.from_batches([batch]), k, names, additive, kept.least))
            yield from kept.cut().to_batches()

        found = v.mapInArrow(scan, "query_id string, vector_id string, score double")
    else:
        found = _blocked(q, v, k, names, additive)
    return top_k(found, k, tie="vector_id")


def _blocked(q: DataFrame, v: DataFrame, k: int, facets: list[str], additive: bool) -> DataFrame:
    n_queries, n_vectors = q.count(), v.count()
    q_blocks, v_blocks = -(-n_queries // QUERY_BLOCK) or 1, -(-n_vectors // VECTOR_BLOCK) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.withColumn("qb", block("query_id", q_blocks)).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )
    right = v.withColumn("vb", block("vector_id", v_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(
        lambda a, b: _best(a, b, k, facets, additive), "query_id string, vector_id string, score double"
    )


CODE_LEVELS = 127


def codes(vector: Column) -> Column:
    """Eight-bit codes of a vector: its entries scaled so that the largest becomes 127."""
    def scaled(held: Column) -> Column:
        largest = F.array_max(F.transform(held, lambda x: F.abs(x.cast("double"))))
        return F.transform(held, lambda x: F.round(x.cast("double") * CODE_LEVELS / F.when(largest == 0, 1.0).otherwise(largest)).cast("tinyint"))

    return let(vector, scaled)


def candidate_budget(k: int, most: int = 10_000) -> int:
    """Candidates to rescore for ``k`` results: four times as many, up to ``most``, never fewer than ``k``."""
    return max(k, min(4 * k, most))


def vector_topk_coded(queries: DataFrame, vectors: DataFrame, k: int, *, facets: tuple[str, ...] = ()) -> DataFrame:
    """Approximate top ``k`` without an index: candidates by eight-bit codes made in the query, rescored exactly.

    Every vector is read and scored by its code, so recall does not depend on how the vectors cluster; only the candidate
    budget per query is scored in full precision. With a stored index, ``ivf.search`` reads far less.
    """
    shorten = lambda df: df.withColumn("embedding", codes(F.col("embedding")))
    found = vector_topk(shorten(queries), shorten(vectors), candidate_budget(k), facets=facets).select("query_id", "vector_id")
    q = queries.select(F.col("query_id").cast("string"), F.col("embedding").alias("q_vector"))
    v = vectors.select(F.col("vector_id").cast("string"), F.col("embedding").alias("v_vector"))
    cosine = dot(F.col("q_vector"), F.col("v_vector")) / (norm(F.col("q_vector")) * norm(F.col("v_vector")))
    scored = found.join(q, "query_id").join(v, "vector_id").select("query_id", "vector_id", F.round(F.round((1 + cosine) / 2, 9), 6).alias("score"))
    return top_k(scored, k, tie="vector_id")
