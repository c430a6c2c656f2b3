"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

One pass over the rows makes a step: with the right vector v it forms Xv (a column as long as the table, which stays in
the tasks), orthogonalises it against all earlier left vectors and multiplies it by X transposed. Left vectors are kept as
combinations of the columns of X, so a task computes its own part of them; sums of as many numbers as a vector has entries are all
that reaches the driver. There right vectors are orthogonalised against all earlier ones, and the small bidiagonal
matrix is decomposed. Steps go on until the wanted components are settled or the dimensions are used up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import stage

GRID, SHIFT, FURTHEST = 1024, 100_000, float(1 << 31)
COMPONENTS = 8
SETTLED = 1e-13  # error of a component's direction, as residual by distance to the next value
LEAST = 1e-9  # of the largest deviation: directions below have none


@dataclass(frozen=True)
class Model:
    """Rows n, sums per dimension, unit components as columns, their variances by falling size, and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    steps: int


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _sums(rows: DataFrame, compute: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all rows of ``compute(block of rows)``, an array of fixed ``size``; added up per task before the shuffle."""
    number = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = compute(_matrix(batch.column(0)))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, number)], ["slot", "value"])

    summed = rows.select("x").mapInArrow(run, f"slot int, value {kind}").groupBy("slot").agg(F.sum("value").alias("value"))
    out = np.zeros(size, dtype=np.int64 if kind == "long" else float)
    for slot, value in summed.collect():
        out[slot] = value
    return out


def grid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """All rows with a usable vector, which becomes ``x``, whole numbers on the grid.

    Null vectors and those with null or non-finite entries go, as do vectors of another length than most (ties: the longest), which
    lack entries or have some too many. Entries beyond two million count as two million.
    """
    entry = f"transform({vector}, e -> cast(e AS double))"
    finite = F.expr(f"{vector} IS NOT NULL AND forall({entry}, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    placed = F.expr(f"transform({entry}, e -> floor(greatest(least(e * {GRID}, {FURTHEST}D), -{FURTHEST}D)) + {SHIFT}L)")
    rows = stage(vectors.filter(finite).select("vec_id", placed.alias("x")), "grid")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == common["d"]) if common else rows


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 1) -> Model | None:
    """The leading components of the rows' covariance; None without rows or variance."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None or first["d"] < 1:
        return None
    d = first["d"]
    counted = _sums(rows, lambda x: np.append(x.sum(axis=0), len(x)), d + 1, "long")
    n, sums = int(counted[d]), counted[:d]

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    total = float(_sums(rows, lambda x: (centred(x) ** 2).sum(axis=0), d, "double").sum() / n)
    if total <= 0:
        return None
    left: list[np.ndarray] = []  # z, with the left vector u = Xz
    returns: list[np.ndarray] = []  # X'u
    right: list[np.ndarray] = []
    small = np.zeros((d, d + 1))  # u'Xv
    scale, beta = np.sqrt(total * n), 0.0
    draw = np.random.default_rng(seed)

    def against_all(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for w in right:
                v = v - (w @ v) * w
        return v

    def fresh() -> np.ndarray:
        v = against_all(draw.standard_normal(d))
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        right.append(v)
        column = v - beta * left[-1] if beta else v
        earlier = np.array(left).reshape(-1, d).T

        def step(x: np.ndarray, column=column, earlier=earlier) -> np.ndarray:
            c = centred(x)
            u = c @ column
            return np.concatenate([(c @ earlier).T @ u, [u @ u], u @ c])

        k = len(left)
        sums_of_step = _sums(rows, step, k + 1 + d, "double")
        inner, square, back = sums_of_step[:k], sums_of_step[k], sums_of_step[k + 1 :]
        alpha = float(np.sqrt(max(square - inner @ inner, 0.0)))
        beta, ended = 0.0, len(right) == d
        if alpha > 1e-13 * scale:
            left.append((column - earlier @ inner) / alpha)
            returns.append((back - (np.array(returns[:k]).T @ inner if k else 0.0)) / alpha)
            small[k, len(right) - 1] = alpha
            rest = against_all(returns[-1] - alpha * v)
            beta = float(np.linalg.norm(rest))
            if not ended and beta > 1e-13 * scale:
                small[k, len(right)] = beta
                v = rest / beta
            else:
                beta = 0.0
        if left and (ended or beta):
            p, s, q = np.linalg.svd(small[: len(left), : len(right)])
            if ended or _settled(p, s, beta, components):
                break
        if not beta:
            v = fresh()  # the space of these vectors is closed: go on outside it
    keep = min(components, int((s > LEAST * s[0]).sum()))
    directions = np.array(right).T @ q[:keep].T
    return Model(n, sums, directions / np.linalg.norm(directions, axis=0), s[:keep] ** 2 / n, total, len(right))


def _settled(p: np.ndarray, s: np.ndarray, beta: float, components: int) -> bool:
    """Whether the residual of every wanted value is small against its distance to the others."""
    if len(s) <= components:
        return False
    gaps = np.abs(np.diff(s))
    near = np.minimum(np.append(np.inf, gaps[: components - 1]), gaps[:components])
    return bool((beta * np.abs(p[-1, :components]) <= SETTLED * np.minimum(near, s[:components])).all())


def _white(model: Model, x: np.ndarray) -> np.ndarray:
    return ((model.n * x - model.sums) / model.n) @ (model.components / np.sqrt(model.variances))


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from a second and third pass over all rows."""
    k = len(model.variances)
    mean = _sums(rows, lambda x: _white(model, x).sum(axis=0), k, "double") / model.n

    def moments(x: np.ndarray) -> np.ndarray:
        y = _white(model, x) - mean
        return (y.T @ y).ravel()

    covariance = _sums(rows, moments, k * k, "double").reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


WHITE = "vec_id long, deviation long, deviation_exact decimal(38,0), whitened array<double>"


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """``vec_id, deviation, deviation_exact, whitened``: one row per row, with one number per component.

    The deviation is a sum of squares of whole numbers; where it exceeds a long it is null, and exact in the decimal column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            away = model.n * x - model.sums if len(x) else x
            if len(x) and float(np.abs(away).max()) ** 2 * x.shape[1] < 2.0**62:
                exact = (away * away).sum(axis=1).tolist()
            else:
                exact = [int(v) for v in (away.astype(object) ** 2).sum(axis=1)] if len(x) else []
            white = _white(model, x) if len(x) else np.zeros((0, 1))
            offsets = np.arange(len(x) + 1) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()), pa.array(exact, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(white.ravel())),
                ],
                ["vec_id", "deviation", "deviation_exact", "whitened"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, WHITE)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``.

    Components have falling variance; where fewer than ``components`` have any, only those are returned, and none for an empty
    table, equal vectors or vectors without entries. Equal variances (ties) leave a component's direction open. Null vec_ids and
    repeated rows are rows as others. Other columns, whatever their names, are ignored.
    """
    rows = grid(vectors, vector)
    model = fit(rows, components)
    names = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    if model is None:
        return vectors.sparkSession.createDataFrame([], names)
    error = identity_error(rows, model)
    shares = F.array(*(F.lit(float(v / model.total)) for v in model.variances))
    spread = transform(rows, model).select("*", F.posexplode("whitened").alias("k", "white"))
    return spread.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(error).alias("identity_error"), "deviation_exact",
    )
