"""Whitening against a dense eigendecomposition and against exact arithmetic."""

import math

import numpy as np
import pytest

from lorebase.llm import whitening


def vectors(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    scale = spread if spread is not None else np.linspace(1, 0.2, d)
    mixed = rng.standard_normal((n, d)) * scale @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [[float(np.float32(v)) for v in row] for row in mixed]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, component string, n int").repartition(3)


def check(rows, got, components=8):
    """``rows`` are those that the operator keeps."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, d = x.shape
    centred = x - x.mean(axis=0)
    values, units = np.linalg.eigh(centred.T @ centred / n)
    values, units = values[::-1], units[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    exact = {}
    for (i, _), row in zip(rows, x.tolist(), strict=True):
        exact.setdefault(i, []).append(sum((n * v - s) ** 2 for v, s in zip(row, x.sum(axis=0).tolist())))
    assert all(r.deviation in exact[r.vec_id] and r.deviation == r.deviation_exact for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(k):
        mine = np.array([w for _, w in sorted((r.vec_id, r.whitened) for r in got if r.component == c + 1)])
        white = centred @ units[:, c] / math.sqrt(values[c])
        ways = [np.array([w for _, w in sorted((i, sign * w) for (i, _), w in zip(rows, white))]) for sign in (1, -1)]
        assert min(np.abs(mine - way).max() for way in ways) < 1e-8
        assert [*{r.explained for r in got if r.component == c + 1}] == pytest.approx([values[c] / values.sum()], rel=1e-10)


@pytest.mark.parametrize("d", [1, 3, 8, 24])
def test_equals_dense_decomposition(spark, d):
    rows = list(enumerate(vectors(90, d)))
    check(rows, whitening.whiten(frame(spark, rows)).collect())


def test_leading_components_need_few_steps(spark):
    rows = list(enumerate(vectors(200, 40, spread=np.r_[np.linspace(9, 2, 8), np.full(32, 0.01)])))
    check(rows, whitening.whiten(frame(spark, rows)).collect())
    assert whitening.fit(whitening.grid(frame(spark, rows))).steps < 30


def test_unusable_rows_go_and_others_stay(spark):
    good = vectors(40, 4, 3)
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (5, good[1]), (5, good[1])]
    bad = [(100, None), (101, [1.0, None, 0.0, 2.0]), (102, [1.0, float("nan"), 0.0, 2.0]), (103, [1.0, float("inf"), 0.0, 2.0]), (104, [1.0]), (105, [])]
    got = whitening.whiten(frame(spark, rows + bad)).collect()
    assert sum(r.vec_id is None for r in got) == 4
    whole = [(-1 if i is None else i, v) for i, v in rows]
    check(whole, [type(r)(**{**r.asDict(), "vec_id": -1}) if r.vec_id is None else r for r in got])


def test_fewer_components_than_dimensions(spark):
    """Vectors of a plane have two components; equal variances do not end the search."""
    flat = [[a, b, a + b, 0.0] for a, b in ((float(i % 7), float(i % 5)) for i in range(35))]
    got = whitening.whiten(frame(spark, list(enumerate(flat)))).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9
    corners = [[float(8 * (k == j) * s) for k in range(5)] for j in range(5) for s in (1, -1)]
    got = whitening.whiten(frame(spark, list(enumerate(corners)))).collect()
    assert {r.component for r in got} == set(range(1, 6)) and got[0].identity_error < 1e-9 and {round(r.explained, 9) for r in got} == {0.2}


def test_large_deviations_stay_exact(spark):
    rows = [(0, [2.0e6, -2.0e6]), (1, [-2.0e6, 1.5e6])] + [(2 + i, [float(i), 1.0]) for i in range(300)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for (i, _), row in zip(rows, x):
        exact = sum((len(x) * v - s) ** 2 for v, s in zip(row, sums))
        assert int(got[i, 1].deviation_exact) == exact and got[i, 1].deviation == (exact if exact < 1 << 63 else None)
    assert any(r.deviation is None for r in got.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_no_rows(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []
