"""Several sets of fixed effects against dummies, passes and folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import effects, spread, stats
from panelspark.sources.staging import shared_folder


def dummies(y, x, sets, w, cluster=None):
    """Estimates and errors of a regression on x and all dummies, in numpy."""
    n, k = x.shape
    d = np.column_stack([x] + [(s[:, None] == np.unique(s)[None, (0 if i == 0 else 1) :]).astype(float) for i, s in enumerate(sets)])
    inv = np.linalg.pinv(d.T @ (d * w[:, None]))
    beta = inv @ (d.T @ (w * y))
    e = w * (y - d @ beta)
    free = n - k - (sum(len(np.unique(s)) for s in sets) - (len(sets) - 1))
    if cluster is None:
        meat, fix = (d * (e**2)[:, None]).T @ d, n / free
    else:
        scores = np.array([(d * e[:, None])[cluster == c].sum(axis=0) for c in np.unique(cluster)])
        meat, fix = scores.T @ scores, len(scores) / (len(scores) - 1) * (n - 1) / free
    se = np.sqrt(np.diag(inv @ meat @ inv) * fix)
    ybar = (w * y).sum() / w.sum()
    return beta[:k], se[:k], 1 - (e * (y - d @ beta)).sum() / (w * (y - ybar) ** 2).sum(), y - d @ beta


def panel(seed, units=30, times=9, repeats=2):
    rng = np.random.default_rng(seed)
    cells = [(u, t) for u in range(units) for t in range(times) for _ in range(1 + rng.integers(repeats)) if rng.random() < 0.4 + 0.5 * (t > u % times)]
    u, t = np.array(cells).T
    x = np.column_stack([rng.normal(size=len(u)) + u * 0.3 + t**1.5, (rng.random(len(u)) < 0.4).astype(float)])
    y = x @ [1.5, -2.0] + u * 2.0 - t * t + rng.normal(size=len(u)) + 1000
    return u, t, x, y, rng.random(len(u)) + 0.1


def folders(spark):
    root = shared_folder(spark).removeprefix("file://")
    return {d for d, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files)} if os.path.isdir(root) else set()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_unbalanced_panel_equals_dummies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast)
    u, t, x, y, w = panel(1)
    df = spark.createDataFrame([(f"u{a}", int(b), float(p), float(q), float(c), float(d)) for a, b, (p, q), c, d in zip(u, t, x, y, w)], "u string, t int, a double, b double, y double, w double")
    before = folders(spark)
    got = stats.least_squares(df, "y", ["a", "b"], weight="w", absorb=["u", "t"], cluster="u")
    assert folders(spark) == before
    beta, se, r2, _ = dummies(y, x, [u, t], w, u)
    assert np.allclose([z[1] for z in got["terms"]], beta, rtol=1e-8) and np.allclose([z[2] for z in got["terms"]], se, rtol=1e-8) and abs(got["r2"] - r2) < 1e-10 and got["n"] == len(y)


def test_three_sets_robust_errors_residuals_and_scale(spark):
    u, t, x, y, w = panel(2, units=12, times=7)
    g = (u * 7 + t * 3) % 5
    df = spark.createDataFrame([(i, int(a), int(b), float(c), float(p), float(q), float(v)) for i, (a, b, c, (p, q), v) in enumerate(zip(u, t, g, x, y))], "id int, u int, t int, g double, a double, b double, y double")
    got = stats.least_squares(df, "y", ["a", "b"], absorb=["u", "t", "g"], standardise=True, keep=["id"])
    x = x.copy()
    x[:, 0] /= x[:, 0].std(ddof=1)
    beta, se, _, e = dummies(y, x, [u, t, g], np.ones(len(y)))
    assert np.allclose([z[1] for z in got["terms"]], beta, rtol=1e-7) and np.allclose([z[2] for z in got["terms"]], se, rtol=1e-7)
    left = dict(got["residuals"].select("id", "residual").collect())
    assert np.allclose([left[i] for i in range(len(y))], e, atol=1e-6)


def test_separate_parts_nulls_hot_levels_and_too_few(spark):
    rng = np.random.default_rng(5)
    u = np.concatenate([np.zeros(300, int), rng.integers(1, 20, 200), rng.integers(30, 40, 100)])
    t = np.concatenate([rng.integers(0, 6, 500), rng.integers(10, 14, 100)])
    x = rng.normal(size=(600, 1)) + t[:, None]
    y = 3 * x[:, 0] + u - t + 0.1 * rng.normal(size=600)
    data = [(int(a), int(b), float(c), float(d)) for a, b, (c,), d in zip(u, t, x, y)]
    df = spark.createDataFrame([*data, (None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 1, None, 1.0), (1, 1, 1.0, None)], "u int, t int, x double, y double")
    got = stats.least_squares(df, "y", ["x"], absorb=["u", "t"], cluster="u")
    assert abs(got["terms"][0][1] - dummies(y, x, [u, t], np.ones(600))[0][0]) < 1e-8 and got["n"] == 600
    assert stats.least_squares(df.limit(0), "y", ["x"], absorb=["u", "t"]) is None
    assert stats.least_squares(df.limit(4), "y", ["x"], absorb=["u", "t"], standardise=True) is None
    assert stats.two_way(df.filter("u < 5"), "y", "x", "u", "t") is None


def test_rows_are_read_twice(spark):
    u, t, x, y, w = panel(3, units=15, times=6)
    rows = spark.createDataFrame([(int(a), int(b), float(p), float(c)) for a, b, (p, _), c in zip(u, t, x, y)], "u int, t int, x double, y double").coalesce(1)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    effects.fit(rows.mapInArrow(counted, rows.schema), "y", ["x"], ["u", "t"], cluster="u")
    assert reads.value == 2 * len(y)


def test_steps_that_run_out_are_an_error(spark):
    u, t, x, y, _ = panel(4)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(u, t, y)], "g0 int, g1 int, y double")
    cells = df.groupBy("g0", "g1").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("w_y"))
    with pytest.raises(RuntimeError, match="not solved"):
        effects.Absorber(cells, ["y"], ["g0", "g1"], effects.Scratch(spark, "few"), rounds=2)
