"""Ranks and quantiles against plain computations, with ties, one hot group and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranks, spread, stats


def average_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_rank_correlation_of_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(1)
    data = [("hot", float(a), float(a + b)) for a, b in zip(rng.integers(0, 9, 600), rng.integers(0, 9, 600))] + [("hot", 3.0, 3.0)] * 300
    data += [(None, float(a), float(-a)) for a in range(10)] + [("ties", 1.0, float(i)) for i in range(50)] + [("one", 1.0, 1.0), ("part", None, 1.0), ("part", 1.0, 2.0), ("part", 2.0, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(6)
    got = {r.g: (r.rho, r.n) for r in ranks.rank_corr(df, "g", "x", "y").collect()}
    x, y = (np.array([r[i] for r in data if r[0] == "hot"]) for i in (1, 2))
    want = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
    assert abs(got["hot"][0] - want) < 1e-12 and got["hot"][1] == 900
    assert got[None] == (-1.0, 10) and got["ties"] == (None, 50) and got["one"] == (None, 1) and got["part"] == (-1.0, 2)
    assert ranks.rank_corr(df.limit(0), "g", "x", "y").count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_quantiles_of_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(2)
    groups = {"hot": np.concatenate([np.full(500, 2.5), rng.normal(size=700)]), "few": np.array([3.0, -1.0]), "one": np.array([7.0]), None: rng.integers(-3, 3, 101).astype(float)}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    wanted = [0.0, 0.2, 0.5, 0.77, 1.0]
    got = {r.g: (r.q, r.n) for r in ranks.quantiles(df, ["g"], "x", wanted).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g][0], np.quantile(values, wanted), atol=1e-12) and got[g][1] == len(values)
    whole = ranks.quantiles(df, [], "x", [0.5]).first()
    assert abs(whole.q[0] - np.median(np.concatenate(list(groups.values())))) < 1e-12
    classes = ranks.quantile_class(df.filter("g = 'hot' and x is not null"), "g", "x", 4, "c").collect()
    edges = sorted(set(np.quantile(groups["hot"], [0.25, 0.5, 0.75])))
    assert all(r.c == 1 + sum(e < r.x for e in edges) for r in classes) and len(classes) == 1200


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 5)) @ np.diag([5.0, 2.0, 1.0, 0.5, 0.1]) + 10
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "i int, v array<double>")
    scores, loadings = stats.principal_components(df, "i", "v", 2)
    centred = v - v.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    pc = vt[:2].T * np.sign(vt[:2].T[np.abs(vt[:2].T).argmax(axis=0), [0, 1]])
    rows = loadings.orderBy("place").collect()
    assert np.allclose([r.loadings for r in rows], pc) and np.allclose(rows[0].explained, (s**2 / (s**2).sum())[:2])
    assert np.allclose([r.scores for r in scores.orderBy("i").collect()], centred @ pc)
