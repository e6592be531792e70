"""Nearest neighbours by the metric index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import nearest


def brute(v, wanted, k):
    out = {}
    for q in wanted:
        d = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q)[:k]
        out[q] = [(i, x) for x, i in d]
    return out


def answers(df, key="id"):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r[key], r.distance))
    return got


@pytest.mark.parametrize("pivots,block", [(None, 4096), (1, 16), (25, 7), (200, 4096)])
def test_equal_to_all_distances(spark, pivots, block):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(6, 5)) * 4
    v = {i: (middle[i % 6] + rng.normal(size=5)).round(1) for i in range(300)}
    points = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in v.items()] + [(1000, None), (None, [0.0] * 5)], "id long, v array<double>").repartition(5)
    got = answers(nearest.neighbours(points, points.filter("id % 4 = 0"), "id", "v", 3, pivots=pivots, block=block))
    want = brute(v, range(0, 300, 4), 3)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.allclose([d for _, d in got[q]], [d for _, d in want[q]]) for q in want)


def test_copies_few_points_and_names(spark):
    points = spark.createDataFrame([(f"p{i:03d}", [1.0, 0.0]) for i in range(40, 0, -1)] + [("q100", [0.0, 0.0]), ("q101", [0.5, 0.0])], "name string, v array<double>").coalesce(1)
    got = nearest.neighbours(points, points.filter(F.col("name") > "q"), "name", "v", 3, pivots=4, block=5)
    assert {q: [i for i, _ in x] for q, x in answers(got, "name").items()} == {"q100": ["q101", "p001", "p002"], "q101": ["p001", "p002", "p003"]}
    two = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<float>")
    assert answers(nearest.neighbours(two, two, "id", "v", 5)) == {1: [(2, 3.0)], 2: [(1, 3.0)]}
    assert nearest.neighbours(two.limit(0), two, "id", "v", 5).count() == 0 and nearest.neighbours(two, two.limit(0), "id", "v", 5).count() == 0


def test_far_cells_are_not_visited(spark, monkeypatch):
    seen = []
    own = nearest._visited

    def counted(spark, points, queries, visits, *rest):
        seen.append(visits.count())
        return own(spark, points, queries, visits, *rest)

    monkeypatch.setattr(nearest, "_visited", counted)
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(40, 8)) * 50
    v = {i: middle[i % 40] + rng.normal(size=8) for i in range(2000)}
    points = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in v.items()], "id long, v array<double>")
    got = answers(nearest.neighbours(points, points.filter("id % 20 = 0"), "id", "v", 5))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in brute(v, range(0, 2000, 20), 5).items()}
    assert sum(seen) < 100 * 44 / 4  # of 44 cells for each of 100 queries
