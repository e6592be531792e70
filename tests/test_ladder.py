"""Nested regressions from one table of moments against fits one by one."""

import numpy as np
import pytest

from panelspark.operators import ladder, stats
from tests.test_effects import folders

OPTIONS = [{"cluster": "u"}, {"weight": "w"}, {"weight": "w", "cluster": "u", "absorb": ["g"]}, {"absorb": ["g"]}]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        g, u = int(rng.integers(0, 5)), int(rng.integers(0, 25))
        a, b, c = rng.normal() * 3 + 50, float(rng.random() < 0.3), rng.normal() + g
        rows.append((f"p{i % 3}", g, u, float(rng.random() + 0.2), float(2 * a - 3 * b + c + g + u / 5 + rng.normal() + 1e4), float(a), b, float(c)))
    rows += [("few", 0, i, 1.0, float(i * i), float(i), 0.0, 1.0) for i in range(7)]
    rows += [("p0", 0, 1, 1.0, None, 1.0, 1.0, 1.0), ("p0", 0, 1, 1.0, 1.0, 1.0, None, 1.0), (None, 0, 1, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "p string, g int, u int, w double, y double, a double, b double, c double").repartition(4)


@pytest.mark.parametrize("options", OPTIONS)
def test_every_step_equals_its_own_fit(spark, table, options):
    before = folders(spark)
    got = ladder.ladder(table, "y", "a", [["b"], ["c"]], "p", **options)
    assert folders(spark) == before
    kept = table.dropna(subset=["p", "y", "a", "b", "c"])
    want = {}
    for p in ("few", "p0", "p1", "p2"):
        for k in range(3):
            fit = stats.least_squares(kept.filter(kept.p == p), "y", ["a", "b", "c"][: k + 1], standardise=True, **options)
            if fit and p != "few":
                want[p, k] = [*next(t for t in fit["terms"] if t[0] == "a")[1:4], fit["r2"], fit["n"]]
    assert {r[:2] for r in got} >= set(want) and [r[:2] for r in got] == sorted(r[:2] for r in got)
    for r in got:
        if r[:2] in want:
            assert np.allclose(r[2:], want[r[:2]], rtol=1e-7), (r, want[r[:2]])
    assert [r[1] for r in got if r[0] == "few"] == [0, 1]  # seven rows are enough for two regressors


def test_several_sets_and_an_empty_table(spark, table):
    got = ladder.ladder(table.filter("p = 'p1'"), "y", "a", [["c"]], "p", absorb=["g", "u"], cluster="u")
    fit = stats.least_squares(table.filter("p = 'p1'"), "y", ["a", "c"], standardise=True, absorb=["g", "u"], cluster="u")
    assert [r[:2] for r in got] == [("p1", 0), ("p1", 1)] and abs(got[1][2] - fit["terms"][0][1]) < 1e-7
    assert ladder.ladder(table.limit(0), "y", "a", [["b"]], "p") == []
