"""Bootstrap, spatial statistics, PageRank and choices by years against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import linkage, panels, resampling, spatial, spread, stats


def test_bootstrap_of_several_columns_equals_a_loop_with_the_same_counts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400) + 1e6
    y, w = 0.5 * x + rng.normal(size=400), rng.random(400)
    data = [(i, "k", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame([*data, (1000, "k", None, 1.0, 1.0), (1001, "k", 1.0, 1.0, None)], "i long, k string, x double, y double, w double").repartition(5)
    wanted = {"mean": resampling.mean("y"), "correlation": resampling.correlation("x", "y"), "slope": resampling.slope("y", "x")}
    got = {r.statistic: r for r in resampling.bootstrap(df, ["i", "k"], ["x", "y"], wanted, weight="w", draws=300).collect()}
    h = dict(df.select("i", F.xxhash64(F.lit(0), "i", "k")).collect())
    counts = resampling.times(np.array([h[i] for i in range(400)]).view(np.uint64), 300)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.03

    def values(w):
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        xx, yy, xy = ((w * (a - ma) * (b - mb)).sum() for a, ma, b, mb in ((x, mx, x, mx), (y, my, y, my), (x, mx, y, my)))
        return my, xy / np.sqrt(xx * yy), xy / xx

    draws = np.array([values(w * counts[:, d]) for d in range(300)])
    for k, name in enumerate(("mean", "correlation", "slope")):
        low, high = np.percentile(draws[:, k], [2.5, 97.5])
        assert np.allclose([got[name].value, got[name].low, got[name].high], [values(w)[k], low, high], rtol=1e-7)
    flat = resampling.bootstrap(df.withColumn("x", F.lit(2.0)), ["i"], ["x", "y"], {"c": resampling.correlation("x", "y")}, draws=20).first()
    assert flat.value is None and flat.low is None
    assert resampling.bootstrap(df.limit(0), ["i"], ["y"], {"m": resampling.mean("y")}, draws=5).count() == 0


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        seen = [spatial.shuffled(np.arange(n), np.full(n, d), n, 0) for d in range(1, 6)]
        assert all(sorted(p.tolist()) == list(range(n)) for p in seen)
    assert not np.array_equal(seen[0], seen[1])
    where = np.array([spatial.shuffled(np.array([3]), np.array([d]), 16, 0)[0] for d in range(1, 3201)])
    assert np.all(np.abs(np.bincount(where, minlength=16) - 200) < 70)


def grid(spark, value):
    cells = [(i, j) for i in range(8) for j in range(8)]
    near = [(i * 8 + j, a * 8 + b) for i, j in cells for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < 8 and 0 <= b < 8]
    return spark.createDataFrame([(i * 8 + j, float(value(i, j))) for i, j in cells], "u int, x double"), spark.createDataFrame(near, "u int, neighbour int")


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_moran_of_a_chequerboard_and_a_slope(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast)
    r = spatial.permutations(*grid(spark, lambda i, j: (i + j) % 2), "u", "x", draws=99).first()
    assert abs(r.i + 1) < 1e-12 and r.p > 0.95
    r = spatial.permutations(*grid(spark, lambda i, j: i + j), "u", "x", draws=99).first()
    assert r.i > 0.8 and r.p == 0.01
    values, edges = grid(spark, lambda i, j: (i * 5 + j * 3) % 7)
    v = np.array([x for _, x in sorted(values.collect())])
    z = (v - v.mean()) / v.std(ddof=1)
    near = [[] for _ in range(64)]
    for a, b in edges.collect():
        near[a].append(b)
    total = lambda z: sum(z[a] * np.mean(z[near[a]]) for a in range(64)) / (z @ z)
    draws = [total(z[spatial.shuffled(np.arange(64), np.full(64, d), 64, 0)]) for d in range(1, 100)]
    r = spatial.permutations(values, edges, "u", "x", draws=99).first()
    assert abs(r.i - total(z)) < 1e-12 and r.p == (sum(d >= total(z) - 1e-12 for d in draws) + 1) / 100


def test_local_moran(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 3.0), (3, 0.0), (4, 1.0), (5, 2.0), (6, None)], "u int, x double")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (4, 6), (5, 1)], "u int, neighbour int")
    got = {r.u: r for r in spatial.moran(df, edges, "u", "x").collect()}
    z = (np.arange(5) - 2) / np.arange(5).std(ddof=1)
    assert {u: r.quadrant for u, r in got.items()} == {1: "high-high", 2: "high-high", 3: "low-low", 4: "low-low", 5: "none"}
    assert np.allclose([got[1].local, got[3].lag, got[5].z], [z[4] * z[3], z[1], 0.0]) and abs(got[1].i - 2 * (z[4] * z[3] + z[0] * z[1]) / (z @ z)) < 1e-12


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_pagerank_to_the_tolerance(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(stats, "sized_join", spread.sized_join)
    rng = np.random.default_rng(4)
    edges = [(0, j, 1.0) for j in range(1, 60)] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(1, 40, 150), rng.integers(0, 60, 150), rng.integers(1, 5, 150))]
    m = np.zeros((60, 60))
    for a, b, w in edges:
        m[b, a] += w
    ends = m.sum(axis=0) == 0
    m[:, ~ends] /= m[:, ~ends].sum(axis=0)
    v, turns = np.full(60, 1 / 60), 0
    while True:
        new = 0.15 / 60 + 0.85 * (m @ v + v[ends].sum() / 60)
        turns, change, v = turns + 1, np.abs(new - v).sum(), new
        if change < 60 * 1e-9:
            break
    df = spark.createDataFrame(edges, "a int, b int, w double")
    got = dict(stats.pagerank(df, "a", "b", "w", tolerance=1e-9).collect())
    assert turns > 5 and np.allclose([got[i] for i in range(60)], v, atol=1e-12) and abs(sum(got.values()) - 1) < 1e-9
    with pytest.raises(RuntimeError, match="still change"):
        stats.pagerank(df, "a", "b", "w", rounds=1)
    assert stats.pagerank(df.limit(0), "a", "b", "w").count() == 0


def test_holder_of_a_name_by_years(spark):
    cases = [
        (1, [("100001", 1980, 2014), ("100002", 2015, 2021)], (1995, 2023), "100002"), (2, [("a", 1990, 2010), ("b", 2011, 2020)], (2000, 2005), "a"),
        (3, [("unknown", None, 2001), ("known", 2005, 2008)], (2000, 2010), "known"), (4, [("far", 1960, 1970), ("near", 2015, 2020)], (1990, 2000), "near"),
        (5, [("far", 2015, 2020), ("near", 1980, 1999)], (2000, 2010), "near"), (6, [("never", 1980, 1990), ("unknown", None, None)], (2000, 2010), "unknown"),
        (7, [("b", 1990, 2000), ("a", 1990, 2000)], (None, 2010), "a"), (8, [("short", 2004, 2006), ("long", 2001, 2006)], (2000, 2010), "long"), (9, [("touch", 1990, 2000), ("gap", 1990, 1999)], (2000, 2010), "touch")]
    df = spark.createDataFrame([(k, c, *years, a, b) for k, held, years, _ in cases for c, a, b in held], "u int, c string, y0 int, y1 int, f0 int, f1 int")
    got = {r.u: r.c for r in linkage.by_years(df, "u", "c", "y0", "y1", "f0", "f1").collect()}
    assert got == {k: right for k, _, _, right in cases}


def test_merged_panels_and_their_coverage(spark):
    a = spark.createDataFrame([("x", 2000, 1), ("x", 2001, 2), ("y", 2001, 0), ("z", 2005, 3)], "k string, yr int, filed int")
    b = spark.createDataFrame([("x", 2001, 5.0), ("y", 2001, None), ("w", 2002, 1.0)], "k string, yr int, filed double")
    c = spark.createDataFrame([], "k string, yr int, s double")
    out = panels.merge_panels(a, {"v": b, "d": c}, ["k", "yr"])
    assert out.columns == ["k", "yr", "filed", "v_filed", "d_s"] and out.count() == 5
    got = panels.coverage(out, F.col("filed") > 0, "yr", {"work": "v_filed", "lead": "d_s"}).collect()
    assert [tuple(r) for r in got] == [("work", 2001, 2002, 1, 1, 1.0)]


def test_holders_of_names_without_the_pairs_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    year = lambda: None if rng.random() < 0.1 else int(rng.integers(1990, 2010))
    name = lambda: [None, "", "a", "b", "c", "d"][rng.integers(6)]
    units = [(i, name(), year(), year()) for i in range(300)]
    units += units[:20] + [(i, n, year(), year()) for i, n, *_ in units[20:40]] + [(None, "a", 2000, 2001), (None, "a", None, 2001), (900, "alone", 2000, 2001)]
    codes = [(None if rng.random() < 0.05 else str(rng.integers(60)), name(), year(), year()) for _ in range(200)] + [("x", "held by none", 1990, 2000)]
    left, right = spark.createDataFrame(units, "u int, n string, y0 int, y1 int"), spark.createDataFrame(codes, "c string, n string, f0 int, f1 int")
    want = linkage.by_years(left.join(right.filter("c IS NOT NULL"), "n"), "u", "c", "y0", "y1", "f0", "f1").collect()
    got = linkage.name_by_years(left, right, "n", "u", "c", "y0", "y1", "f0", "f1")
    assert got.columns == ["u", "c", "candidates"] and len(want) > 200 and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert linkage.name_by_years(left, right.limit(0), "n", "u", "c", "y0", "y1", "f0", "f1").count() == 0
    two = spark.createDataFrame([(1, "a", 2000, 2001), (1, "b", 2000, 2001)], left.schema)
    with pytest.raises(Exception, match="several names"):
        linkage.name_by_years(two, right, "n", "u", "c", "y0", "y1", "f0", "f1").collect()


def _rows_joined(node) -> int:
    """Rows that the joins below a node of an executed plan made."""
    kind = node.getClass().getSimpleName()
    inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return (node.metrics().get("numOutputRows").get().value() if "Join" in kind else 0) + sum(map(_rows_joined, below))


def test_a_name_of_many_units_and_codes_makes_no_pairs(spark, tmp_path):
    """A million pairs of one name were shuffled."""
    import duckdb

    from panelspark.plans import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT 400 * i + 7 AS c_custkey FROM range(1000) t(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 80 * i + 7 AS s_suppkey FROM range(1000) t(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for table in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = QUERIES["name_link_by_years"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(ORACLES["name_link_by_years"]).fetchall()) and len(got) == 1000 and {r[2] for r in got} == {1000}
    assert _rows_joined(df._jdf.queryExecution().executedPlan()) < 20_000
