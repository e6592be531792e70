"""Worked cases with values by hand."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import codes, names
from panelspark.operators import joins, linkage, novelty, panels, stats, tasks
from panelspark.plans import QUERIES
from panelspark.sources import readers
from panelspark.streaming.incremental import ingest_new


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("raw, want", [
    ("US10000000B2", "10000000"), ("RE0012", "12"), ("none", "")])
def test_doc_number(spark, raw, want):
    assert one(spark, codes.doc_number(F.lit(raw))) == want


def test_codes(spark):
    assert one(spark, codes.patent_number(F.lit("0123.0"))) == "123" and one(spark, codes.patent_number(F.lit("re-12"))) == "RE12" and one(spark, codes.patent_number(F.lit("--"))) is None
    assert one(spark, codes.firm_key(F.lit("6066"))) == "006066" and one(spark, codes.firm_key(F.lit("0"))) is None
    assert one(spark, codes.county_code(F.lit("6"), F.lit("85"))) == "06085" and one(spark, codes.county_code(F.lit("48"), F.lit("48453"))) == "48453"
    assert str(one(spark, codes.mixed_date(F.lit("20180203")))) == "2018-02-03" and one(spark, codes.mixed_date(F.lit("E"))) is None
    assert str(one(spark, codes.period_date(F.lit("2024-03")))) == "2024-01-29"
    assert one(spark, codes.clean_number(F.lit("12,345"))) == 12345.0 and one(spark, codes.clean_number(F.lit("#"))) is None
    assert one(spark, codes.member_codes(F.lit("325100"), F.lit("Chemicals (3251, 3252 only)"))) == ["3251", "3252"]
    assert one(spark, codes.significant(F.lit(123456.0), 4)) == 123500.0 and one(spark, codes.unsuppressed(F.lit(-1))) is None


@pytest.mark.parametrize("raw, want", [
    ("The Acme Corporation, Inc.", "acme"), ("I.B.M. Co", "ibm"), ("H&K Holdings (Old)", "h and k"), ("ALPHABET INC -CL A", "alphabet"), ("Foo Technologies /DE/", "foo tech"), ("The The Group", ""), (None, None)])
def test_company_names(spark, raw, want):
    assert one(spark, names.company(F.lit(raw).cast("string"))) == want


def test_token_ratios():
    assert names.token_sort("data lab", "lab data") == 100.0 and names.indel_ratio("", "") == 100.0
    assert names.indel_ratio("abcd", "abce") == 75.0
    assert names.token_set("software developers", "software developers applications") == 100.0
    assert names.token_set("a b", "c d") < 50


@pytest.mark.parametrize("raw, want", [
    ("American Pharmaceuticals National Corp", "amer pharma natl"), ("U S Steel Holdings Group, Inc", "us steel"), ("International Business Machines /new/ - Class B", "intl business machines"), ("Foo /de/ Bar - Class B LLC", "foo bar")])
def test_company_names_by_the_fixed_tables(spark, raw, want):
    assert one(spark, names.company(F.lit(raw))) == want


def test_titles_and_figures(spark):
    assert one(spark, names.title(F.lit("Managers, All Other (note)"))) == "managers" and one(spark, names.title(F.lit("Cooks & Chefs, except (b) short order"))) == "cooks and chefs"
    assert [one(spark, codes.clean_number(F.lit(x))) for x in ("-1", "$ -1,200.5", "4%", "2012-13", "#", "-")] == [-1.0, -1200.5, 4.0, 201213.0, None, None]


def test_common_subsequences_of_any_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(3)
    texts = lambda: ["".join(rng.choice(list("abcé "), rng.choice([0, 1, 5, 62, 63, 64, 127, 200]))) for _ in range(120)]
    a, b = texts(), texts()
    assert names._common(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]


def test_occupation_codes_find_the_pattern_that_covers_them(spark):
    patterns = spark.createDataFrame([(p,) for p in ("112030", "1120XX", "151252", "4750YY", "13102X", "291210", "291240", "x", None, "47")], "pattern string")
    socs = ("11-2032", "15-1252", "47-5041", "13-1023", "15-1132", "29-1216", "29-1229", "29-1242", "11-2090", "99", None)
    got = {r.soc: r.pattern for r in joins.covering_code(spark.createDataFrame([(s,) for s in socs], "soc string"), patterns, "soc", "pattern").collect()}
    assert got == dict(zip(socs, ("112030", "151252", "4750YY", "13102X", None, "291210", "291210", "291240", "1120XX", None, None)))


def test_profiles_take_fine_codes_and_else_the_longest_coarser_one(spark):
    table = spark.createDataFrame([("32541", 10, 1, 2.0), ("3254", 30, 2, 4.0), ("325M", 5, 1, 9.0), ("33MS", 8, 1, None), ("33", 2, 1, 7.0), ("3MS", 1, 1, 1.0), ("3254Z", 10, 1, None)], "code string, workers long, n long, v double")
    got = rows(joins.profiles(spark.createDataFrame([("3254",), ("3259",), ("3391",), ("9999",), (None,)], "k string"), table, "k", "code", "workers", "n", ["v"]))
    assert got == [("3254", "3254;32541;3254Z", 50.0, 4, 3.5, False), ("3259", "325M", 5.0, 1, 9.0, True), ("3391", "33;33MS", 10.0, 2, 7.0, True)]


def test_standardised_regression(spark):
    rng = np.random.default_rng(7)
    n = 120
    x, d, w, g = rng.normal(5, 3, n), rng.integers(0, 2, n), rng.uniform(1, 2, n), rng.integers(0, 4, n)
    y = 2 * x + 3 * d + g + rng.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), float(e), int(f)) for i, (a, b, c, e, f) in enumerate(zip(y, x, d, w, g))] + [(999, None, 1.0, 1, 1.0, 1)], "i int, y double, x double, d int, w double, g int")
    fit = stats.least_squares(df, "y", ["x", "d"], weight="w", absorb=["g"], cluster="g", standardise=True, keep=["i"])
    X = np.column_stack([(x - x.mean()) / x.std(ddof=1), d, *[(g == k) for k in range(4)]]).astype(float)
    xtx = np.linalg.inv(X.T @ (X * w[:, None]))
    beta = xtx @ (X.T @ (w * y))
    e = y - X @ beta
    meat = sum(np.outer(s, s) for s in ((X[g == k] * (w * e)[g == k][:, None]).sum(axis=0) for k in range(4)))
    se = np.sqrt(np.diag(xtx @ meat @ xtx) * 4 / 3 * (n - 1) / (n - 6))
    assert np.allclose([t[1] for t in fit["terms"]], beta[:2]) and np.allclose([t[2] for t in fit["terms"]], se[:2])
    mean = (w * y).sum() / w.sum()
    assert abs(fit["r2"] - (1 - (w * e**2).sum() / (w * (y - mean) ** 2).sum())) < 1e-9 and fit["n"] == n
    assert np.allclose([r.residual for r in fit["residuals"].orderBy("i").collect()], e)
    t = fit["terms"][0][3]
    assert abs(fit["terms"][0][4] - math.erfc(abs(t) / 2**0.5)) < 1e-12
    assert stats.least_squares(df.limit(6), "y", ["x", "d"], standardise=True) is None


def test_two_way_effects_against_dummies_and_least_numbers(spark):
    rng = np.random.default_rng(5)
    panel = [(u, t) for u in range(18) for t in range(6) if rng.random() < 0.8]
    x = np.array([rng.normal() + u * 0.3 + t for u, t in panel])
    y = 1e6 * (1.5 * x + np.array([u - 2 * t for u, t in panel]) + rng.normal(size=len(panel)))
    df = spark.createDataFrame([(float(a), float(b), u, t) for a, b, (u, t) in zip(y, x, panel)], "y double, x double, u int, t int")
    us, ts = (np.array([p[i] for p in panel]) for i in (0, 1))
    X = np.column_stack([(x - x.mean()) / x.std(ddof=1), *[(us == k) for k in range(18)], *[(ts == k) for k in range(1, 6)]]).astype(float)
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e = y - X @ beta
    meat = sum(np.outer(s, s) for s in ((X[us == k] * e[us == k][:, None]).sum(axis=0) for k in range(18)))
    n, k = X.shape
    se = np.sqrt(np.diag(inv @ meat @ inv) * 18 / 17 * (n - 1) / (n - k))[0]
    got = stats.two_way(df, "y", "x", "u", "t")
    assert np.allclose([got["estimate"], got["se"], got["t"]], [beta[0], se, beta[0] / se]) and got["n"] == n
    assert stats.two_way(df.filter("u < 14"), "y", "x", "u", "t") is None and stats.two_way(df.filter("t < 3"), "y", "x", "u", "t") is None


def test_nearest_places_on_the_globe(spark):
    rng = np.random.default_rng(9)
    places = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(150)] + [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 0.0, 179.9), (203, 0.0, -179.9), (204, 0.0, -179.9)]
    got = {}
    for r in stats.nearest_weights(spark.createDataFrame([*places, (300, None, 1.0)], "k int, lat double, lon double"), "k", "lat", "lon", 4).collect():
        got.setdefault(r.k, []).append((r.km, r.neighbour))
        assert r.weight == 0.25
    p = np.radians(np.array([x[1:] for x in places]))
    a = np.sin((p[:, None, 0] - p[None, :, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(p[None, :, 0]) * np.sin((p[:, None, 1] - p[None, :, 1]) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    for i, (key, _, _) in enumerate(places):
        want = sorted((round(km[i, j], 6), places[j][0]) for j in range(len(places)) if j != i)[:4]
        assert sorted((round(d, 6), k) for d, k in got[key]) == want
    few = stats.nearest_weights(spark.createDataFrame(places[:3], "k int, lat double, lon double"), "k", "lat", "lon", 8).collect()
    assert len(few) == 6 and all(r.weight == 0.5 for r in few)


def test_quoted_cells_may_hold_line_breaks_and_malformed_rows_go(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\n2\n3,4,5\n6,"7"\n')
    got = readers.delimited(spark, str(tmp_path / "q.csv"), ",")
    assert rows(got) == [("6", "7"), ("x\ny", "1")] and got.count() == 2 and rows(got.select("b")) == [("1",), ("7",)] and readers.dealt(got).count() == 2
    for name in ("countyinflow2122.csv", "stateoutflow1112.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    assert rows(readers.flow_file(readers.delimited(spark, str(tmp_path / "*flow*.csv"), ",")).select("year", "direction")) == [(2012, "out"), (2022, "in")]


def test_ranks_sums_and_minima_over_pieces_of_a_group(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if i % 4 else (None if i % 8 else "cold"), int(rng.integers(0, 50)), i, float(rng.integers(0, 100)) / 100) for i in range(400)]
    df = spark.createDataFrame(data, "g string, x int, id int, p double").repartition(7)
    groups = {g: sorted((x, i, p) for k, x, i, p in data if k == g) for g in ("hot", "cold", None)}
    place = {i: (n, len(v)) for v in groups.values() for n, (_, i, _) in enumerate(v)}
    assert {r.id: (r.r, r["__n"]) for r in panels.placed(df, "g", ["x", "id"], "r").collect()} == place

    def fifth(n, size):
        base, more = divmod(size, 5)
        return n // (base + 1) + 1 if n < more * (base + 1) else more + (n - more * (base + 1)) // base + 1

    assert {r.id: r.f for r in panels.ntile(df, "g", ["x", "id"], 5, "f").collect()} == {i: fifth(*place[i]) for i in place}
    assert panels.ntile(df.filter("id < 3"), "g", ["x", "id"], 5, "f").select(F.max("f")).first()[0] <= 2
    want, order = {}, sorted((p, i) for _, _, i, p in data)
    low = 1.0
    for n in range(len(order), 0, -1):
        low = min(low, order[n - 1][0] * len(order) / n)
        want[order[n - 1][1]] = round(low, 9)
    assert {r.id: round(r.q, 9) for r in panels.q_values(df, "p", "id").collect()} == want
    share = {r.id: round(r.s, 9) for r in panels.percentile(df, "g", ["x", "id"], "s").collect()}
    assert share == {i: round(n / (size - 1), 9) for i, (n, size) in place.items()}


def test_joins_by_counted_size_and_in_pieces_agree(spark, monkeypatch):
    from panelspark.operators import spread

    rows_ = spark.createDataFrame([("hot" if i % 3 else f"k{i % 9}", i) for i in range(600)], "k string, id int")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "k string, v int")
    want = rows(rows_.join(table, "k"))
    assert rows(spread.spread_join(rows_, table, ["k"], ["id"]).select("k", "id", "v")) == want
    for limit in (0, 100):
        monkeypatch.setattr(spread, "BROADCAST_ROWS", limit)
        assert rows(spread.sized_join(rows_, table, ["k"], ["id"]).select("k", "id", "v")) == want
        assert rows(spread.sized_join(rows_, table, ["k"], how="left_semi")) == rows(rows_.join(table, "k", "left_semi"))


def test_asof_with_one_key_in_most_rows(spark):
    rng = np.random.default_rng(1)
    left = [("hot" if i % 3 else f"k{i % 7}", int(rng.integers(0, 300))) for i in range(900)]
    right = [("hot" if i % 4 else f"k{i % 7}", int(t), float(i)) for i, t in enumerate(rng.integers(0, 300, 120))] + [("hot", None, 1.0)]
    got = rows(joins.asof(spark.createDataFrame(left, "k string, t int").repartition(6), spark.createDataFrame(right, "k string, t int, v double"), ["k"], "t", ["v"]))
    latest = lambda k, t: max(((rt, v) for rk, rt, v in right if rk == k and rt is not None and rt <= t), default=(None, None))[1]
    assert got == sorted(((k, t, latest(k, t)) for k, t in left), key=str)


def test_asof_takes_its_own_year_and_never_later(spark):
    left = spark.createDataFrame([("a", y) for y in (2012, 2013, 2014, 2015)] + [(None, 2015), ("b", 2011)], "k string, year int")
    right = spark.createDataFrame([("a", 2012, 1.0), ("a", 2013, 2.0), ("a", 2015, 4.0), ("a", 2015, 3.0), (None, 2000, 9.0), ("b", 2012, 5.0)], "k string, year int, v double")
    assert rows(joins.asof(left, right, ["k"], "year", ["v"])) == sorted([("a", 2012, 1.0), ("a", 2013, 2.0), ("a", 2014, 2.0), ("a", 2015, 4.0), (None, 2015, None), ("b", 2011, None)], key=str)


def test_wildcards_take_the_most_specific(spark):
    df = spark.createDataFrame([("472061",), ("151252",), ("119199",), ("999999",)], "soc string")
    rules = spark.createDataFrame([("4720XX",), ("47XXXX",), ("151252",), ("1191XX",), ("11919X",)], "p string")
    assert rows(joins.wildcard(df, rules, "soc", "p")) == [("119199", "11919X"), ("151252", "151252"), ("472061", "4720XX"), ("999999", None)]


def test_search_depth_and_scope(spark):
    cites = spark.createDataFrame([("6066", 2018, "x"), ("6066", 2020, "x"), ("6066", 2020, "y")], "f string, y int, c string")
    assert rows(novelty.search(cites, "f", "y", "c", 5)) == [("6066", 2018, 0.0, 1.0), ("6066", 2020, 0.5, 0.5)]


def test_exploration_is_null_before_the_window_is_full(spark):
    main = spark.createDataFrame([("f", 2010, "A", 1.0), ("f", 2013, "B", 0.5), ("f", 2014, "A", 1.0), ("f", 2016, "A", 1.0)], "f string, y int, c string, s double")
    every = spark.createDataFrame([("f", 2010, "A"), ("f", 2013, "B"), ("f", 2013, "A"), ("f", 2014, "A"), ("f", 2016, "A")], "f string, y int, c string")
    assert rows(novelty.exploration(main, every, "f", "y", "c", "s", 3)) == [("f", 2010, 1.0, None, None), ("f", 2013, 0.5, 0.5, 1), ("f", 2014, 1.0, 0.0, 0), ("f", 2016, 1.0, 0.0, 0)]


def test_mode_goes_by_source_count_and_value(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "b", 2), (1, "a", 2), (2, "z", 1), (2, "a", 2), (2, "a", 2), (3, "y", 1), (3, "x", 1)], "k int, v string, pri int")
    assert rows(panels.mode(df, ["k"], "v", F.col("pri"))) == [(1, "b", 2), (2, "z", 1), (3, "x", 1)]


def test_weighted_shares_and_means(spark):
    df = spark.createDataFrame([(100.0, 1, 150000.0), (50.0, 0, 200000.0), (50.0, None, None)], "w double, female int, wage double")
    share, mean = df.agg(panels.weighted_share(F.col("female") == 1, F.col("w")), panels.weighted_mean(F.log("wage"), F.col("w"))).first()
    assert share == 0.5 and abs(mean - (100 * np.log(150000) + 50 * np.log(200000)) / 150) < 1e-12


def test_links(spark):
    p = spark.createDataFrame([(1, "b", 2000, 2010, 1990, 1999), (1, "a", 2000, 2010, 2005, 2020), (2, "d", 2000, 2001, 2000, 2001), (2, "c", 2000, 2001, 2000, 2001)], "u int, c string, y0 int, y1 int, f0 int, f1 int")
    assert rows(linkage.by_years(p, "u", "c", "y0", "y1", "f0", "f1")) == [(1, "a", 2), (2, "c", 2)]
    wide = spark.createDataFrame([("H&K", 1991, 24, "100001", 2015, 2021, "100002"), ("G", 2015, 2021, "160329", None, None, None)], "n string, f1 int, n1 int, c1 string, f2 int, n2 int, c2 string")
    assert rows(linkage.spells(wide, ["n"], [("f1", "n1", "c1"), ("f2", "n2", "c2")])) == [("G", 2015, "160329", 2021), ("H&K", 1991, "100001", 2014), ("H&K", 2015, "100002", 2021)]
    left = spark.createDataFrame([("acme widget works",), ("zeta labs",)], "n string")
    right = spark.createDataFrame([("acme widgets works", "1"), ("acme other", "2"), ("beta labs", "3")], "n string, c string")
    assert [(r.name, r.code) for r in linkage.fuzzy(left, right, "n", "c", 90.0).collect()] == [("acme widget works", "1")]
    titles = linkage.title_cascade(spark.createDataFrame([("cook",), ("head cook chef",)], "t string"), spark.createDataFrame([("cook", "1"), ("welder", "2")], "t string, c string"), "t", "c")
    assert rows(titles) == [("cook", "1", "exact"), ("head cook chef", "1", "fuzzy")]


def test_place_cascade_has_all_levels(spark):
    left = spark.createDataFrame([
        ("own", ["west fargo"], ["ND"], "f"), ("wrong own", ["dallas"], ["TX"], "f"), ("first", ["dallas", "irving"], ["TX", "OK"], None), ("shared", ["irving"], ["TX"], None), ("second state", ["tulsa"], ["TX", "OK"], None),
        ("within", ["honolulu"], ["HI"], None), ("two", ["kaneohe", "hilo"], ["HI"], None), ("exact before within", ["kahului"], ["HI"], None), ("title city", ["plano", "irving"], ["TX"], None), ("none", ["ocean"], ["NJ"], None), ("no city", [""], ["HI"], None)], "k string, cities array<string>, states array<string>, own string")
    right = spark.createDataFrame([("f", ["fargo"], ["ND", "MN"]), ("d", ["dallas", "irving"], ["TX"]), ("c", ["irving", "dallas"], ["TX"]), ("t", ["tulsa"], ["OK"]), ("h", ["oahu"], ["HI"]), ("m", ["maui"], ["HI"])], "code string, cities array<string>, states array<string>")
    principal = spark.createDataFrame([("h", "urban honolulu", "HI"), ("h", "kaneohe", "HI"), ("m", "kaneohe", "HI"), ("m", "hilo", "HI"), ("m", "kahului", "HI"), ("h", "kahului town", "HI"), ("t", "tulsa", "OK"), ("gone", "ocean", "NJ")], "code string, city string, state string")
    got = {r.k: (r.code, r.score) for r in linkage.place_cascade(left, right, "k", "code", own="own", principal=principal).collect()}
    assert got == {"own": ("f", 4), "wrong own": ("d", 3), "first": ("d", 3), "shared": ("c", 3), "second state": ("t", 1), "within": ("h", 1), "two": ("m", 1), "exact before within": ("m", 1), "title city": ("c", 2), "none": (None, 0), "no city": (None, 0)}
    assert {r.k: r.score for r in linkage.place_cascade(left, right, "k", "code").collect()}["second state"] == 0


def test_fuzzy_names_by_brute_force(spark):
    rng = np.random.default_rng(6)
    heads, tails = ["acme", "borealis", "cobalt"], ["tools", "toolz", "tool works", "works tool", "systems", "sistems", "labs inc", "lab inc", "tooling"]
    pick = lambda k: sorted({f"{rng.choice(heads)} {rng.choice(tails)}{rng.choice(['', ' one', ' two', 'x'])}" for _ in range(k)})
    left, right = pick(60) + ["cob"], pick(60)
    docs = {n: int(rng.integers(1, 9)) for n in left}
    l = spark.createDataFrame([(n, docs[n]) for n in left], "name string, docs int")
    r = spark.createDataFrame([(n, f"c{i}") for i, n in enumerate(right)], "name string, code string")
    code = {n: f"c{i}" for i, n in enumerate(right)}
    ranked = lambda n: sorted(((-round(names.token_sort(n, m), 6), m) for m in right if m.split()[0] == n.split()[0] and names.token_sort(n, m) >= 88), key=lambda x: x)
    got = {}
    for x in linkage.fuzzy(l, r, "name", "code", 88.0, count="docs", least_count=5, top=3).collect():
        got.setdefault(x.name, []).append((x.rank, x.match, x.code))
    want = {n: [(i, m, code[m]) for i, (_, m) in enumerate(ranked(n)[:3], 1)] for n in left if docs[n] >= 5 and len(n) >= 4 and ranked(n)}
    assert {k: sorted(v) for k, v in got.items()} == want and max(map(len, want.values())) == 3
    best = {x.name: x.match for x in linkage.fuzzy(l, r, "name", "code", 88.0).collect()}
    assert best == {n: ranked(n)[0][1] for n in left if len(n) >= 4 and ranked(n)}


def test_codes_come_before_titles(spark):
    left = spark.createDataFrame([("15-1252", "Cooks"), (None, "cook"), ("99-9999", "software developers"), ("x", "nothing alike"), (None, None)], "soc string, title string")
    right = spark.createDataFrame([("15-1252", "software developer"), ("35-2014", "cook")], "soc string, title string")
    got = linkage.code_or_title(left, right, "soc", "title")
    assert rows(got) == sorted([("15-1252", "Cooks", "15-1252", "code"), (None, "cook", "35-2014", "exact"), ("99-9999", "software developers", "15-1252", "fuzzy"), ("x", "nothing alike", None, None), (None, None, None, None)], key=str)


def test_containment_is_of_whole_titles_either_way(spark):
    a = spark.createDataFrame([("Retail Trade",), ("Mining",), ("Information",), ("mining",), ("--",), (None,), ("Public administration, all",)], "a string")
    b = spark.createDataFrame([("44-45 retail-trade",), ("44-45 retail-trade",), ("Mines",), ("Information",), ("Public administration",), ("determining",), ("",), (None,)], "b string")
    assert rows(linkage.containment(a, b, "a", "b")) == sorted([("Retail Trade", "44-45 retail-trade"), ("Information", "Information"), ("Public administration, all", "Public administration"), ("Mining", "determining"), ("mining", "determining")], key=str)
    assert linkage.containment(a.limit(0), b, "a", "b").count() == 0


def test_titles_meet_without_a_shared_word(spark):
    frame = lambda texts: spark.createDataFrame([(x, str(i)) for i, x in enumerate(texts)], "t string, c string")
    got = linkage.title_cascade(frame(["statisticians", "engineers", "cooks", "physicists nuclear"]), frame(["statistician", "engineer", "cook", "nuclears physicist"]), "t", "c")
    assert rows(got) == [("engineers", "1", "fuzzy"), ("physicists nuclear", "3", "fuzzy"), ("statisticians", "0", "fuzzy")]
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(40)]
    edit = lambda x: "".join(rng.choice(["", c + "a", c], p=[0.04, 0.04, 0.92]) for c in x) or "a"
    left, right = sorted({edit(x) for x in base for _ in range(2)}), sorted({*base, *map(edit, base)})
    for cutoff in (92.0, 80.0):
        pairs = linkage._alike(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b", cutoff)
        want = {(x, y) for x in left for y in right if names.token_set(x, y) >= cutoff}
        assert len(want) > 60 and want <= {tuple(p) for p in pairs.collect()}


def test_least_squares_agrees_with_dummies(spark):
    rng = np.random.default_rng(1)
    n = 300
    g, h = rng.integers(0, 6, n), rng.integers(0, 5, n)
    x, w = rng.normal(size=n) + g, rng.uniform(0.5, 2, n)
    y = 2.5 * x + g * 1.5 - h + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d), int(e)) for a, b, c, d, e in zip(y, x, w, g, h)], "y double, x double, w double, g int, h int")
    dummies = np.column_stack([x, *[(g == k) for k in range(6)], *[(h == k) for k in range(1, 5)]]).astype(float)
    s = np.sqrt(w)
    want = np.linalg.lstsq(dummies * s[:, None], y * s, rcond=None)[0][0]
    fit = stats.least_squares(df, "y", ["x"], weight="w", absorb=["g", "h"])
    assert abs(fit["terms"][0][1] - want) < 1e-8
    plain = stats.least_squares(df, "y", ["x"])
    X = np.column_stack([np.ones(n), x])
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    e = y - X @ beta
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ (X.T * e**2) @ X @ inv) * n / (n - 2))
    assert np.allclose([t[1] for t in plain["terms"]], beta) and np.allclose([t[2] for t in plain["terms"]], se)


def test_kmeans_can_choose_five_and_the_whole_matrix_counts(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(i, i % 2, [float(v) for v in 20 * np.eye(64)[i % 5] + 0.01 * rng.normal(size=64)]) for i in range(200)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["kmeans_clusters"](spark, str(tmp_path))
    assert got.select("cluster").distinct().count() == 5
    spark.createDataFrame([(0, 0, [0.0] * 64), (1, 1, [0.0] * 63 + [1.0]), (2, 2, [0.0] * 64)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/last/embeddings.parquet")
    assert {r.label: r.score for r in QUERIES["matrix_weighted_whole"](spark, f"{tmp_path}/last").collect()} == {0: 0.0, 1: round(5 / 194, 6), 2: 0.0}


def test_incidence_adds_up_to_one(spark):
    docs = tasks.word_pairs(spark.createDataFrame([(1, "grind the metal parts"), (2, "paint walls")], "d long, text string"), ["d"], "text")
    units = tasks.word_pairs(spark.createDataFrame([(1, "grind metal"), (2, "metal parts"), (3, "paint walls daily")], "task long, text string"), ["task"], "text").withColumns({"soc": F.col("task") % 2, "w": F.lit(2.0)})
    got = tasks.incidence(docs, units, "d", "soc", "w", 2)
    assert {r.d: r.s for r in got.groupBy("d").agg(F.sum("share").alias("s")).collect()} == {1: 1.0, 2: 1.0}
    pluggable = tasks.extracted_pairs(spark.createDataFrame([(1, "a b"), (2, None)], "d long, text string"), "d", "text", lambda s: [tuple(s.split())] if s else [])
    assert rows(pluggable) == [(1, "a", "b")]


def test_sources(spark, tmp_path):
    tsv = tmp_path / "g.csv"
    tsv.write_text('id\tname\n"1"\t"say ""hi""\tthere"\n2\tb\n')
    assert readers.sniff_delimiter(spark, str(tsv)) == "\t" and rows(readers.delimited(spark, str(tsv))) == [("1", 'say "hi"\tthere'), ("2", "b")]
    with gzip.open(tmp_path / "z2122.csv.gz", "wt") as f:
        f.write("a,b\n1,2\n")
    z = readers.with_year(readers.delimited(spark, str(tmp_path / "z2122.csv.gz"), ","), r"(\d{4})", "pair").select("a", readers.second_of_pair(F.col("pair").cast("string")))
    assert rows(z) == [("1", 2022)]
    lines = spark.createDataFrame([("0007AB 012345",)], "value string")
    assert rows(readers.fixed_width(lines, {"n": (1, 4, 0), "s": (5, 3, None), "w": (8, 6, 2)})) == [(7.0, "AB", 123.45)]
    reply = spark.createDataFrame([(json.dumps([["NAME", "pop"], ["x", "1"], ["y", "2"]]),)], "value string")
    assert readers.array_reply(reply).columns == ["NAME", "pop"] and readers.array_reply(reply).count() == 2
    kinds = {"patents": [["patentid"], ["gvkey"]], "names": [["conm"]]}
    assert readers.classify(["PATENT_ID", "GVKEY"], kinds) == "patents" and readers.classify(["gvkey", "CONM"], kinds) == "names" and readers.classify(["x"], kinds) is None
    with pytest.raises(ValueError, match="year"):
        readers.select_roles(lines, {"year": (["year"], "int", True)})
    panel = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int")
    readers.save_panel(panel, str(tmp_path / "panel"))
    assert spark.read.parquet(f"{tmp_path}/panel/parquet").count() == 2 and spark.read.csv(f"{tmp_path}/panel/csv", header=True).count() == 2
    first = readers.changed_files(spark, str(tmp_path / "panel/parquet/*/*.parquet"), None)
    assert first.count() == 2 and readers.changed_files(spark, str(tmp_path / "panel/parquet/*/*.parquet"), first).count() == 0


def test_incremental_ingest_adds_only_what_is_new(spark, tmp_path):
    source, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    put = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    put([1, 2, 2])
    ingest_new(spark, source, "doc_id long, text string", store, mark, "doc_id")
    put([2, 3])
    ingest_new(spark, source, "doc_id long, text string", store, mark, "doc_id")
    ingest_new(spark, source, "doc_id long, text string", store, mark, "doc_id")
    assert sorted(r.doc_id for r in spark.read.parquet(store).collect()) == [1, 2, 3]
