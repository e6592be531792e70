"""Weighted and robust statistics: sums in Spark, only k x k systems on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.codes import haversine_km
from panelspark.operators import effects
from panelspark.operators.spread import sized_join
from panelspark.sources.staging import Scratch, staged


def weighted_corr(df: DataFrame, by: list[str], x: str, y: str, w: str, least: int = 3) -> DataFrame:
    """Rows without x, y or weight are left out; null below `least` rows or without variance. Centred by window means first."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(w).isNotNull())
    means = known.groupBy(*by).agg((F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("__mx"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("__my"))
    c = known.join(means, by)
    dx, dy, weight = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my"), F.col(w)
    r = F.try_divide(F.sum(weight * dx * dy), F.sqrt(F.sum(weight * dx * dx) * F.sum(weight * dy * dy)))
    return c.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, r).alias("r"), F.count(F.lit(1)).alias("n"))


def least_squares(df: DataFrame, y: str, xs: list[str], weight: str | None = None, absorb: list[str] = (), cluster: str | None = None, *, standardise: bool = False,
                  least: int | None = None, keep: list[str] = ()) -> dict | None:
    """Weighted least squares with HC1 or clustered errors, over the rows in which nothing that is used is null.

    With `standardise`, regressors are in standard deviations (ddof 1) unless they only take 0 and 1; y stays in its units.
    `absorb` are fixed effects: one set is taken out by weighted group means, several as in `effects`. Fewer than `least` rows
    (len(xs) + 5 with `standardise`) give None.

    The result: n, r2 (of the whole model, fixed effects included), terms as (name, estimate, error, t, p) with p from the
    normal distribution, and residuals, a DataFrame of the columns `keep` and `residual`. Spark computes X'WX, X'Wy and the sums
    of squared scores; the driver solves a system of len(xs) + 1 unknowns.
    """
    if len(absorb) > 1:
        return effects.fit(df, y, xs, list(absorb), weight=weight, cluster=cluster, standardise=standardise, least=least, keep=keep)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    names, sets = [f"x{i}" for i in range(len(xs))], [f"g{i}" for i in range(len(absorb))]
    rows = df.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(n) for n, x in zip(names, xs)], w.alias("w"),
                     *[F.col(a).alias(g) for g, a in zip(sets, absorb)], (F.col(cluster) if cluster else F.lit(0)).alias("cl"), *[F.col(k).alias(f"k_{k}") for k in keep])
    rows = rows.dropna(subset=["y", "w", "cl", *names, *sets])
    spread = [F.stddev_samp(c) for c in ["y", *names]]
    first = rows.agg(F.count(F.lit(1)), F.sum(F.col("w") * F.col("y")) / F.sum("w"), *spread, *[F.avg(c) for c in names], *[F.min(F.col(c).isin(0.0, 1.0)) for c in names]).first()
    n, mean_y, sd = first[0], first[1], [v or 0.0 for v in first[2 : 3 + len(xs)]]
    if n < (len(xs) + 5 if standardise and least is None else least or 0):
        return None
    if standardise:
        means, flags = first[3 + len(xs) : 3 + 2 * len(xs)], first[3 + 2 * len(xs) :]
        for i, c in enumerate(names):
            if not flags[i]:
                rows = rows.withColumn(c, (F.col(c) - means[i]) / sd[i + 1] if sd[i + 1] else F.lit(0.0))
                sd[i + 1] = 1.0
    rows = rows.withColumn("y0", F.col("y"))
    groups = 0
    for g in sets:
        means = rows.groupBy(g).agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m_{c}") for c in ["y", *names]])
        rows = rows.join(means, g).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in ["y", *names]}).drop(*[f"m_{c}" for c in ["y", *names]])
    if absorb:
        groups = sum(rows.agg(*[F.count_distinct(g) for g in sets]).first()) - (len(absorb) - 1)
    else:
        rows, names = rows.withColumn("one", F.lit(1.0)), ["one", *names]
    k = len(names)
    col = {n: F.col(n) for n in names}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(F.sum(F.col("w") * (F.col("y0") - mean_y) * (F.col("y0") - mean_y)), *[F.sum(F.col("w") * col[names[i]] * col[names[j]]) for i, j in pairs], *[F.sum(F.col("w") * col[n] * F.col("y")) for n in names]).first()
    total, xx, xy = sums[0], np.zeros((k, k)), np.array(sums[1 + len(pairs) :], float)
    for (i, j), v in zip(pairs, sums[1:]):
        xx[i, j] = xx[j, i] = v
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    fitted = sum((F.lit(float(b)) * col[m] for b, m in zip(beta, names)), F.lit(0.0))
    rows = rows.withColumn("residual", F.col("y") - fitted)
    scored = rows.withColumn("e", F.col("w") * F.col("residual"))
    scores = {f"s{i}": F.sum(F.col("e") * col[m]) if cluster else F.col("e") * col[m] for i, m in enumerate(names)}
    left = F.sum(F.col("e") * F.col("residual")) if cluster else F.col("e") * F.col("residual")
    scored = scored.groupBy("cl").agg(left.alias("left"), *[v.alias(c) for c, v in scores.items()]) if cluster else scored.select(left.alias("left"), *[v.alias(c) for c, v in scores.items()])
    meat_row = scored.agg(F.count(F.lit(1)), F.sum("left"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, meat_row[2:]):
        meat[i, j] = meat[j, i] = v
    free = n - k - groups
    fix = meat_row[0] / (meat_row[0] - 1) * (n - 1) / free if cluster else n / free
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * fix)
    labels = xs if absorb else ["constant", *xs]
    terms = []
    for m, b, e in zip(labels, beta, se):
        t = float(b / e) if e > 0 else None
        terms.append((m, float(b), float(e), t, None if t is None else math.erfc(abs(t) / math.sqrt(2))))
    return {"n": n, "r2": 1 - meat_row[1] / total if total else None, "terms": terms, "residuals": rows.select(*[F.col(f"k_{c}").alias(c) for c in keep], "residual")}


def two_way(df: DataFrame, y: str, x: str, unit: str, time: str, *, least_units: int = 15, least_times: int = 4, **options) -> dict | None:
    """y on x in standard deviations, with effects of unit and time, clustered by unit: estimate, error, t, p, n. None below the
    least numbers of units and times that have both."""
    known = df.select(unit, time, y, x).dropna()
    units, times = known.agg(F.count_distinct(unit), F.count_distinct(time)).first()
    if units < least_units or times < least_times:
        return None
    fit = least_squares(known, y, [x], absorb=[unit, time], cluster=unit, standardise=True, **options)
    if fit is None:
        return None
    _, estimate, error, t, p = fit["terms"][0]
    return {"estimate": estimate, "se": error, "t": t, "p": p, "n": fit["n"]}


def nearest_weights(places: DataFrame, key: str, lat: str, lon: str, k: int = 8) -> DataFrame:
    """(key, neighbour, km, weight): row-standardised weights, one k-th for each of the k nearest other places by great-circle
    distance (of equal distances the smaller key); with fewer than k others, each has an equal part of 1.

    Places lie on the unit sphere in cubic cells. A place looks in its own cell and those around it; it is done once its k-th
    neighbour is nearer than a cell is wide, and looks again in cells twice as wide else. Each round is an equi-join of the
    places that are left; the last cells hold the whole sphere.
    """
    a, o = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    rows = places.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("a"), F.col(lon).cast("double").alias("o"), (F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z")).dropna()
    left = rows = staged(rows, "places")
    width = min(2.0, math.sqrt(4 * math.pi * k / max(1, rows.count())) / 2)
    out = None
    while True:
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        around = lambda c: F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)]))  # noqa: E731, B023
        points = rows.select(F.col("k").alias("n"), F.col("a").alias("b"), F.col("o").alias("p"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
        look = left.withColumn("cx", around("x")).withColumn("cy", around("y")).withColumn("cz", around("z"))
        pairs = look.join(points, ["cx", "cy", "cz"]).filter("k <> n")
        pairs = pairs.select("k", "n", haversine_km(F.col("a"), F.col("o"), F.col("b"), F.col("p")).alias("km"))
        near = staged(pairs.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("km", "n"))).filter(F.col("r") <= k), "nearest")
        reach = 2 * 6371.0 * math.asin(min(1.0, width / 2))
        proven = near.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("km").alias("m")).filter(F.lit(width >= 2) | ((F.col("c") == k) & (F.col("m") < reach))).select("k", "c")
        found = near.join(proven, "k").select(F.col("k").alias(key), F.col("n").alias("neighbour"), "km", (1.0 / F.col("c")).alias("weight"))
        out = found if out is None else out.unionByName(found)
        if width >= 2:
            return out
        left = staged(left.join(proven, "k", "left_anti"), "places-left")
        if left.isEmpty():
            return out
        width = min(2.0, 2 * width)


def pagerank(edges: DataFrame, src: str, dst: str, weight: str, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """(node, rank), once the changes of a round sum to less than tolerance a node; an error after `rounds` rounds.

    Weights of the same edge add up; nodes without out-edges (or with weights of 0 alone) spread their rank evenly. A node with a
    large part of all edges is dealt over tasks, and what flows into one is summed map-side first. Each round is written and
    the one before it deleted.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    edges = scratch.put(edges.groupBy(F.col(src).alias("node"), F.col(dst).alias("to")).agg(F.sum(F.col(weight).cast("double")).alias("w")).dropna(), "edges")
    out = edges.groupBy("node").agg(F.sum("w").alias("t")).filter("t > 0")
    nodes = edges.select("node").union(edges.select("to")).distinct().join(out, "node", "left")
    nodes = scratch.put(nodes.select("node", F.col("t").isNull().alias("end"), F.coalesce("t", F.lit(1.0)).alias("t")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank, loose = scratch.put(nodes.select("*", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")), "rank-0"), None
    for turn in range(rounds + 1):
        change, loose = rank.agg(F.sum("change"), F.coalesce(F.sum(F.when(F.col("end"), F.col("rank"))), F.lit(0.0))).first()
        if turn and change < n * tolerance:
            scratch.keep(f"rank-{turn}")
            return rank.select("node", "rank")
        if turn == rounds:
            break
        sent = rank.filter(~F.col("end")).select("node", (F.col("rank") / F.col("t")).alias("each"))
        got = sized_join(edges, sent, ["node"], by=["to"]).groupBy(F.col("to").alias("node")).agg(F.sum(F.col("w") * F.col("each")).alias("in"))
        new = (1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + loose / n)
        rank = scratch.put(rank.drop("change").join(got, "node", "left").select("node", "end", "t", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), f"rank-{turn + 1}")
        scratch.drop(f"rank-{turn}")
    raise RuntimeError(f"ranks still change by {change:.3g} after {rounds} rounds")


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, scores) and (place, loadings, explained): the first k components of the centred vectors, what each place of the vector
    contributes to them, and the part of all variance that each explains. A component's largest loading is positive. The
    covariances are summed in Spark; the driver sees a matrix of the vector's length squared."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, F.col(vector).cast("array<double>").alias("__v"))
    mean = rows.select(F.posexplode("__v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = np.array([r.m for r in mean.orderBy("i").collect()])  # as long as a vector
    model = PCA(k=k, inputCol="v", outputCol="s").fit(rows.select(array_to_vector("__v").alias("v")))
    pc = model.pc.toArray()
    sign = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(k)])
    pc, shift = pc * sign, (centre @ pc) * sign
    vectors = model.transform(rows.select(key, array_to_vector("__v").alias("v"))).select(key, vector_to_array("s").alias("s"))
    scores = vectors.select(key, F.array(*[F.col("s")[i] * float(sign[i]) - float(shift[i]) for i in range(k)]).alias("scores"))
    explained = [float(v) for v in model.explainedVariance.toArray()]
    loadings = df.sparkSession.createDataFrame([(i, [float(v) for v in row], explained) for i, row in enumerate(pc)], "place int, loadings array<double>, explained array<double>")
    return scores, loadings
