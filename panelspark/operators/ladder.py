"""Nested regressions for each period from one table of moments.

One pass over the rows sums, for each period and cluster, the products of all columns with one another (moved by their means
first, so that no digits are lost). The sums over clusters give every step of every period: a step is a submatrix, standardised
by a linear map. A second pass, over the table of clusters (over the rows where errors are robust and not clustered), adds up
the squared scores of all steps of all periods at once. So there are as many jobs for one step as for all. One set of fixed
effects is taken out by weighted means of period and level beforehand; with several each step is fitted by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import stats
from panelspark.operators.spread import sized_join
from panelspark.sources.staging import Scratch


def _full(values: list[float], q: int) -> np.ndarray:
    """The symmetric matrix of products from its upper half."""
    out = np.zeros((q, q))
    out[np.triu_indices(q)] = values
    return out + np.triu(out, 1).T


def ladder(df: DataFrame, y: str, x: str, controls: list[list[str]], period: str, *, weight: str | None = None, cluster: str | None = None, absorb: list[str] = ()) -> list[tuple]:
    """(period, number of control sets, estimate of x, error, t, r2, n) of nested regressions: x alone, then with one more set of
    controls each. All steps take the rows in which no control is null, so that they differ in controls alone; regressors
    are in standard deviations within the period, 0/1 ones stay; a step with fewer than its regressors and five rows is left out.
    The periods and steps are few by nature: their results are a list on the driver."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ladder")
    names = [x, *[c for s in controls for c in s]]
    columns = [*names, y]
    used = dict.fromkeys([period, *columns, *([weight] if weight else []), *([cluster] if cluster else []), *absorb])
    kept = df.select(*[F.col(c) for c in used]).dropna()
    if len(absorb) > 1:
        return _one_by_one(scratch.put(kept, "rows"), y, x, controls, period, weight=weight, cluster=cluster, absorb=absorb)
    kept = kept.select(F.col(period).alias("p"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(cluster) if cluster else F.lit(0)).alias("cl"),
                       *[F.col(a).alias("g") for a in absorb], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    rows = kept = scratch.put(kept, "rows")
    m = len(columns)
    shift = [v or 0.0 for v in rows.agg(*[F.avg(f"v{i}") for i in range(m)]).first()]
    if absorb:
        means = scratch.put(rows.groupBy("p", "g").agg(*[(F.sum(F.col("w") * F.col(f"v{i}")) / F.sum("w")).alias(f"m{i}") for i in range(m)]), "means")
        levels = dict(means.groupBy("p").count().collect())
        rows = sized_join(rows, means, ["p", "g"], by=["cl", *[f"v{i}" for i in range(m)]])
        c = [F.lit(0.0), *[F.col(f"v{i}") - F.col(f"m{i}") for i in range(m)]]
    else:
        levels = {}
        c = [F.lit(1.0), *[F.col(f"v{i}") - shift[i] for i in range(m)]]
    rows = rows.withColumns({f"c{i}": v for i, v in enumerate(c)})
    q = m + 1
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    raw = [F.col(f"v{i}") - shift[i] for i in range(m)]
    more = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * raw[-1]).alias("wy"), F.sum(F.col("w") * raw[-1] * raw[-1]).alias("wyy")]
    more += [F.sum(raw[i]).alias(f"s{i}") for i in range(m - 1)] + [F.sum(raw[i] * raw[i]).alias(f"q{i}") for i in range(m - 1)] + [F.min(F.col(f"v{i}").isin(0.0, 1.0)).alias(f"f{i}") for i in range(m - 1)]
    by = scratch.put(rows.groupBy("p", "cl").agg(F.array(*[F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]).alias("gram"), *more), "clusters")
    add = [F.sum(F.col("gram")[i]) for i in range(len(pairs))]
    whole = by.groupBy("p").agg(F.array(*add).alias("gram"), F.count(F.lit(1)).alias("clusters"), *[(F.min if k[0] == "f" else F.sum)(k).alias(k) for k in by.columns if k not in ("p", "cl", "gram")]).collect()
    fits: dict = {}
    for r in whole:
        gram = _full(r["gram"], q)
        for step in range(len(controls) + 1):
            k = 1 + sum(len(s) for s in controls[:step])
            if r["n"] < k + 5:
                continue
            # columns of the step: the constant (none with fixed effects) and its regressors
            take = [*([] if absorb else [0]), *range(1, k + 1)]
            scale = []
            for i in range(k):
                sd = math.sqrt(max(r[f"q{i}"] - r[f"s{i}"] ** 2 / r["n"], 0.0) / (r["n"] - 1))
                scale.append((0.0 if r[f"f{i}"] else r[f"s{i}"] / r["n"], 1.0 if r[f"f{i}"] or not sd else sd))
            # standardised regressors as combinations of the constant and the moved columns
            t = np.zeros((len(take), len(take)))
            off = 0 if absorb else 1
            if not absorb:
                t[0, 0] = 1.0
            for i, (mean, sd) in enumerate(scale):
                t[i + off, i + off] = 1 / sd
                if not absorb:
                    t[0, i + off] = -(mean if not r[f"f{i}"] else -shift[i]) / sd
            xx, xy = t.T @ gram[np.ix_(take, take)] @ t, t.T @ gram[take, q - 1]
            inverse = np.linalg.pinv(xx)
            beta = inverse @ xy
            left = gram[q - 1, q - 1] - 2 * beta @ xy + beta @ xx @ beta
            total = r["wyy"] - r["wy"] ** 2 / r["w"]
            coef = np.zeros(q)
            coef[take] = t @ beta
            fits[r["p"], step] = {"take": take, "t": t, "inverse": inverse, "beta": beta, "coef": coef, "n": r["n"], "k": len(take) + levels.get(r["p"], 0), "clusters": r["clusters"], "r2": float(1 - left / total) if total else None, "x": off}
    coefs = {}
    for (p, step), f in fits.items():
        coefs.setdefault(p, []).append((step, f["coef"]))

    def meats(sums: dict, p, scores: np.ndarray, step: int) -> None:
        sums[p, step] = sums.get((p, step), 0.0) + scores.T @ scores

    def of_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for p, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                gram = _full(values.values.to_numpy(), q)
                for step, coef in coefs.get(p, ()):
                    meats(sums, p, (gram[:, q - 1] - gram @ coef)[None, :], step)
        yield from out(sums)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            ps = batch.column(0).to_pylist()
            w, c = batch.column(1).to_numpy(), np.stack([batch.column(2 + i).to_numpy() for i in range(q)], axis=1)
            for p in set(ps):
                at = np.array([v == p for v in ps])
                for step, coef in coefs.get(p, ()):
                    e = w[at] * (c[at, q - 1] - c[at] @ coef)
                    meats(sums, p, c[at] * e[:, None], step)
        yield from out(sums)

    kind = rows.schema["p"].dataType
    arrow = by.select("p").limit(0).toArrow().schema.field("p").type

    def out(sums: dict) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        flat = [sums[k].ravel().tolist() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], arrow), pa.array([k[1] for k in keys], pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["p", "step", "meat"])

    ddl = f"p {kind.simpleString()}, step int, meat array<double>"
    parts = by.select("p", "gram").mapInArrow(of_clusters, ddl) if cluster else rows.select("p", "w", *[f"c{i}" for i in range(q)]).mapInArrow(of_rows, ddl)
    done = []
    for p, step, meat in parts.groupBy("p", "step").agg(F.array(*[F.sum(F.col("meat")[i]) for i in range(q * q)]).alias("meat")).collect():
        f = fits[p, step]
        raw_meat = np.array(meat).reshape(q, q)[np.ix_(f["take"], f["take"])]
        free = f["n"] - f["k"]
        if f["n"] <= f["k"] or (cluster and f["clusters"] < 2):
            fix = math.nan
        else:
            fix = f["clusters"] / (f["clusters"] - 1) * (f["n"] - 1) / free if cluster else f["n"] / free
        se = float(np.sqrt(np.diag(f["inverse"] @ f["t"].T @ raw_meat @ f["t"] @ f["inverse"]) * fix)[f["x"]])
        b = float(f["beta"][f["x"]])
        done.append((str(p), step, b, se, b / se if se > 0 else None, f["r2"], f["n"]))
    scratch.keep()
    return sorted(done, key=lambda r: r[:2])


def _one_by_one(kept: DataFrame, y: str, x: str, controls: list[list[str]], period: str, **options) -> list[tuple]:
    out = []
    for (p,) in kept.select(period).distinct().orderBy(period).collect():
        for k in range(len(controls) + 1):
            fit = stats.least_squares(kept.filter(F.col(period) == p), y, [x, *[c for s in controls[:k] for c in s]], standardise=True, **options)
            if fit:
                estimate = next(e for e in fit["terms"] if e[0] == x)
                out.append((str(p), k, *estimate[1:4], fit["r2"], fit["n"]))
    return out
