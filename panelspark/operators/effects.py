"""Regressions with several sets of fixed effects: two passes over the rows, and conjugate gradients on small tables between them.

Pass 1 sums the rows into cells, one for each combination of levels: weights, weighted sums of y and the regressors, and the
moments that standardising needs. The effects that make a column orthogonal to all sets solve weighted normal equations over the
cells. The set with the most levels is eliminated exactly (a weighted mean within it); the rest is solved by conjugate gradients
with the level weights as preconditioner, for all columns at once, on a table with a row for each remaining level. A step is one
read of the cells; with T remaining levels at most T steps are needed. Pass 2 takes the effects out of the rows and sums
X'WX, X'Wy and the residual moments by cluster; estimates and clustered scores come from that table.

Rows are summed map-side first, so a level with a third of all rows is no larger than others; the eliminated level's cells are
at most as many as the combinations of the others. Tables of finished steps are deleted, and all of them at the end.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.spread import sized_join
from panelspark.sources.staging import Scratch


class Absorber:
    """Effects of all sets for each column; rows() takes them out."""

    def __init__(self, cells: DataFrame, columns: list[str], effects: list[str], scratch: Scratch, *, tolerance: float = 1e-11, rounds: int = 1000):
        """cells has the effects, `w` and for each column c `w_c`, its weighted sum; written before."""
        self.columns, self.scratch = columns, scratch
        levels = cells.agg(*[F.count_distinct(g) for g in effects]).first()
        self.levels = dict(zip(effects, levels))
        order = sorted(effects, key=lambda g: -self.levels[g])
        self.main, self.rest = order[0], order[1:]
        self.cells = scratch.put(cells.withColumns({f"l_{g}": F.col(g).cast("string") for g in self.rest}), "effect-cells")
        solved = self._solve(tolerance, rounds)
        self.tables = {g: scratch.put(solved.filter(F.col("g") == g).select(F.col("level").alias(f"l_{g}"), *[F.col(f"d_{c}").alias(f"e_{g}_{c}") for c in columns]), f"effect-{g}") for g in self.rest}
        left = self._with(self.cells, self.tables)
        own = {f"e_{self.main}_{c}": F.sum(F.col(f"w_{c}") - F.col("w") * sum(F.col(f"e_{g}_{c}") for g in self.rest)) / F.sum("w") for c in columns}
        self.tables[self.main] = scratch.put(left.groupBy(self.main).agg(*[v.alias(k) for k, v in own.items()]), f"effect-{self.main}")
        scratch.keep(*[f"effect-{g}" for g in effects])

    def _with(self, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        for g, table in tables.items():
            key = self.main if g == self.main else f"l_{g}"
            df = sized_join(df, table, [key], by=["w", *[c for c in df.columns if c.startswith("l_") and c != key]])
        return df

    def _down(self, values: dict[str, Column], rows: DataFrame) -> DataFrame:
        """(g, level, columns): sums over the cells of each remaining level of w * (value - its mean within the main set); the values
        are weighted sums of a cell."""
        by = Window.partitionBy(self.main)
        rows = rows.withColumn("__w", F.sum("w").over(by)).withColumns({f"t_{c}": v for c, v in values.items()})
        rows = rows.withColumns({f"t_{c}": F.col(f"t_{c}") - F.col("w") * F.sum(f"t_{c}").over(by) / F.col("__w") for c in values})
        each = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"l_{g}").alias("level")) for g in self.rest]))
        rows = rows.select(each.alias("x"), "w", *[f"t_{c}" for c in values])
        return rows.groupBy("x.g", "x.level").agg(F.sum("w").alias("w"), *[F.sum(f"t_{c}").alias(f"a_{c}") for c in values])

    def _solve(self, tolerance: float, rounds: int) -> DataFrame:
        cs = self.columns
        rhs = self._down({c: F.col(f"w_{c}") for c in cs}, self.cells)
        state = self.scratch.put(rhs.select("g", "level", "w", *[F.lit(0.0).alias(f"d_{c}") for c in cs], *[F.col(f"a_{c}").alias(f"r_{c}") for c in cs], *[(F.col(f"a_{c}") / F.col("w")).alias(f"p_{c}") for c in cs]), "effect-state-0")
        norm = np.array(state.agg(*[F.coalesce(F.sum(F.col(f"r_{c}") * F.col(f"r_{c}") / F.col("w")), F.lit(0.0)) for c in cs]).first(), float)
        scale = np.array(self.cells.agg(*[F.coalesce(F.sum(F.col(f"w_{c}") * F.col(f"w_{c}") / F.col("w")), F.lit(0.0)) for c in cs]).first(), float)
        rz, limit = norm.copy(), np.maximum(tolerance**2 * norm, 1e-30 * scale)
        done = rz <= limit
        for turn in range(1, rounds + 1):
            if done.all():
                return state
            rows = self.cells
            for g in self.rest:
                p = state.filter(F.col("g") == g).select(F.col("level").alias(f"l_{g}"), *[F.col(f"p_{c}").alias(f"p_{g}_{c}") for c in cs])
                rows = sized_join(rows, p, [f"l_{g}"], by=[self.main])
            ap = self._down({c: F.col("w") * sum(F.col(f"p_{g}_{c}") for g in self.rest) for c in cs}, rows).drop("w")
            both = self.scratch.put(state.join(ap, ["g", "level"]), f"effect-step-{turn}")
            sums = both.agg(*[F.sum(F.col(f"p_{c}") * F.col(f"a_{c}")) for c in cs], *[F.sum(F.col(f"p_{c}") * F.col(f"p_{c}") * F.col("w")) for c in cs]).first()
            pap, pp = (np.array(sums[i * len(cs) : (i + 1) * len(cs)], float) for i in range(2))
            # a direction that moves nothing is a constant of a connected part, which the data don't tell from the main set's
            done |= pap <= 1e-14 * pp
            live = ~done
            alpha = np.where(live, rz / np.where(live, pap, 1.0), 0.0)
            left = {c: F.col(f"r_{c}") - F.lit(float(a)) * F.col(f"a_{c}") for c, a in zip(cs, alpha)}
            after = np.array(both.agg(*[F.sum(r * r / F.col("w")) for r in left.values()]).first(), float)
            beta = np.where(live, after / np.where(rz > 0, rz, 1.0), 0.0)
            new = {}
            for c, a, b in zip(cs, alpha, beta):
                new |= {f"d_{c}": F.col(f"d_{c}") + F.lit(float(a)) * F.col(f"p_{c}"), f"r_{c}": left[c], f"p_{c}": left[c] / F.col("w") + F.lit(float(b)) * F.col(f"p_{c}")}
            state = both.select("g", "level", "w", *[v.alias(k) for k, v in new.items()])
            rz = np.where(live, after, rz)
            done |= rz <= limit
            self.scratch.drop(f"effect-step-{turn - 1}", "effect-state-0" if turn > 1 else "")
        raise RuntimeError(f"fixed effects not solved after {rounds} steps: a residual of {float(np.sqrt(np.max(np.where(done, 0, rz / np.maximum(norm, 1e-300))))):.3g} is left")

    def rows(self, rows: DataFrame, scale: dict[str, float]) -> DataFrame:
        """rows with each column's effects taken out, divided by its scale."""
        rows = self._with(rows.withColumns({f"l_{g}": F.col(g).cast("string") for g in self.rest}), self.tables)
        out = {c: (F.col(c) - sum(F.col(f"e_{g}_{c}") for g in (self.main, *self.rest))) / F.lit(scale[c]) for c in self.columns}
        return rows.withColumns(out).drop(*[f"l_{g}" for g in self.rest], *[f"e_{g}_{c}" for g in (self.main, *self.rest) for c in self.columns])


def fit(df: DataFrame, y: str, xs: list[str], absorb: list[str], *, weight: str | None = None, cluster: str | None = None, standardise: bool = False,
        least: int | None = None, keep: list[str] = ()) -> dict | None:
    """Weighted least squares with two or more sets of fixed effects, as stats.least_squares gives it: rows in which nothing that is
    used is null; regressors in standard deviations with `standardise` unless they only take 0 and 1; HC1 or clustered errors."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    names, effects = [f"x{i}" for i in range(len(xs))], [f"g{i}" for i in range(len(absorb))]
    columns = ["y", *names]
    rows = df.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(n) for n, x in zip(names, xs)], w.alias("w"),
                     *[F.col(a).alias(g) for g, a in zip(effects, absorb)], (F.col(cluster) if cluster else F.lit(0)).alias("cl"), *[F.col(k).alias(f"k_{k}") for k in keep])
    rows = rows.dropna(subset=["y", "w", "cl", *names, *effects])
    scratch = Scratch(df.sparkSession, "effects")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy")]
    for c in columns:
        sums += [F.sum(F.col("w") * F.col(c)).alias(f"w_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"), F.min(F.col(c).isin(0.0, 1.0)).alias(f"f_{c}")]
    cells = scratch.put(rows.groupBy(*effects).agg(*sums), "cells")
    total = cells.agg(F.sum("n"), F.sum("w"), F.sum("w_y"), F.sum("wyy"), *[F.sum(f"s_{c}") for c in names], *[F.sum(f"q_{c}") for c in names], *[F.min(f"f_{c}") for c in names]).first()
    n, k = total[0] or 0, len(xs)
    if n < (k + 5 if standardise and least is None else least or 1):
        scratch.keep()
        return None
    scale = dict.fromkeys(columns, 1.0)
    for i, c in enumerate(names):
        s, q, flag = total[4 + i], total[4 + k + i], total[4 + 2 * k + i]
        if standardise and not flag:
            sd = math.sqrt(max(q - s * s / n, 0.0) / (n - 1))
            scale[c] = sd or 1.0
    mean_y = total[2] / total[1]
    whole = total[3] - total[2] * mean_y
    absorber = Absorber(cells.select(*effects, "w", *[f"w_{c}" for c in columns]), columns, effects, scratch)
    groups = sum(absorber.levels.values()) - (len(effects) - 1)
    plain = absorber.rows(rows, scale)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c) for c in names]
    moments = [F.sum(F.col("w") * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs] + [F.sum(F.col("w") * x[i] * F.col("y")).alias(f"b{i}") for i in range(k)] + [F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy")]
    by = scratch.put(plain.groupBy("cl").agg(*moments), "clusters")
    sums = by.agg(*[F.sum(f"a{i}_{j}") for i, j in pairs], *[F.sum(f"b{i}") for i in range(k)], F.sum("yy"), F.count(F.lit(1))).first()
    xx, xy = np.zeros((k, k)), np.array(sums[len(pairs) : len(pairs) + k], float)
    for (i, j), v in zip(pairs, sums):
        xx[i, j] = xx[j, i] = v
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    left = sums[-2] - 2 * beta @ xy + beta @ xx @ beta
    lit = [F.lit(float(b)) for b in beta]
    if cluster:
        score = [F.col(f"b{i}") - sum((F.col(f"a{min(i, j)}_{max(i, j)}") * lit[j] for j in range(k)), F.lit(0.0)) for i in range(k)]
        meat_row = by.agg(*[F.sum(score[i] * score[j]) for i, j in pairs]).first()
        fix = sums[-1] / (sums[-1] - 1) * (n - 1) / (n - k - groups) if sums[-1] > 1 and n > k + groups else math.nan
    else:  # robust errors take the residuals of single rows, a third pass
        e = F.col("w") * (F.col("y") - sum((b * c for b, c in zip(lit, x)), F.lit(0.0)))
        meat_row = plain.agg(*[F.sum(e * e * x[i] * x[j]) for i, j in pairs]).first()
        fix = n / (n - k - groups) if n > k + groups else math.nan
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, meat_row):
        meat[i, j] = meat[j, i] = v
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * fix)
    terms = []
    for name, b, s in zip(xs, beta, se):
        t = float(b / s) if s > 0 else None
        terms.append((name, float(b), float(s), t, None if t is None else math.erfc(abs(t) / math.sqrt(2))))
    fitted = sum((b * c for b, c in zip(lit, x)), F.lit(0.0))
    residuals = None
    if keep:
        residuals = plain.select(*[F.col(f"k_{c}").alias(c) for c in keep], (F.col("y") - fitted).alias("residual"))
        scratch.keep(*[f"effect-{g}" for g in effects])
    else:
        scratch.keep()
    return {"n": n, "r2": 1 - float(left) / whole if whole else None, "terms": terms, "residuals": residuals}
