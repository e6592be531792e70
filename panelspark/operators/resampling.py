"""Bootstrap intervals of any statistic of weighted moments.

A draw takes each row a Poisson(1) number of times, decided by a hash of its key and the draw, so that all runs agree. A task adds
up, for all draws at once, the sums of w, w * a and w * a * b over its columns (a matrix product of the rows' counts with their
products); such vectors add, so tasks give a row a draw and Spark sums those. Statistics are functions of the moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are counted for all draws at once.
ROWS = 512


class Moments:
    """What a statistic may use: weighted means, variances and covariances of the columns, as columns."""

    def __init__(self, columns: list[str], shift: dict[str, float]):
        self.at, self.shift = {c: i for i, c in enumerate(columns)}, shift

    def _over(self, name: str) -> Column:
        return F.try_divide(F.col(name), F.col("w"))

    def mean(self, a: str) -> Column:
        return self._over(f"m{self.at[a]}") + F.lit(self.shift[a])

    def cov(self, a: str, b: str) -> Column:
        i, j = sorted((self.at[a], self.at[b]))
        return self._over(f"m{i}_{j}") - self._over(f"m{i}") * self._over(f"m{j}")

    def var(self, a: str) -> Column:
        return self.cov(a, a)


def correlation(a: str, b: str) -> Callable[[Moments], Column]:
    """Null where a column doesn't vary."""
    return lambda m: F.try_divide(m.cov(a, b), F.sqrt(F.when((m.var(a) > 0) & (m.var(b) > 0), m.var(a) * m.var(b))))


def slope(y: str, x: str) -> Callable[[Moments], Column]:
    return lambda m: F.try_divide(m.cov(x, y), F.when(m.var(x) > 0, m.var(x)))


def mean(a: str) -> Callable[[Moments], Column]:
    return lambda m: m.mean(a)


def times(h: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) counts of rows with hashes h (unsigned) in draws 1 to `draws`."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    x = h[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(cdf, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")


def bootstrap(df: DataFrame, key: list[str], columns: list[str], statistics: dict[str, Callable[[Moments], Column]], *, weight: str | None = None,
              draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(statistic, value, low, high): each statistic of all rows, and its percentile interval over the draws that have it.

    `key` tells rows apart; rows in which a column or the weight is null are left out. Columns are moved by their means first, so
    that no moment loses digits. Without rows of weight there is no result row.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]).alias("h"), w.alias("w"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.dropna(subset=["w", *[f"c{i}" for i in range(len(columns))]])
    centre = [v or 0.0 for v in rows.agg(*[F.avg(f"c{i}") for i in range(len(columns))]).first()]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    names = ["w", *[f"m{i}" for i in range(len(columns))], *[f"m{i}_{j}" for i, j in pairs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws + 1, len(names)))
        for batch in batches:
            h, weights = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            values = np.stack([batch.column(2 + i).to_numpy() - centre[i] for i in range(len(columns))], axis=1)
            for lo in range(0, len(h), ROWS):
                v = values[lo : lo + ROWS]
                products = np.column_stack([np.ones(len(v)), v, *[v[:, i] * v[:, j] for i, j in pairs]]) * weights[lo : lo + ROWS, None]
                sums[0] += products.sum(axis=0)  # draw 0 is the table itself
                sums[1:] += times(h[lo : lo + ROWS], draws).T.astype(float) @ products
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1, dtype=np.int32)), *[pa.array(sums[:, i].copy()) for i in range(len(names))]], names=["draw", *names])

    each = rows.mapInArrow(run, "draw int, " + ", ".join(f"{n} double" for n in names)).groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])
    m = Moments(columns, dict(zip(columns, centre)))
    stats = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), f(m).alias("v")) for s, f in statistics.items()]))
    tail = (1 - level) / 2
    drawn = F.when((F.col("draw") > 0) & ~F.isnan("v"), F.col("v"))
    return each.select("draw", "w", stats.alias("x")).select("draw", "w", "x.*").groupBy("statistic").agg(
        F.max(F.when(F.col("draw") == 0, F.col("w"))).alias("__w"), F.max(F.when(F.col("draw") == 0, F.col("v"))).alias("value"), F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high")).filter("__w <> 0").drop("__w")
