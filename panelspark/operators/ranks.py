"""Ranks, rank correlations and exact quantiles of groups of any size.

Equal values of a group are counted first, map-side. The distinct values are laid out by range, and the rows before each are prefix
sums over tasks (spread.prefix_sums), so that a group, or a value with a large part of all rows, is no task's load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.spread import prefix_sums, sized_join
from panelspark.sources.staging import Scratch


def _group(by: list[str]) -> Column:
    """One string for a group; null is a value like others."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in by])) if by else F.lit("")


def counted(df: DataFrame, group: str, x: str, n: str, label: str) -> DataFrame:
    """(group, x, n, before): the distinct values of a group with their rows and the rows before them; NaN comes last."""
    values = df.groupBy(group, x).agg(F.sum(n).alias("n"))
    return prefix_sums(values, group, [F.col(x)], {"before": "n"}, label)


def rank_corr(df: DataFrame, by: str | list[str], x: str, y: str) -> DataFrame:
    """(by, rho, n): Spearman's correlation over the rows that have both, ties by their average rank; null without variance."""
    by = [by] if isinstance(by, str) else list(by)
    scratch = Scratch(df.sparkSession, "ranks")
    known = df.select(_group(by).alias("g"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    cells = scratch.put(known.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("n"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(len(by))]), "cells")
    sizes = scratch.put(cells.groupBy("g").agg(F.sum("n").alias("size"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(len(by))]), "sizes")
    # rank of a value, twice, less the mean rank, twice: whole numbers
    ranks = {c: scratch.put(counted(cells, "g", c, "n", f"ranks-{c}").select("g", c, (2 * F.col("before") + F.col("n") + 1).alias(f"r{c}")), f"rank-{c}") for c in ("x", "y")}
    rows = sized_join(cells.select("g", "x", "y", "n"), ranks["x"], ["g", "x"], by=["y"])
    rows = sized_join(rows, ranks["y"], ["g", "y"], by=["x"])
    rows = sized_join(rows, sizes.select("g", "size"), ["g"], by=["x", "y"])
    a, b = ((F.col(c) - F.col("size") - 1).cast("double") for c in ("rx", "ry"))
    n = F.col("n").cast("double")
    sums = rows.groupBy("g").agg(F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    out = sizes.join(sums, "g")
    rho = F.try_divide(F.col("ab"), F.sqrt(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("aa") * F.col("bb"))))
    return out.select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(by)], rho.alias("rho"), F.col("size").alias("n"))


def quantiles(df: DataFrame, by: list[str], x: str, probabilities: list[float]) -> DataFrame:
    """(by, q): exact quantiles of the values that are not null, by linear interpolation, an array in the order of `probabilities`.

    The value at place k is the one whose rows before it are at most k and with its own more than k; only those few rows a group
    leave the layout.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    known = df.select(_group(by).alias("g"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], F.col(x).cast("double").alias("x")).dropna(subset=["x"])
    cells = known.groupBy("g", "x").agg(F.count(F.lit(1)).alias("k"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(len(by))])
    cells = scratch.put(cells, "cells")
    sizes = scratch.put(cells.groupBy("g").agg(F.sum("k").alias("size"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(len(by))]), "sizes")
    laid = sized_join(counted(cells, "g", "x", "k", "quantile-values"), sizes.select("g", "size"), ["g"], by=["x"])
    place = lambda p: (F.col("size") - 1) * F.lit(float(p))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), holds(F.floor(place(p))).alias("low"), holds(F.ceil(place(p))).alias("high")) for i, p in enumerate(probabilities)])
    hits = laid.select("g", "x", F.explode(F.filter(each, lambda e: e["low"] | e["high"])).alias("e"))
    ends = hits.groupBy("g", "e.i").agg(F.max(F.when(F.col("e.low"), F.col("x"))).alias("a"), F.max(F.when(F.col("e.high"), F.col("x"))).alias("b"))
    one = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("ends"))  # as many entries as probabilities
    q = F.array(*[F.element_at("ends", i + 1)["a"] + (F.element_at("ends", i + 1)["b"] - F.element_at("ends", i + 1)["a"]) * (place(p) - F.floor(place(p))) for i, p in enumerate(probabilities)])
    return sizes.join(one, "g").select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(by)], q.alias("q"), F.col("size").alias("n"))


def quantile_class(df: DataFrame, by: str, x: str, cuts: int, name: str) -> DataFrame:
    """df with the class 1 to cuts of x by right-closed quantile edges of its group; equal edges collapse. Rows without a group's edges
    have none of it."""
    edges = Scratch(df.sparkSession, "edges").put(quantiles(df, [by], x, [i / cuts for i in range(1, cuts)]).select(F.col(by).alias("__of"), F.array_distinct("q").alias("__e")), "edges")
    rows = df.withColumn("__of", F.col(by))
    small = sized_join(rows, edges, ["__of"], by=[x])
    return small.withColumn(name, F.size(F.filter("__e", lambda e: e < F.col(x))) + 1).drop("__e", "__of")
