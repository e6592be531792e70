"""Exact nearest neighbours by a metric index: cells around pivots, of which a query visits only those that may hold a near point.

Pivots are points drawn by a hash of their key, about the square root of their number and at most PIVOTS, so the broadcast is
bounded. Each point lies in the cell of its nearest pivot; a cell knows its number of points and the least and largest distance to
its pivot. A query first visits the nearest cells that hold more than k points, which bounds its k-th distance, then every cell
that the triangle inequality can't exclude: a point x in the cell of p is at least d(q, p) - largest, least - d(q, p), and
(d(q, p) - d(q, nearest pivot)) / 2 away. So the number of passes doesn't depend on the number of queries.

A visit is a join of queries and points by cell; cells are cut into pieces of BLOCK points and the queries that visit a cell into
chunks of BLOCK, so that no group is larger, whatever the data. Each group gives its k best for each of its queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.operators.spread import sized_join
from panelspark.sources.staging import Scratch

#: Most pivots (of 64 numbers, 8 MB), and rows of either side of a group.
PIVOTS, BLOCK = 1 << 14, 4096


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((b - x) ** 2).sum(axis=1)) for x in a]) if len(a) and len(b) else np.zeros((len(a), len(b)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))


def _visited(spark, points: DataFrame, queries: DataFrame, visits: DataFrame, cells: DataFrame, k: int, block: int, scratch: Scratch, name: str) -> DataFrame:
    """(query, key, distance): the k nearest points in the cells that a query visits; visits (query, cell) is written."""
    key = points.schema["key"]
    sizes = scratch.put(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")).join(cells.select("cell", "pieces"), "cell"), f"{name}-sizes")
    each = sized_join(visits, sizes, ["cell"], by=["query"]).join(queries, "query")
    each = each.withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    held = sized_join(points, sizes, ["cell"], by=["key"]).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": q["query"][:0], "key": p["key"][:0], "distance": np.zeros(0)})]
        if len(q) and len(p):
            p = p.sort_values("key")  # the stable sort below then goes by (distance, key)
            ids, matrix = p["key"].to_numpy(), _matrix(p["vector"], 1)
            for lo in range(0, len(q), 64):
                part = q.iloc[lo : lo + 64]
                d = _distances(_matrix(part["vector"], 1), matrix)
                d[part["query"].to_numpy()[:, None] == ids[None, :]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                found = pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), near.shape[1]), "key": ids[near.ravel()], "distance": np.take_along_axis(d, near, 1).ravel()})
                out.append(found[np.isfinite(found["distance"])])
        return pd.concat(out, ignore_index=True)

    schema = T.StructType([T.StructField("query", key.dataType), T.StructField("key", key.dataType), T.StructField("distance", T.DoubleType())])
    groups = ["cell", "piece", "chunk"]
    return each.select(*groups, "query", "vector").groupBy(*groups).cogroup(held.select(*groups, "key", "vector").groupBy(*groups)).applyInPandas(lambda q, p: best(q, p), schema)


def neighbours(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query, key, distance, rank): the k nearest points of each query row by Euclidean distance, itself left out, of equal ones the
    smaller key. Rows without a key or a vector are left out; keys are unique."""
    spark = points.sparkSession
    scratch = Scratch(spark, "nearest")
    slim = lambda df, name: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("vector")).dropna()
    wanted, rows = scratch.put(slim(queries, "query"), "queries"), slim(points, "key")
    n = rows.count()
    if not n:
        return wanted.select("query", F.col("query").alias(key), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(min(PIVOTS, pivots or max(1, math.isqrt(n)))).select("vector").toPandas()["vector"]
    centres = np.stack(drawn.to_numpy()).astype(np.float64)
    sent = spark.sparkContext.broadcast(centres)

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                d = _distances(_matrix(part["vector"], 1), sent.value)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), r=d[np.arange(len(cell)), cell])

    points = scratch.put(rows.mapInPandas(located, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])), "points")
    cells = scratch.put(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces")), "cells")
    table = cells.toPandas().set_index("cell")  # a row for each pivot
    known = [table[c].reindex(range(len(centres)), fill_value=0).to_numpy() for c in ("n", "least", "most")]
    bounds = spark.sparkContext.broadcast(known)
    query_type = wanted.schema["query"]

    def chosen(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        counts, least, most = bounds.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                d = _distances(_matrix(part["vector"], 1), sent.value)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                near = np.zeros(d.shape, bool)
                np.put_along_axis(near, order, before <= k, axis=1)  # the cells up to the one that makes more than k points
                near &= counts[None, :] > 0
                if first:
                    take = near
                else:
                    bound = np.maximum(np.maximum(d - most, least - d), (d - d.min(axis=1, keepdims=True)) / 2)
                    take = ~near & (counts[None, :] > 0) & (bound <= part["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12)
                i, cell = np.nonzero(take)
                yield pd.DataFrame({"query": part["query"].to_numpy()[i], "cell": cell.astype(np.int32)})

    pair = T.StructType([query_type, T.StructField("cell", T.IntegerType())])
    ahead = scratch.put(wanted.mapInPandas(lambda it: chosen(it, True), pair), "visits-1")
    by_query = Window.partitionBy("query").orderBy("distance", "key")
    best = lambda df: df.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    found = scratch.put(best(_visited(spark, points, wanted, ahead, cells, k, block, scratch, "first")).drop("rank"), "found-1")
    reach = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
    later = wanted.join(reach, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    more = scratch.put(later.mapInPandas(lambda it: chosen(it, False), pair), "visits-2")
    result = best(found.unionByName(_visited(spark, points, wanted, more, cells, k, block, scratch, "second")))
    result = scratch.put(result, "result")
    scratch.keep("result")
    return result.select("query", F.col("key").alias(key), "distance", "rank")
