"""Moran's I over row-standardised neighbour lists: global, local, and by random placements of the values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import spread
from panelspark.operators.panels import placed
from panelspark.sources.staging import Scratch

#: Rounds of the pseudo-random permutation, and edges that a task places for all draws at once.
ROUNDS, EDGES = 4, 1024


def moran(values: DataFrame, edges: DataFrame, unit: str, x: str) -> DataFrame:
    """(unit, z, lag, local, quadrant, i): x in standard deviations (ddof 1), the mean of the neighbours' (0 without one), their
    product, high or low of both (`none` where one of them is 0), and the global I. Units without a value are left out."""
    known = values.select(unit, F.col(x).cast("double").alias("__x")).dropna()
    whole = known.agg(F.avg("__x").alias("__m"), F.stddev_samp("__x").alias("__s"))  # one row
    scratch = Scratch(values.sparkSession, "moran")
    z = scratch.put(known.join(F.broadcast(whole), F.lit(True)).select(unit, F.try_divide(F.col("__x") - F.col("__m"), F.col("__s")).alias("z")), "z")
    near = edges.select(unit, "neighbour").join(z.select(F.col(unit).alias("neighbour"), F.col("z").alias("__z")), "neighbour").groupBy(unit).agg(F.avg("__z").alias("lag"))
    rows = scratch.put(z.join(near, unit, "left").select(unit, "z", F.coalesce("lag", F.lit(0.0)).alias("lag")), "lags")
    scratch.drop("z")
    total = rows.agg(F.try_divide(F.sum(F.col("z") * F.col("lag")), F.sum(F.col("z") * F.col("z"))).alias("i"))  # one row
    side = lambda c: F.when(F.col(c) > 0, "high").when(F.col(c) < 0, "low")
    quadrant = F.coalesce(F.concat(side("z"), F.lit("-"), side("lag")), F.lit("none"))
    return rows.select(unit, "z", "lag", (F.col("z") * F.col("lag")).alias("local"), quadrant.alias("quadrant")).join(F.broadcast(total), F.lit(True))


def shuffled(place: np.ndarray, draw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place that each of places 0 to n-1 has in a draw: an invertible pseudo-random permutation for each draw.

    Feistel rounds permute pairs (left, right) of half the bits each; a result of n or more goes through them again until it is below
    n, which keeps it a permutation.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = place.astype(np.uint64), np.arange(len(place))
    keys = draw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            x = (right + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03)) ^ keys[todo]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _drawn(batch: pa.RecordBatch, n: int, draws: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of both ends of each edge in draws 0 (as they are) to `draws`, with the edge's weight: arrays of draws x edges."""
    a, b, w = (batch.column(i).to_numpy() for i in range(3))
    for lo in range(0, len(a), EDGES):
        x, y = a[lo : lo + EDGES], b[lo : lo + EDGES]
        draw = np.repeat(np.arange(1, draws + 1), len(x))
        move = lambda v: np.concatenate([v, shuffled(np.tile(v, draws), draw, n, seed)]).reshape(draws + 1, -1)  # noqa: B023, E731
        yield move(x), move(y), w[lo : lo + EDGES]


def permutations(values: DataFrame, edges: DataFrame, unit: str, x: str, draws: int = 999, seed: int = 0) -> DataFrame:
    """(i, p): Moran's I and the share of placements of the values, its own counted, whose I is as high.

    A placement gives the unit at place k the value at place shuffled(k, draw), so it needs no sort: the places of both ends of an
    edge join the values. Up to spread.BROADCAST_ROWS values go to the tasks as one array, and a task adds up its edges for all
    draws; beyond that each (edge, draw) joins them twice, dealt over all tasks.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "placements")
    known = values.select(unit, F.col(x).cast("double").alias("__x")).dropna()
    place = placed(known, None, [unit], "__r")
    whole = known.agg(F.avg("__x").alias("__m"), F.stddev_samp("__x").alias("__s"))  # one row
    z = scratch.put(place.join(F.broadcast(whole), F.lit(True)).select(unit, F.col("__r").cast("long").alias("r"), F.coalesce(F.try_divide(F.col("__x") - F.col("__m"), F.col("__s")), F.lit(0.0)).alias("z")), "z")
    n = z.count()
    degree = edges.select(unit, "neighbour").join(z.select(unit), unit, "left_semi").join(z.select(F.col(unit).alias("neighbour")), "neighbour", "left_semi")
    weights = degree.groupBy(unit).agg((1.0 / F.count(F.lit(1))).alias("w"))
    lines = degree.join(weights, unit).join(z.select(unit, F.col("r").alias("a")), unit).join(z.select(F.col(unit).alias("neighbour"), F.col("r").alias("b")), "neighbour")
    lines = scratch.put(lines.select("a", "b", "w"), "edges")
    squares = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0.0
    if n <= spread.BROADCAST_ROWS:
        table = z.orderBy("r").select("z").toArrow().column(0).to_numpy()  # at most BROADCAST_ROWS numbers
        sent = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(draws + 1)
            for batch in batches:
                for a, b, w in _drawn(batch, n, draws, seed):
                    sums += (sent.value[a] * sent.value[b]) @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1)), pa.array(sums)], names=["draw", "s"])

        each = lines.mapInArrow(run, "draw long, s double").groupBy("draw").agg(F.sum("s").alias("s"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in _drawn(batch, n, draws, seed):
                    for d in range(draws + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), d)), pa.array(a[d]), pa.array(b[d]), pa.array(w)], names=["draw", "a", "b", "w"])

        moved = lines.mapInArrow(run, "draw long, a long, b long, w double")
        ends = lambda k, v: z.select(F.col("r").alias(k), F.col("z").alias(v))
        each = moved.join(ends("a", "za"), "a").join(ends("b", "zb"), "b").groupBy("draw").agg(F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("s"))
    own: Column = F.max(F.when(F.col("draw") == 0, F.col("s")))
    each = scratch.put(each, "draws")
    first = each.agg(own.alias("own"))  # one row
    high = (F.col("draw") > 0) & (F.col("s") >= F.col("own") - 1e-12 * squares)
    return each.join(F.broadcast(first), F.lit(True)).groupBy("own").agg(F.count_if(high).alias("n")).select(
        F.try_divide(F.col("own"), F.lit(squares)).alias("i"), ((F.col("n") + 1) / (draws + 1)).alias("p"))
