"""Joins and running sums in which one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.sources.staging import staged

#: Pieces into which spread_join cuts a group.
SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], *, salts: int = SALTS) -> DataFrame:
    """Inner join of rows with table, whose `on` is unique and without nulls, though many rows may share one value of `on`.

    The rows get a salt from the columns `by`. The table meets the distinct (on, salt) pairs of the rows first, at most
    `salts` of a value, then each pair meets its rows: a group is dealt over `salts` keys, and no more of the table is copied
    than there are pairs.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    pairs = salted.select(*on, "__salt").distinct().join(table, on)
    return salted.join(pairs, [*on, "__salt"]).drop("__salt")


#: Most rows of a written table of a few numbers a row that sized_join broadcasts: some 10 MB in memory.
BROADCAST_ROWS = 200_000


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join of rows with a written narrow table: broadcast if its rows, which are counted here, are at most BROADCAST_ROWS; else
    spread_join with the salt columns `by` (inner joins of hot values), or without `by` a shuffle join."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    return spread_join(rows, table, on, by) if by and how == "inner" else rows.join(table, on, how)


def prefix_sums(df: DataFrame, group: str, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each (new column: value column) of sums, the sum of the rows before it within its group.

    The rows are range-partitioned on (group, order), written once with the number of their partition, summed by
    partition and group (a row each), and only those few rows are accumulated by group. A group of any size is spread
    over as many tasks as it fills. Rows that tie in order are interchangeable.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    laid = df.withColumns(keys).repartitionByRange(parts, F.col(group).asc_nulls_first(), *[F.col(k) for k in keys])
    laid = staged(laid.withColumn("__part", F.spark_partition_id()), name)
    totals = laid.groupBy(group, "__part").agg(*[F.sum(v).alias(f"__t_{c}") for c, v in sums.items()])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"),
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
    )
    inside = Window.partitionBy("__part", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = laid.withColumns({c: F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in sums.items()})
    joined = own.join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumns({c: F.col(c) + F.col(f"__o_{c}") for c in sums}).drop(
        "__part", "__g", "__p", *keys, *[f"__o_{c}" for c in sums])


def last_known(df: DataFrame, groups: list[str], order: list[Column], value: str, name: str, label: str) -> DataFrame:
    """df with `name`, the last value that is not null up to each row of its group in order, its own included.

    Laid out as in prefix_sums: a group of any size is spread over as many tasks as it fills, and the last value of each
    partition and group (a row each) is carried on to the partitions after it. Rows that tie in order are interchangeable.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    laid = df.withColumns(keys).repartitionByRange(parts, *[F.col(g).asc_nulls_first() for g in groups], *[F.col(k).asc_nulls_first() for k in keys])
    laid = staged(laid.withColumn("__part", F.spark_partition_id()), label)
    sorted_keys = [F.col(k).asc_nulls_first() for k in keys]
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("__part", *groups).orderBy(*sorted_keys).rowsBetween(Window.unboundedPreceding, 0))
    ends = laid.groupBy(*groups, "__part").agg(F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*keys))).alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), carried.alias("__from"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = laid.withColumn("__in", inside).join(ends, same, "left")
    return joined.withColumn(name, F.coalesce("__in", F.col(f"__from.{value}"))).drop("__in", "__from", "__part", "__p", *keys, *[f"__g{i}" for i in range(len(groups))])


def lowest_so_far(df: DataFrame, group: str, order: list[Column], value: str, name: str, label: str) -> DataFrame:
    """df with `name`, the lowest value up to each row of its group in order, its own included; laid out as in last_known."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    laid = df.withColumns(keys).repartitionByRange(parts, F.col(group).asc_nulls_first(), *[F.col(k) for k in keys])
    laid = staged(laid.withColumn("__part", F.spark_partition_id()), label)
    inside = F.min(value).over(Window.partitionBy("__part", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    ends = laid.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.min(value).alias("__end"))
    carried = F.min("__end").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    joined = laid.withColumn("__in", inside).join(ends.select("__g", "__p", carried.alias("__from")), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumn(name, F.least("__in", "__from")).drop("__in", "__from", "__part", "__p", "__g", *keys)
