"""Novelty and search of firms over moving windows of years: range frames, never self joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.panels import years_before


def exploration(main: DataFrame, every: DataFrame, firm: str, year: str, cls: str, share: str, width: int) -> DataFrame:
    """(firm, year, docs, explore, new_classes): fractional documents whose main class none of the firm's documents had in the
    `width` years before, by any of their classes. The measures are null before the firm-wide first year + width."""
    used = every.select(firm, year, cls).distinct().withColumn("__seen", F.lit(1)).withColumn("__w", F.lit(0.0))
    own = main.groupBy(firm, year, cls).agg(F.sum(share).alias("__w")).withColumn("__seen", F.lit(0))
    rows = used.unionByName(own).groupBy(firm, year, cls).agg(F.max("__seen").alias("__seen"), F.sum("__w").alias("__w"))
    before = F.max(F.when(F.col("__seen") == 1, F.col(year))).over(years_before([firm, cls], year, width))
    rows = rows.withColumn("__new", before.isNull())
    first = main.agg(F.min(year).alias("__first"))
    out = rows.groupBy(firm, year).agg(F.sum("__w").alias("docs"), F.sum(F.when(F.col("__new"), F.col("__w")).otherwise(0.0)).alias("explore"), F.count_if(F.col("__new") & (F.col("__seen") == 1)).alias("new_classes"))
    known = F.col(year) >= F.col("__first") + width
    return out.join(F.broadcast(first), F.lit(True)).select(firm, year, "docs", F.when(known, F.col("explore")).alias("explore"), F.when(known, F.col("new_classes")).alias("new_classes"))  # one row


def search(cites: DataFrame, firm: str, year: str, cited: str, width: int) -> DataFrame:
    """(firm, year, depth, scope): how often the firm's citations of a year had been made by it in the `width` years before,
    and the share of them that had not."""
    n = cites.groupBy(firm, year, cited).agg(F.count(F.lit(1)).alias("__n"))
    prior = F.coalesce(F.sum("__n").over(years_before([firm, cited], year, width)), F.lit(0))
    n = n.withColumn("__prior", prior)
    return n.groupBy(firm, year).agg((F.sum(F.col("__n") * F.col("__prior")) / F.sum("__n")).alias("depth"), (F.sum(F.when(F.col("__prior") == 0, F.col("__n")).otherwise(0)) / F.sum("__n")).alias("scope"))


def moves(df: DataFrame, entity: str, place: str, *order: str) -> DataFrame:
    """(origin, dest, moves): entities that are somewhere else than in their row before."""
    w = Window.partitionBy(entity).orderBy(*order)
    rows = df.withColumn("origin", F.lag(place).over(w)).filter(F.col("origin") != F.col(place))
    return rows.groupBy("origin", F.col(place).alias("dest")).agg(F.count(F.lit(1)).alias("moves"))
