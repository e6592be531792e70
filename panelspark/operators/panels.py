"""Aggregates and windows that panels are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.spread import lowest_so_far, prefix_sums
from panelspark.sources.staging import staged


def mode(df: DataFrame, by: list[str], value: str, *first: Column) -> DataFrame:
    """The most frequent value of each group; ties go by `first`, then to the smallest."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"__f{i}") for i, c in enumerate(first)])
    best = F.min_by(F.struct(value, "n"), F.struct(*[F.col(f"__f{i}") for i in range(len(first))], -F.col("n"), F.col(value)))
    return counted.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def keep_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def share_of_group(df: DataFrame, by: list[str], name: str = "share", weight: Column | None = None) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.lit(1.0) / F.count(F.lit(1)).over(w) if weight is None else F.try_divide(weight, F.sum(weight).over(w)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value count neither above nor below."""
    return F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight)))


def weighted_share(condition: Column, weight: Column) -> Column:
    """Unknown conditions stay in the denominator."""
    return F.try_divide(F.sum(F.when(condition, weight).otherwise(0.0)), F.sum(weight))


def herfindahl(df: DataFrame, unit: str, place: str, weight: str) -> DataFrame:
    """Concentration of each unit's weight over places; null places are left out of the total too."""
    by_place = df.filter(F.col(place).isNotNull()).groupBy(unit, place).agg(F.sum(weight).alias("__w"))
    total = F.sum("__w")
    return by_place.groupBy(unit).agg(F.try_divide(F.sum(F.col("__w") * F.col("__w")), total * total).alias("hhi"), F.count(F.lit(1)).alias("places"))


def gini(df: DataFrame, by: str, x: str, weight: str) -> DataFrame:
    """Weighted Gini coefficient of x within by: equal values are summed before the running totals, which run over as many tasks as
    a group fills."""
    tied = df.groupBy(by, x).agg(F.sum(weight).alias("__w")).withColumn("__xw", F.col(x) * F.col("__w"))
    rows = prefix_sums(tied, by, [F.col(x)], {"__below": "__xw"}, "gini").withColumn("__before", 2 * F.col("__below") + F.col("__xw"))
    return rows.groupBy(by).agg((1 - F.try_divide(F.sum(F.col("__w") * F.col("__before")), F.sum("__w") * F.sum("__xw"))).alias("gini"))


def ntile(df: DataFrame, by: str, order: list[str], parts: int, name: str) -> DataFrame:
    """Parts 1 to `parts` of each group in order, as equal as can be, larger ones first; a group may be any size."""
    rows = placed(df, by, order, "__r")
    small, large = F.floor(F.col("__n") / parts), F.floor(F.col("__n") / parts) + 1
    more = F.col("__n") % parts
    place = F.when(F.col("__r") < more * large, F.floor(F.col("__r") / large)).otherwise(more + F.floor((F.col("__r") - more * large) / F.nullif(small, F.lit(0))))
    return rows.withColumn(name, (place + 1).cast("int")).drop("__r", "__n")


def standardised(df: DataFrame, by: str, x: str, name: str) -> DataFrame:
    """x within by in standard deviations (ddof 1): one aggregation and a join of a row for each group."""
    means = df.groupBy(F.col(by).alias("__by")).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return df.join(means, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.try_divide(F.col(x) - F.col("__m"), F.col("__s"))).drop("__by", "__m", "__s")


def dissimilarity(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Half the summed differences of the shares of a and of b that each row has in its group."""
    totals = df.groupBy(F.col(by).alias("__by")).agg(F.sum(a).alias("__a"), F.sum(b).alias("__b"))
    share = lambda c, t: F.try_divide(F.col(c).cast("double"), F.col(t))
    rows = df.join(totals, F.col(by).eqNullSafe(F.col("__by")))
    return rows.groupBy(by).agg((0.5 * F.sum(F.abs(share(a, "__a") - share(b, "__b")))).alias("dissimilarity"))


def exposure_to_own(df: DataFrame, by: str, a: str, b: str, least: int = 2) -> DataFrame:
    """Own-group exposure without oneself, over the group's share: for a, for b, and for both by their sizes."""
    n = F.col(a) + F.col(b)
    rows = df.filter(n >= least)
    own = lambda x: F.try_divide(F.sum(F.col(x) * (F.col(x) - 1) / (n - 1)), F.sum(x))
    share = lambda x: F.try_divide(F.sum(x), F.sum(n))
    out = rows.groupBy(by).agg(own(a).alias("own_a"), own(b).alias("own_b"), share(a).alias("share_a"), share(b).alias("share_b"))
    return out.select(by, F.bround(F.col("own_a") / F.col("share_a"), 4).alias("ratio_a"), F.bround(F.col("own_b") / F.col("share_b"), 4).alias("ratio_b"),
                      F.bround((F.col("own_a") * F.col("share_a") + F.col("own_b") * F.col("share_b")) / (F.col("share_a") * F.col("share_a") + F.col("share_b") * F.col("share_b")), 4).alias("ratio"))


def years_before(unit: list[str], year: str, width: int) -> Window:
    """The width years before a row's own, by value: gaps count."""
    return Window.partitionBy(*unit).orderBy(year).rangeBetween(-width, -1)


def filled(df: DataFrame, unit: str, order: str, value: str, name: str) -> DataFrame:
    """The last value known so far, else the first that comes."""
    back = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(unit).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)))


def placed(df: DataFrame, by: str | None, order: list[str], name: str) -> DataFrame:
    """The place (0, 1, ...) of each row of its group in order, and __n, the size of the group; a group may be any size."""
    rows = df.withColumns({"__one": F.lit(1).cast("long"), "__by": F.col(by) if by else F.lit(0)})
    sizes = staged(rows.groupBy(F.col("__by").alias("__of")).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    rows = prefix_sums(rows, "__by", [F.col(c) for c in order], {name: "__one"}, "placed")
    return rows.join(sizes, F.col("__by").eqNullSafe(F.col("__of"))).drop("__one", "__by", "__of")


def percentile(df: DataFrame, by: str | None, order: list[str], name: str) -> DataFrame:
    """Place within by from 0 to 1, for an order without ties; a lone row has 0."""
    return placed(df, by, order, "__r").withColumn(name, F.coalesce(F.try_divide(F.col("__r").cast("double"), F.col("__n") - 1), F.lit(0.0))).drop("__r", "__n")


def q_values(df: DataFrame, p: str, *ties: str) -> DataFrame:
    """Benjamini-Hochberg q of each p over the whole table of tests, of any size."""
    rows = placed(df, None, [p, *ties], "__r").withColumns({"__q": F.col(p) * F.col("__n") / (F.col("__r") + 1), "__all": F.lit(0)})
    rows = lowest_so_far(rows, "__all", [-F.col("__r")], "__q", "__low", "q-values")
    return rows.withColumn("q", F.least(F.lit(1.0), F.col("__low"))).drop("__r", "__n", "__q", "__all", "__low")


def grain_violations(df: DataFrame, grain: list[str]) -> DataFrame:
    """Keys that a table with this grain must not have twice."""
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def column_profile(df: DataFrame, examples: int = 3) -> DataFrame:
    """(column, filled share, distinct values, numeric share, examples) of all columns: cells are counted by value once, map-side
    first, and the counts summed by column. Examples are the most frequent values, of equal ones the smaller."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    values = staged(cells.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), "profile")
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    out = values.groupBy("column").agg(
        (F.coalesce(F.sum(known), F.lit(0)) / F.sum("n")).alias("filled"), F.count("v").alias("distinct"), F.try_divide(F.coalesce(F.sum(F.when(F.col("v").try_cast("double").isNotNull(), F.col("n"))), F.lit(0)).cast("double"), F.sum(known)).alias("numeric"))
    some = values.filter("v is not null").withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))).filter(F.col("r") <= examples)
    some = some.groupBy(F.col("column").alias("__c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]), ", ").alias("examples"))
    return out.join(some, F.col("column") == F.col("__c"), "left").drop("__c")


def merge_panels(first: DataFrame, others: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """All rows of all panels by key (full joins, one coalesced key); the columns of the others get their name as prefix, so that
    none clashes."""
    out = first
    for name, panel in others.items():
        out = out.join(panel.select(*key, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in panel.columns if c not in key]), key, "full")
    return out


def coverage(df: DataFrame, wanted: Column, year: str, measures: dict[str, str]) -> DataFrame:
    """(source, first, last, matched, total, share): of the wanted rows in the years from the first to the last in which any row has
    the source's measure, those that have it. Two aggregations whatever the number of sources; a source without any has no row."""
    spans = df.agg(*[f(F.when(F.col(c).isNotNull(), F.col(year))).alias(f"{k}{i}") for i, c in enumerate(measures.values()) for k, f in (("a", F.min), ("b", F.max))])  # one row
    rows = df.filter(wanted).join(F.broadcast(spans), F.lit(True))
    each = [F.struct(F.lit(label).alias("source"), F.col(f"a{i}").alias("first"), F.col(f"b{i}").alias("last"), F.col(c).isNotNull().alias("has")) for i, (label, c) in enumerate(measures.items())]
    rows = rows.select(year, F.explode(F.array(*each)).alias("m")).select(year, "m.*").filter(F.col(year).between(F.col("first"), F.col("last")))
    n = F.count(F.lit(1))
    return rows.groupBy("source", "first", "last").agg(F.count_if("has").alias("matched"), n.alias("total"), (F.count_if("has") / n).alias("share"))


def match_rate(df: DataFrame, matched: Column, step: str, unit: str) -> DataFrame:
    n = F.count(F.lit(1))
    hit = F.coalesce(F.sum(F.coalesce(matched, F.lit(False)).cast("long")), F.lit(0))
    return df.agg(hit.alias("matched"), n.alias("total"), F.try_divide(hit.cast("double"), n).alias("share")).select(F.lit(step).alias("step"), F.lit(unit).alias("unit"), "matched", "total", "share")
