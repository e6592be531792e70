"""Joins that Spark has no single operator for, as plans of built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.spread import last_known


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """left with values of the latest right row at or before its time within by; of several at one time the largest values.

    Both sides are put together, sorted, and a running last value is taken over as many tasks as a key fills
    (spread.last_known), so a skewed key costs a sort in pieces, not a product. A null key matches nothing.
    """
    payload = F.struct(*values)
    rows = left.withColumns({"__value": F.lit(None).cast(right.select(payload.alias("v")).schema["v"].dataType), "__right": F.lit(0)})
    marks = right.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*by, time]])).select(*by, time, payload.alias("__value"), F.lit(1).alias("__right"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # a left row without a time comes first, where nothing is known
    known = last_known(both, by, [F.col(time), -F.col("__right"), F.col("__value")], "__value", "__last", "asof")
    found = F.when(F.col(time).isNotNull(), F.col("__last"))
    return known.filter("__right = 0").select(*left.columns, *[found[v].alias(v) for v in values])


def years_between(df: DataFrame, start: Column, end: Column, last: int, name: str = "year") -> DataFrame:
    """A row for each year that a link is valid; an open end is `last`."""
    until = F.least(F.coalesce(end, F.lit(last)), F.lit(last))
    return df.filter(start <= until).withColumn(name, F.explode(F.sequence(start, until)))


def lookup_two_levels(df: DataFrame, exact: DataFrame, general: DataFrame, keys: list[str], loose: list[str], value: str) -> DataFrame:
    """The value that all keys give, else the one that the loose keys give."""
    a, b = exact.withColumnRenamed(value, "__exact"), general.withColumnRenamed(value, "__any")
    return df.join(a, keys, "left").join(b, loose, "left").withColumn(value, F.coalesce("__exact", "__any")).drop("__exact", "__any")


def skeleton(units: DataFrame, first: int, last: int, name: str = "year") -> DataFrame:
    """Every unit in every year."""
    return units.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))


def wildcard(df: DataFrame, patterns: DataFrame, code: str, pattern: str, any_char: str = "X", min_fixed: int = 2) -> DataFrame:
    """df with the most specific pattern that fits its code (of equal ones the smallest), null if none.

    A pattern fits if it differs from the code only where it has `any_char`. Distinct codes and patterns meet on their first
    min_fixed characters, which patterns must have fixed, so this is an equi-join.
    """
    rules = patterns.select(F.col(pattern).alias("__p")).distinct()
    distinct = df.select(F.col(code).alias("__c")).distinct()
    head = lambda c: F.substring(c, 1, min_fixed)
    free = F.regexp_replace(F.regexp_replace("__p", r"([.^$*+?()\[\]{}|\\#-])", r"\\$1"), any_char, ".")
    pairs = distinct.join(rules, head(F.col("__c")) == head(F.col("__p"))).filter(F.regexp_like("__c", F.concat(F.lit("^"), free, F.lit("$"))))
    best = pairs.groupBy("__c").agg(F.min_by("__p", F.struct(F.length(F.regexp_replace("__p", f"[^{any_char}]", "")), F.col("__p"))).alias(pattern))
    return df.join(best, F.col(code) == F.col("__c"), "left").drop("__c")


#: Broad occupations whose detailed codes run past nine, by the first five digits of those: physicians. A fixed value.
SPILL = {"29122": "291210"}


def covering_code(df: DataFrame, patterns: DataFrame, code: str, pattern: str, *, spill: dict[str, str] = SPILL) -> DataFrame:
    """df with the most specific six-character pattern that covers its code (of equal ones the smallest), null if none.

    Codes are read by their digits (`15-1252`), six of them. A pattern has two digits first; its other places are digits or
    letters that stand for any digit (`1191XX`, `4750YY`, `13102X`), and trailing zeros stand for any digit too (`112030`);
    it fixes as many digits as are left, six if it is the code itself. A code that nothing covers is looked up once more as
    the broad code that `spill` gives for its first five digits.

    Equi-join: each distinct code meets the patterns under the sixteen ways to leave its last four places open.
    """
    body = lambda c: F.rpad(F.regexp_replace(c, "0+$", ""), 6, "_")
    rules = patterns.select(F.col(pattern).cast("string").alias("__raw")).distinct().withColumn("__p", F.upper(F.trim("__raw"))).filter(F.col("__p").rlike("^[0-9]{2}.{4}$"))
    rules = rules.withColumn("__key", F.regexp_replace(body(F.col("__p")), "[^0-9]", "_"))
    rules = rules.withColumn("__fixed", F.length(F.regexp_replace("__key", "_", "")))
    wider = F.create_map(*[F.lit(v) for kv in spill.items() for v in kv]) if spill else F.lit(None).cast("map<string,string>")
    distinct = df.select(F.col(code).alias("__c")).distinct().withColumn("__d", F.regexp_replace(F.col("__c").cast("string"), "[^0-9]", "")).filter(F.length("__d") == 6)

    def found(targets: DataFrame) -> DataFrame:
        kept = lambda mask: F.concat(F.substring("__d", 1, 2), *[F.substring("__d", i + 3, 1) if mask >> i & 1 else F.lit("_") for i in range(4)])
        keys = targets.withColumn("__key", F.explode(F.array_distinct(F.array(*[kept(m) for m in range(16)]))))
        # a pattern whose trailing zeros are open is the code itself where the codes are equal
        best = F.struct((-F.when(F.col("__p") == F.col("__d"), 6).otherwise(F.col("__fixed"))).alias("n"), F.col("__raw").alias("p"))
        return keys.join(rules, "__key").groupBy("__c").agg(F.min(best)["p"].alias(pattern))

    first = found(distinct)
    rest = distinct.join(first, "__c", "left_anti").withColumn("__d", F.try_element_at(wider, F.substring("__d", 1, 5))).filter(F.col("__d").isNotNull())
    return df.join(first.unionByName(found(rest)), F.col(code) == F.col("__c"), "left").drop("__c")


def profiles(keys: DataFrame, table: DataFrame, key: str, code: str, weight: str, count: str, values: list[str]) -> DataFrame:
    """(key, codes, weight, count, values, coarse) for each distinct four-digit key that the table has anything for: the rows whose
    code begins with the key, their values averaged by weight (rows without a value left out of its average); where there
    are none, the rows of the longest coarser code (three or two digits, `33MS`) that the key begins with, coarse being true."""
    digits = F.regexp_extract(code, r"^(\d+)", 1)
    used = table.select("*", digits.alias("__d")).filter(F.length("__d") >= 2)
    sums = [F.sum(weight).cast("double").alias(weight), F.sum(count).cast("long").alias(count), F.array_join(F.array_sort(F.collect_list(code)), ";").alias("codes")]
    for v in values:
        w = F.when(F.col(v).isNotNull(), F.col(weight))
        sums.append(F.try_divide(F.sum(F.col(v) * w), F.sum(w)).alias(v))
    level = F.when(F.length("__d") >= 4, F.substring("__d", 1, 4)).otherwise(F.col("__d"))
    known = used.groupBy(level.alias("__key")).agg(*sums)
    wanted = keys.select(F.col(key).cast("string").alias("__k")).dropna().distinct()
    each = wanted.select("__k", F.explode(F.array(*[F.substring("__k", 1, n) for n in (4, 3, 2)])).alias("__key")).distinct().filter((F.length("__key") < 4) | (F.col("__key") == F.col("__k")))
    hit = each.join(known, "__key")
    best = hit.groupBy("__k").agg(F.max(F.length("__key")).alias("__n"))
    out = hit.join(best.withColumnRenamed("__k", "__b"), (F.col("__k") == F.col("__b")) & (F.length("__key") == F.col("__n")))
    return out.select(F.col("__k").alias(key), "codes", weight, count, *values, (F.col("__n") < 4).alias("coarse"))


def longest_prefix(df: DataFrame, table: DataFrame, code: str, key: str, lengths: list[int], value: str) -> DataFrame:
    """The value of the longest prefix of code that the table has, with the length that matched."""
    keys = df.select(F.col(code).alias("__c")).distinct().withColumn("__n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    hit = keys.withColumn("__k", F.expr("substring(__c, 1, __n)")).join(table.select(F.col(key).alias("__k"), F.col(value).alias("__v")), "__k")
    best = hit.groupBy("__c").agg(F.max_by("__v", "__n").alias(value), F.max("__n").alias("matched"))
    return df.join(best, F.col(code) == F.col("__c"), "left").drop("__c")
