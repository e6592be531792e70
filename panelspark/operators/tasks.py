"""Matching documents to tasks through word pairs: only what is new, exposure, incidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.spread import sized_join
from panelspark.sources.staging import staged

# Words too common to carry a task.
STOP = ["the", "a", "an", "of", "to", "and", "or", "in", "on", "for", "with", "by", "at", "from", "as", "is", "are", "be", "it", "this", "that"]


def unseen(documents: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Documents that an earlier run has not stored; only ids of the stored ones are read."""
    return documents.join(stored.select(key).distinct(), key, "left_anti")


def stored_pairs(pairs: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """What a run stores of documents: their pairs, and a row of nulls for each without any, so that it isn't parsed again."""
    none = documents.select(key).distinct().join(pairs.select(key).distinct(), key, "left_anti")
    return pairs.select(key, "first", "second").unionByName(none.select(key, F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second")))


def _words(text: str, stop: list[str]) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: (w != "") & ~w.isin(stop))


def pair_array(text: str, stop: list[str] = STOP) -> Column:
    """Distinct pairs of adjacent words, neither of them a stop word, each as `first second`."""
    # as strings, since distinct values of an array of strings are found by hash, those of structs by comparing all
    w = _words(text, stop)
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.element_at(F.transform(F.array(w), pairs), 1)  # words are found once


def word_pairs(df: DataFrame, key: list[str], text: str, stop: list[str] = STOP) -> DataFrame:
    """Distinct (first, second) of adjacent words, neither of them a stop word."""
    each = df.select(*key, F.explode(pair_array(text, stop)).alias("p"))
    return each.select(*key, F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("second"))


def pair_document_shares(documents: DataFrame, wanted: DataFrame, text: str, stop: list[str] = STOP) -> DataFrame:
    """(first, second, share): documents with a pair over documents with any pair, for the pairs wanted (first, second). One pass
    over the texts: each document with pairs gives one empty pair as well, which counts it."""
    sought = wanted.select(F.concat_ws(" ", "first", "second").alias("p")).distinct()
    sought = staged(sought.unionByName(sought.limit(1).select(F.lit("").alias("p"))), "wanted-pairs")
    each = documents.select(pair_array(text, stop).alias("a")).filter(F.size("a") > 0).select(F.explode(F.array_append("a", F.lit(""))).alias("p"))
    counts = staged(sized_join(each, sought, ["p"], how="left_semi").groupBy("p").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    total = counts.filter("p = ''").select(F.col("n").cast("double").alias("total"))  # at most one row
    return counts.filter("p <> ''").join(F.broadcast(total), F.lit(True)).select(F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("second"), (F.col("n") / F.col("total")).alias("share"))


def with_pairs(df: DataFrame, text: str, stop: list[str] = STOP) -> DataFrame:
    """The rows that have any pair."""
    return df.filter(F.size(_words(text, stop)) > 1)


def extracted_pairs(df: DataFrame, key: str, text: str, extract: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """Pairs that a parser of the caller's finds in each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, v, o) for k, x in zip(b[key], b[text]) for v, o in dict.fromkeys(extract(x or ""))]
            yield pd.DataFrame(rows, columns=[key, "first", "second"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, first string, second string")


def pair_shares(pairs: DataFrame, key: str, period: str) -> DataFrame:
    """Documents with a pair over documents with any, by period and for all periods; documents outside periods are in `all` only."""
    level = F.when(F.grouping(period) == 1, "all").otherwise(F.col(period)).alias("__p")
    n = lambda name: F.count_distinct(key).alias(name)
    each = [F.col(c) for c in (period, "first", "second")]
    counted = pairs.groupingSets([each, each[1:]], *each).agg(level, n("n")).filter("__p is not null").select(F.col("__p").alias(period), "first", "second", "n")
    docs = pairs.groupingSets([[F.col(period)], []], F.col(period)).agg(level, n("docs")).filter("__p is not null").select(F.col("__p").alias(period), "docs")
    return counted.join(docs, period).withColumn("share", F.col("n") / F.col("docs"))


def incidence(doc_pairs: DataFrame, unit_pairs: DataFrame, doc: str, unit: str, weight: str, most_units: int) -> DataFrame:
    """Documents by units through pairs that at most most_units units have; the shares of a document add up to 1."""
    unit_pairs = staged(unit_pairs.select("first", "second", unit, "task", weight), "unit-pairs")
    specific = unit_pairs.groupBy("first", "second").agg(F.count_distinct(unit).alias("n")).filter(F.col("n") <= most_units).select("first", "second")
    # the pairs of documents meet a table of counted size, so that those that no unit has go where they arise
    wanted = staged(unit_pairs.join(specific, ["first", "second"], "left_semi"), "specific-pairs")
    touch = sized_join(doc_pairs, wanted, ["first", "second"]).select(doc, unit, "task", weight).distinct()
    summed = touch.groupBy(doc, unit).agg(F.sum(weight).alias("__w"))
    total = summed.groupBy(doc).agg(F.sum("__w").alias("__t"))
    return summed.join(total, doc).select(doc, unit, F.try_divide(F.col("__w"), F.col("__t")).alias("share"))
