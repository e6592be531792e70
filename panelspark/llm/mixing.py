"""Mixing sources to target weights: hash-random order, range sort, distributed prefix sums, exact cuts.

Sizes are words `[^\\x20\\x09-\\x0D]+`. Sources in code-point order, null last, take the weights in turn. The mix is as large
as all sources together; a source's target is its weight's share, but at most `max_epochs` times its size, and what a capped
source can't take goes to the others by weight until none is above its cap. A source gives whole epochs of all its
documents, then of one more epoch the documents before the cut: they are in the order of a hash of their id, their prefix
sums are exact, and the document at the cut gives the words that are still missing (target and total agree to a word).

The order is laid by a range sort over (source, hash), so a source with a third of all rows is spread over as many tasks as
it fills; only a row per task and source is accumulated (spread.prefix_sums). Targets come from a table of sources: water
filling is a closed form over caps in order, by the same prefix sums, so that sources may be many.

Defined results: a null text has size 0 and is never taken; a null source is a source; repeated rows are documents of their
own (which of two equal rows comes first doesn't show), rows that only share an id are told apart by all their columns; a
null id sorts as ''; very long texts are documents like others; an empty table, or one without words, takes nothing; extra
columns stay whatever their names. Reruns agree: nothing depends on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize, numbered, row_key
from panelspark.operators.spread import BROADCAST_ROWS, prefix_sums, sized_join

WEIGHTS, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 3, "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from a written table (source, source_size) with a row per source."""
    rows = prefix_sums(sizes.withColumns({"__all": F.lit(0), "__one": F.lit(1).cast("long")}), "__all", [F.col("source").isNull(), F.col("source")], {"turn": "__one"}, "mix-turns")
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("level", F.col("cap") / F.col("weight"))
    rows = prefix_sums(rows, "__all", [F.col("level"), F.col("source").isNull(), F.col("source")], {"caps": "cap", "weights": "weight"}, "mix-levels")
    rows = materialize(rows, "mix-caps")
    total = rows.agg(F.sum("source_size").alias("__size"), F.sum("weight").alias("__weight"))  # one row
    # the level at which weights fill what the sources before this one, all at their caps, leave
    fill = F.try_divide(F.col("__size") - F.col("caps"), F.col("__weight") - F.col("weights"))
    fills = rows.join(F.broadcast(total), F.lit(True)).withColumn("fill", fill).filter(F.col("fill") <= F.col("level"))
    water = fills.agg(F.min_by("fill", F.struct("level", F.col("source").isNull().alias("last"), "source")).alias("water"))  # one row
    return rows.join(F.broadcast(water), F.lit(True)).select("source", "source_size", F.least(F.col("cap"), F.col("water") * F.col("weight")).alias("target"))


def _laid(documents: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], max_epochs: int, seed: str) -> DataFrame:
    slim = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), row_key(documents).alias("rid"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # the texts are read once; the sort samples and moves these narrow rows
    slim = materialize(slim.withColumn("__key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long")), "mix-sizes")
    laid = prefix_sums(slim, "source", [F.col("__key"), F.col("doc_id"), F.col("size"), F.col("rid")], {"before": "size"}, "mix")
    sizes = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    named = lambda df: df.withColumns({"__none": F.col("source").isNull(), "__source": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    goals = materialize(named(targets(sizes, weights=weights, max_epochs=max_epochs)).drop("source"), "mix-targets")
    rows = sized_join(named(laid), goals, ["__none", "__source"], ["rid"])
    whole = F.floor(F.coalesce(F.try_divide(F.floor("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    left = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    return rows.select("rid", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row per document; taken counts words with repeats."""
    return _laid(documents, doc_id, text, source, weights, max_epochs, seed).drop("rid")


def mixed_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
                    max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """documents, each row as often as the mix takes it; the document at a source's cut comes whole. All columns stay.

    Copies go back to rows by id and row key; of rows equal in all columns one stands for all, with the copies of all.
    """
    columns = documents.columns
    documents, (doc_id, text, source) = numbered(documents, doc_id, text, source)
    laid = _laid(documents, doc_id, text, source, weights, max_epochs, seed)
    copies = F.coalesce(F.ceil(F.try_divide(F.col("taken").cast("double"), F.col("size"))), F.lit(0)).cast("long")
    each = laid.groupBy(F.col("doc_id").alias("__id"), F.col("rid").alias("__rid")).agg(F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__n")).filter("__copies > 0")
    each = materialize(each, "mix-copies")
    same = F.col("__id").eqNullSafe(F.col(doc_id)) & (F.col("__rid") == F.col("__key"))
    rows = documents.withColumn("__key", row_key(documents))
    single = each.filter("__n = 1").drop("__n")
    out = rows.join(F.broadcast(single) if each.count() <= BROADCAST_ROWS else single, same)
    repeated = each.filter("__n > 1")
    if not repeated.isEmpty():
        once = rows.join(repeated, same, "left_semi").dropDuplicates([doc_id, "__key"])
        out = out.unionByName(once.join(repeated.drop("__n"), same))
    return out.select(*documents.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy").toDF(*columns)
