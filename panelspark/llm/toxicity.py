"""Toxicity scores from confirmed toxic texts and unlabelled text: non-negative positive-unlabelled learning.

Features of a text: which words it has, and which 4- and 5-byte beginnings of words (lower-cased `[0-9a-z]` and non-ASCII),
as 64-bit hashes; each counts once a text, whatever its length.

Training:
 1. Of the labelled documents in training folds, at most `positives` toxic ones and `unlabelled` of all, drawn by hash (the
    labels of these are not looked at; they hold positives at the rate of the labelled rows). Both bounds are parameters;
    each id gives one text, equal texts count once. The class prior is the toxic share of the labelled rows in training folds.
 2. Features are screened in Spark: those in `min_df` or more positives that are clearly more frequent there than in
    unlabelled text, at most `max_features` by z-score.
 3. Document frequencies of the screened features are counted over all documents; features that the whole corpus shows
    to be common after all are dropped, the rest are scaled by inverse document frequency.
 4. A linear model is fitted with numpy to the non-negative risk estimator with logistic loss,
    `prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`, by Adam on the full sample. The driver holds the screened features
    of the sample alone, a bit each (positives + unlabelled texts of max_features bits, 6 MB).
Scoring goes over all texts in numpy slices against the broadcast weights (at most max_features numbers).

Defined results: a null text has no features; very long texts are read whole, in slices; a column that has the name of the
score is replaced, other columns stay; null or repeated ids keep their rows; an id with several labels is toxic if one
says so; rows of `labels` without a text don't matter; without any positive in training folds every score is the prior;
features that tie in z go by their hash; an empty table gives no scores.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.llm.common import ALNUM, LOWER, HashSet, Rolling, bound_batches, materialize, numbered, text_slices, word_spans

#: Most rows of the fitted sample.
POSITIVES, UNLABELLED = 4000, 8000
MAX_FEATURES, MIN_DF = 4096, 3
PREFIXES = (4, 5)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of the id as text is 0 modulo folds (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and word beginning; a row may repeat a hash."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    rolled = Rolling(data)
    hashes, owners = [rolled.of(starts, ends)], [rows]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(rolled.of(starts[long], starts[long] + n) ^ np.uint64(0xA5A5A5A5 * n))
        owners.append(rows[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, positive, feature), a row for each distinct feature of a text."""
    for batch in batches:
        keys, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, data, off in text_slices(batch, "text"):
            hashes, owners = _features(data, off)
            pairs = np.unique(np.stack([owners.astype(np.uint64), hashes], axis=1), axis=0)
            who = pairs[:, 0].astype(np.int64) + row
            yield pa.RecordBatch.from_arrays([pa.array(keys[who]), pa.array(flags[who]), pa.array(pairs[:, 1].view(np.int64) if len(pairs) else np.zeros(0, np.int64))], names=["row", "positive", "feature"])


def _hits(data: np.ndarray, off: np.ndarray, wanted: HashSet) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of a wanted feature), each pair once."""
    hashes, owners = _features(data, off)
    found, place = wanted.find(hashes)
    pairs = np.unique(owners[found] * len(wanted.sorted) + place)
    return (pairs // len(wanted.sorted), pairs % len(wanted.sorted)) if len(wanted.sorted) else (pairs, pairs)


def _frequencies(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    wanted = HashSet(table.value)
    counts, n = np.zeros(len(wanted.sorted), np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, data, off in text_slices(batch, "text"):
            counts += np.bincount(_hits(data, off, wanted)[1], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], n])], names=["place", "df"])


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, scale: np.ndarray, prior: float, *, steps: int = 800, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model; (rows, cols) are the features that each text has, scale their size."""
    n, d = len(positive), len(scale)
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    p, u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols] * scale[cols], n) + b
        s = sigmoid(z)
        negative = float(u @ np.logaddexp(0, z) - prior * (p @ np.logaddexp(0, z)))
        slope = prior * p * (s - 1)  # of the positive part
        rest = u * s - prior * p * s
        slope = slope + rest if negative >= 0 else -rest  # below zero: step back from fitting unlabelled text
        g = np.bincount(cols, slope[rows] * scale[cols], d) + decay * w
        gb = float(slope.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        w = np.maximum(w, 0)  # the features are signs of the positive class
        b -= rate * fix * mb / (vb**0.5 + 1e-9)
    return w, b


class Model:
    def __init__(self, wanted: np.ndarray, weights: np.ndarray, bias: float):
        self.set, self.weights, self.bias = HashSet(wanted), weights, bias

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, cols = _hits(data, off, self.set)
        z = np.bincount(rows.astype(np.int64), self.weights[cols], len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES,
          unlabelled: int = UNLABELLED, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> Model:
    spark = documents.sparkSession
    bound_batches(spark)
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("y")).filter(~held_out(F.col("__id")) & F.col("__id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    n, n_pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_pos / max(n, 1), 1e-3), 0.5)
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    texts = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    drawn = lambda rows, n: rows.orderBy(F.xxhash64("__id"), "__id").limit(n).select("__id")
    chosen = drawn(known.filter("y = 1"), positives).withColumn("positive", F.lit(True)).unionByName(drawn(known, unlabelled).withColumn("positive", F.lit(False)))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("__id"))  # at most positives + unlabelled ids
    found = found.groupBy("id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(found.groupBy(F.xxhash64("text", "positive").alias("row"), "positive").agg(F.first("text").alias("text")), "toxicity-sample")  # equal texts count once
    sizes = dict(sample.groupBy("positive").count().collect())
    np_, nu = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
    each = sample.mapInArrow(_text_features, "row long, positive boolean, feature long")
    found = each.groupBy("feature").agg(F.sum(F.col("positive").cast("long")).alias("a"), F.sum((~F.col("positive")).cast("long")).alias("b")).filter(F.col("a") >= min_df)
    rate, other = F.col("a") / np_, F.col("b") / nu
    both = (F.col("a") + F.col("b") + 1) / (np_ + nu)
    found = found.withColumn("z", (rate - other) / F.sqrt(both * (1 / np_ + 1 / nu))).filter((rate > 2 * other) & (F.col("z") > 3))
    screened = np.array([r[0] for r in found.orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()], np.int64)
    wanted = HashSet(screened.view(np.uint64))
    table = spark.sparkContext.broadcast(wanted.sorted)  # plain values: a broadcast is read where this package may not be
    counted = texts.select("text").mapInArrow(lambda it: _frequencies(it, table), "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    df, total = np.zeros(len(wanted.sorted)), 1
    for place, count in counted.collect():  # at most max_features + 1 rows
        if place < 0:
            total = max(1, count)
        else:
            df[place] = count

    def kept_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = HashSet(table.value)
        for batch in batches:
            for row, end, data, off in text_slices(batch, "text"):
                bits = np.zeros((end - row, len(sought.sorted)), bool)
                bits[_hits(data, off, sought)] = True
                packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), pa.array(packed, pa.binary())], names=["positive", "bits"])

    held = sample.select("row", "positive", "text").mapInArrow(kept_bits, "positive boolean, bits binary").toArrow()
    positive = held.column("positive").to_numpy()
    packed = np.frombuffer(b"".join(held.column("bits").to_pylist()), np.uint8).reshape(len(positive), (len(df) + 7) // 8)
    spot, place = np.nonzero(np.unpackbits(packed, axis=1, count=len(df)))
    own = np.bincount(place[positive[spot]], minlength=len(df)) / np_
    rare = own > 2 * df / total  # what all documents show
    scale = np.where(rare, np.log((1 + total) / (1 + df)), 0) / np.log(1 + total)
    w, b = fit_nnpu(spot, place, positive, scale, prior)
    return Model(wanted.sorted, w * scale, b)


def _score(batches: Iterator[pa.RecordBatch], table, column: str, name: str) -> Iterator[pa.RecordBatch]:
    model = Model(*table.value)
    for batch in batches:
        scores = [model.score(data, off) for _, _, data, off in text_slices(batch, column)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, name])


def score(documents: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """documents with the score of each text; a column of that name is replaced."""
    bound_batches(documents.sparkSession)
    table = documents.sparkSession.sparkContext.broadcast((model.set.sorted, model.weights, model.bias))
    rows = documents.drop(name)
    columns = rows.columns
    rows, (text,) = numbered(rows, text)
    return rows.mapInArrow(lambda it: _score(it, table, text, "score"), StructType([*rows.schema.fields, StructField("score", DoubleType())])).toDF(*columns, name)
