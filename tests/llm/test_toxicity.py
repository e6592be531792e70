import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import toxicity
from panelspark.llm.queries import op6_toxicity
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.1"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for v in np.unique(scores):
        where = np.flatnonzero(np.asarray(scores)[order] == v)
        ranks[order[where]] = where.mean() + 1
    pos = np.asarray(truth, bool)
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy_of_the_query(spark):
    got = op6_toxicity(spark, SF)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert auc([s for s, _ in test], [y for _, y in test]) > 0.8
    flagged = [y for s, y in test if s >= 0.5]
    assert len(flagged) > 50 and sum(flagged) / len(flagged) > 0.9


def corpus(n=600):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "bcdfghklm" for b in ("ala", "eno", "iro", "usu", "ota", "ine")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 80))
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilestone", "grumblewort", "nastybrick"])
        rows.append((i, " ".join(words), "en", "s", 0))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_planted_words_are_found_and_odd_rows_kept(spark, odd_documents):
    rows, labels = corpus()
    odd = [(10_000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd_documents]
    docs = spark.createDataFrame(rows + odd, DOC_SCHEMA).withColumns({"y": F.lit("clash"), "toxic": F.lit(9)})
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (99_999, 1, 1), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(scored) == len(rows) + len(odd)
    for r in scored:
        if r.doc_id is not None and r.doc_id < 600:
            assert (r.score >= 0.5) == (r.doc_id % 6 == 0)
        else:
            assert r.score < 0.5


def brute_scores(rows, labels, min_df=toxicity.MIN_DF, steps=800):
    """Scores of all texts by dictionaries and loops: features, screening, frequencies and the non-negative risk, in plain Python."""
    import math
    import re

    def features(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return {("w", w) for w in words} | {(n, w.encode()[:n]) for w in words for n in toxicity.PREFIXES if len(w.encode()) > n}

    known = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5}
    prior = sum(known.values()) / len(known)
    texts = {r[0]: r[1] for r in rows}
    sample = sorted({(texts[i], True) for i, y in known.items() if y} | {(texts[i], False) for i in known})
    sets = [(features(t), positive) for t, positive in sample]
    n_pos, n_un = sum(p for _, p in sets), sum(not p for _, p in sets)
    screened = []
    for f in set().union(*[s for s, _ in sets]):
        a, b = sum(f in s for s, p in sets if p), sum(f in s for s, p in sets if not p)
        both = (a + b + 1) / (n_pos + n_un)
        if a >= min_df and a / n_pos > 2 * b / n_un and (a / n_pos - b / n_un) / math.sqrt(both * (1 / n_pos + 1 / n_un)) > 3:
            screened.append(f)
    every = [features(r[1]) for r in rows]
    scale = {}
    for f in screened:
        df = sum(f in s for s in every)
        own = sum(f in s for s, p in sets if p) / n_pos
        scale[f] = math.log((1 + len(rows)) / (1 + df)) / math.log(1 + len(rows)) if own > 2 * df / len(rows) else 0.0
    w, bias = dict.fromkeys(screened, 0.0), math.log(prior / (1 - prior))
    m = {f: [0.0, 0.0] for f in [*screened, None]}
    has = [[f for f in screened if f in s] for s, _ in sets]
    for t in range(1, steps + 1):
        z = [sum(w[f] * scale[f] for f in h) + bias for h in has]
        s = [1 / (1 + math.exp(-x)) for x in z]
        loss = [math.log1p(math.exp(-abs(x))) + max(x, 0) for x in z]
        negative = sum(x / n_un for x, (_, p) in zip(loss, sets) if not p) - prior * sum(x / n_pos for x, (_, p) in zip(loss, sets) if p)
        slope = []
        for x, (_, p) in zip(s, sets):
            rest = -prior * x / n_pos if p else x / n_un
            slope.append((prior * (x - 1) / n_pos if p else 0.0) + rest if negative >= 0 else -rest)
        g = {f: 2e-5 * w[f] for f in screened}
        for h, x in zip(has, slope):
            for f in h:
                g[f] += x * scale[f]
        g[None] = sum(slope)
        fix = (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        for f, x in g.items():
            m[f] = [0.9 * m[f][0] + 0.1 * x, 0.999 * m[f][1] + 0.001 * x * x]
            step = 0.05 * fix * m[f][0] / (math.sqrt(m[f][1]) + 1e-9)
            if f is None:
                bias -= step
            else:
                w[f] = max(0.0, w[f] - step)
    return [1 / (1 + math.exp(-(sum(w[f] * scale[f] for f in screened if f in s) + bias))) for s in every]


def test_scores_equal_plain_loops(spark):
    rows, labels = corpus(240)
    rows = [*rows, (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "Vilestone VILEST épée", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = brute_scores(rows, labels)
    assert len(model.weights) >= 5 and np.allclose([got[r[0]] for r in rows], want, atol=1e-6)
    assert max(want) > 0.5 > min(want)


def test_a_column_of_the_scores_name_is_replaced_and_others_stay(spark):
    docs = spark.createDataFrame(corpus(40)[0], DOC_SCHEMA).withColumns({"score": F.lit("old"), "__score": F.array(F.struct(F.lit(1).alias("a b")))})
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")))
    assert got.columns == [*docs.drop("score").columns, "score"] and dict(got.dtypes)["score"] == "double" and got.count() == 40


def test_the_sample_is_bounded_and_drawn_alike(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + rows[:50], DOC_SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(d, lab, positives=20, unlabelled=90) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.set.sorted, b.set.sorted) and np.allclose(a.weights, b.weights) and len(a.weights)


def test_without_positives_or_rows(spark):
    docs = spark.createDataFrame(corpus(30)[0], DOC_SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_risk_never_goes_below_zero_for_long():
    rng = np.random.default_rng(0)
    n, d = 400, 30
    positive = np.arange(n) < 100
    rows = np.repeat(np.arange(n), 3)
    cols = rng.integers(0, d, 3 * n)
    cols[np.repeat(positive, 3)] %= 5
    w, b = toxicity.fit_nnpu(rows, cols, positive, np.ones(d), 0.2)
    assert np.all(w >= 0) and np.isfinite(b) and w[:5].min() > w[5:].mean()
