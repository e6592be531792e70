"""The license scan against plain loops over words, votes and places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import licenses
from panelspark.llm.licenses import ANCHORS, PHRASES, SHARE, SLACK, TEMPLATES, words_of
from panelspark.llm.queries import op11_licenses

SF = "/root/testdata/sf0.001"


def consecutive(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def brute(texts, templates=TEMPLATES):
    words = [words_of(t or "") for t in texts]
    vocabulary = {w for t in templates for x in (t.text, *t.must) for w in words_of(x)} | {w for p in PHRASES for w in words_of(p)}
    docs = dict.fromkeys(vocabulary, 0)
    for ws in words:
        for w in set(ws) & vocabulary:
            docs[w] += 1
    idf = {w: math.log(1 + (len(texts) + 1) / (n + 1)) for w, n in docs.items()}
    out = []
    for ws in words:
        base = sorted((i, label) for p, label in PHRASES.items() for i in consecutive(ws, words_of(p)))
        score, labels = 0.0, {label for _, label in base}
        for t in templates:
            tw = words_of(t.text)
            total = sum(idf[w] for w in tw)
            anchors = sorted(set(tw) & set(ws), key=lambda w: (-idf[w], w))[:ANCHORS]
            if sum(idf[w] for w in tw if w in set(ws)) / total < SHARE - 1e-9:
                continue
            votes = sorted((i - j, w) for i, w in enumerate(ws) if w in anchors for j, x in enumerate(tw) if x == w)
            runs = []
            for v in votes:
                if runs and v[0] - runs[-1][-1][0] <= SLACK:
                    runs[-1].append(v)
                else:
                    runs.append([v])
            for run in runs:
                if 2 * len({w for _, w in run}) < len(anchors):
                    continue
                lo, hi = run[0][0], run[-1][0]
                share = sum(idf[x] for j, x in enumerate(tw) if x in ws[max(0, lo + j - SLACK) : max(0, hi + j + SLACK + 1)]) / total
                inside = ws[max(0, lo - SLACK) : hi + len(tw) + SLACK]
                score = max(score, share)
                if share >= SHARE and all(consecutive(inside, words_of(p)) for p in t.must):
                    labels.add(t.label)
        places = [i for i, _ in base]
        out.append((len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    return out


def rows_of(df):
    return sorted(((r[0], *r[1:7], round(r[7], 9)) for r in df.collect()), key=str)


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(op11_licenses(spark, SF)) == sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]))), key=str)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    prose = lambda k: " ".join(rng.choices("the of software and value data is in model a line use any public code to red".split(), k=k))
    whole = [t for t in TEMPLATES if len(words_of(t.text)) > 25]
    found, not_found = [], []
    for t in whole:
        ws = t.text.split()
        found.append((t.label, f"{prose(200)}\n{t.text.upper()}\n{prose(50)}"))
        needed = {w for p in t.must for w in words_of(p)}
        found.append((t.label, " ".join(w for i, w in enumerate(ws) if i % 9 or needed & set(words_of(w)))))
        found.append((t.label, prose(30) + "\n * " + "\n * ".join(" ".join(ws[i : i + 7]) for i in range(0, len(ws), 7))))
        if any(t.label == x.label for x in TEMPLATES if x not in whole):
            continue  # its short notice may be in a part
        mixed = ws[:]
        rng.shuffle(mixed)
        not_found.append((t.label, " ".join(mixed)))
        not_found.append((t.label, " ".join(ws[: len(ws) // 3])))
    return found, not_found


def test_planted_licences(spark, planted, odd_documents, tmp_path):
    found, not_found = planted
    texts = [t for _, t in found + not_found] + ["mit License; Apache LICENSE, GNU general public license" * 3, "the MIT-license", "mit\nlicense mit license", "licensed under cc by nc 4.0 " * 500]
    rows = [(r[0], r[1]) for r in odd_documents] + [(5000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"phrases": F.lit("clash"), "a.b": F.lit(1), "score": F.lit(2)}).repartition(6)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op11_licenses(spark, str(tmp_path)))
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute([t for _, t in rows]))), key=str)
    labels = {r[0]: r[6].split(",") for r in got}
    hits = [label in labels[5000 + i] for i, (label, _) in enumerate(found)]
    assert sum(hits) >= 0.9 * len(hits), [f[1][:60] for f, h in zip(found, hits) if not h]
    assert not any(label in labels[5000 + len(found) + i] for i, (label, _) in enumerate(not_found))


def test_interface(spark):
    df = spark.createDataFrame([("x", "we say: keep this note with all copies please"), (None, None)], "k string, body string")
    own = (licenses.Template("own", "Keep this note with all copies", ("keep this note",)),)
    rows = {r.doc_id: r for r in licenses.scan(df, doc_id="k", text="body", templates=own, phrases={"all copies": "c"}).collect()}
    assert [(m.start, m.end, m.label, m.share) for m in rows["x"].matches] == [(2, 8, "own", 1.0)]
    assert [tuple(p) for p in rows["x"].phrases] == [(6, "c")] and tuple(rows[None])[1:] == (0, [], [], 0.0)
    assert licenses.scan(df.limit(0), doc_id="k", text="body").count() == 0
