"""The divergence audit against whole loops over words, groups and pairs."""

import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from panelspark.llm import divergence
from panelspark.llm.queries import ORACLE_SQL, op13_divergence
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"


def brute(rows, top=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, w in words:
        docs[lang].update(set(w))
        counts[lang, source].update(w)
        groups[lang].add(source)
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources}
        own[None] = sum((Counter(c) for c in own.values()), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in own.items()}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    got = sorted(tuple(r) for r in op13_divergence(spark, SF).collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TEMP TABLE sql AS {ORACLE_SQL['op13_divergence']}")
    assert got == sorted(con.execute("SELECT lang, source, part, item, value, rank FROM sql").fetchall())


def test_odd_rows_and_tiles(spark, odd_documents, monkeypatch):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(500)]
    rows = [(r[1], r[2], r[3]) for r in odd_documents]
    rows += [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(500)], k=rng.randint(0, 300))), rng.choice(["en", "xx"]), f"s{rng.choice('000123')}") for _ in range(120)]
    rows += [(None, "zz", "a"), ("", "zz", "b"), ("once", "zz", "c"), ("same same", "yy", "a"), ("same", "yy", "b"), ("SAME", "yy", "c"), ("same", "one", "a"), ("same", "one", "a"), ("same", "one", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "n": F.lit(1), "a.b": F.lit(2), "part": F.lit("x")}).repartition(7)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == brute(rows)
    monkeypatch.setattr(divergence, "TILE", 3)
    few = rows[-60:]
    one = divergence._bits(spark.createDataFrame([("l", i, s, 1 + i % 5, 10 * (1 + i % 5), 9) for i in range(70) for s in "abc"], "lang string, id long, source string, n long, p long, p0 long"))
    whole = divergence._cells(one.toArrow()).to_pandas().groupby(["source", "other"]).value.sum().to_dict()
    monkeypatch.setattr(divergence, "TILE", 512)
    assert whole == divergence._cells(one.toArrow()).to_pandas().groupby(["source", "other"]).value.sum().to_dict() and len(whole) == 6
    got = divergence.audit(spark.createDataFrame([(t, lg, s) for t, lg, s in few], "body string, l string, s string"), text="body", lang="l", source="s", top=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(few, 2)
    assert divergence.audit(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
