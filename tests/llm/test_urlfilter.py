import fnmatch
import random
import re

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm.queries import ALLOW_GLOBS, BLOCK_GLOBS, URL_RULES, op5_url_filter
from panelspark.llm.urlfilter import Automaton, Rule, judge_urls

URLS = ["http://example.net/en/1", "https://a.example.net/en/1?x", "https://badexample.net/en/1", "http://EXAMPLE.com/de/x#y", "http://m.example.com/fr/", "http://x.org/fr/1", "http://org/fr/", "org/fr/", None, "",
        "http://x.net", "http://x.net?/en/", "http://foo.com/a.net/b", "http://casino-x.com/", "http://x.com/ads/1", "http://x.com/a.exe", "http://u.edu/ads/x", "a://b://x.net/en/", "http://x.net:80/", "http://é.example.net/en/ü",
        "http://example.com/DE/", "http://x.ads.y/", "://", "http://" + "a" * 3000 + ".net/" + "b" * 3000, "http:///x", "http://ads.y\n.net/\n", "http://b.net/", "http://b.net/"]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in URL_RULES:
        h, slash, p = r.text.partition("/")
        if ("." + host).endswith("." + h) and path.startswith(slash + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    if best:
        return host, path, best.text, "allow" if best.allow else "block"
    form = f".{host}\x00{path}".replace("\n", "~")
    hits = lambda globs: any(fnmatch.fnmatchcase(form, g.replace(" ", "\x00")) for g in globs)
    return host, path, None, "allow" if hits(ALLOW_GLOBS) or not hits(BLOCK_GLOBS) else "block"


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({"rule": F.lit("clash"), "host": F.lit(1)})
    got = judge_urls(pages, URL_RULES, block_globs=BLOCK_GLOBS, allow_globs=ALLOW_GLOBS)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute(u) for i, u in enumerate(URLS)}


def test_a_very_long_url_costs_its_own_bytes(spark):
    urls = ["http://x.com/" + "a" * 1_500_000 + ".exe", "http://" + "b" * 300_000 + "casino.y/z", "http://b.net/"] * 2
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES, block_globs=BLOCK_GLOBS, allow_globs=ALLOW_GLOBS)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {i: (None, "block") if i % 3 < 2 else ("net/", "block") for i in range(6)}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, []).collect()] == ["allow"]
    assert judge_urls(pages.limit(0), [Rule("net/", False)]).count() == 0


def test_automaton_of_many_words_agrees_with_fnmatch():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    machine = Automaton([g.encode() for g in globs])
    assert machine.words > 4
    got = machine.fits(machine.run(data, off))
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = {r.page_id: brute(r.url) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op5_url_filter(spark, d).collect()} == want
