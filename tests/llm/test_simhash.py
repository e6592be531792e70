import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import common, simhash
from panelspark.llm.queries import op10_simhash
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.01"


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, bits=3):
    """fingerprint -> lowest fingerprint reachable."""
    nodes = sorted(set(prints))
    up = {p: p for p in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    values = np.array(nodes, np.uint64)
    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            a, b = find(nodes[i]), find(nodes[i + 1 + j])
            up[max(a, b)] = min(a, b)
    return {p: find(p) for p in nodes}


def brute(docs):
    prints = {i: brute_print(t) for i, t in enumerate(t for _, t in docs)}
    roots = brute_roots(prints.values())
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            r = roots[prints[i]]
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(roots[prints[i]])) for i, (doc, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_query(spark, odd_documents, tmp_path, odd):
    d = str(tmp_path) if odd else SF
    if odd:
        base = " ".join(f"word{i % 97}" for i in range(2000))
        near = [(700 + i, base.replace("word5 ", f"other{i} ", 1), "en", "s", 0) for i in range(12)]
        spark.createDataFrame(odd_documents + near, DOC_SCHEMA).withColumns({"fp": F.lit("clash"), "root": F.lit(1), "a": F.lit(2)}).write.parquet(f"{d}/documents.parquet")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in op10_simhash(spark, d).collect()], key=str)
    want = brute(docs)
    assert got == want and any(i is not None and i != c for i, _, c in want)


def cloud(n, seed=1):
    """Chains and balls of near prints among random ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        p = out[rng.randrange(len(out))]
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
            p ^= 1 << b
        out.append(p)
    return sorted(set(out))


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_links_lose_nothing(spark, bucket_rows):
    prints = cloud(1500) + [0, 1, 7, (1 << 64) - 1]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(p),) for p in sorted(set(prints))], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(nodes, bucket_rows=bucket_rows)).collect()}
    want = brute_roots(prints)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({p: roots.get(p, signed(p)) for p in want}) == groups(want)


def test_gray_index_finds_what_brute_force_finds():
    prints = np.array(cloud(700, 3), np.uint64)
    index = simhash.GrayIndex(prints)
    assert len(index.levels) > 1
    found = {(int(a), int(b)) for q, p in index.near(prints, 3) for a, b in zip(q, p) if a < b}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(np.bitwise_count(prints[i] ^ prints[j])) <= 3}
    assert found == want and want
    gray = [i ^ i >> 1 for i in range(64)]
    assert simhash.gray_rank(np.array(gray, np.uint64)).tolist() == list(range(64))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_of_each_group_stays(spark, odd_documents):
    docs = spark.createDataFrame(odd_documents, DOC_SCHEMA).withColumn("fp", F.lit("clash"))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    named = [r.doc_id for r in rows if r.doc_id is not None]
    groups = {c for i, _, c in brute([(r[0], r[1]) for r in odd_documents]) if c is not None}
    assert sorted(named) == sorted(groups)
    assert len(rows) == len(named)  # each row without an id has a copy or is a null text
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_rows_without_ids_and_rows_that_share_an_id_are_compared_one_by_one(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(5)), (8, text(5)), (9, text(4)), (6, text(1))]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash")).repartition(4))
    assert kept.columns == ["doc_id", "text", "rid"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5))], key=str)


def test_all_candidates_come_from_the_gray_index(spark, monkeypatch):
    prints = [0, 1, 3, 7 << 40, 1 << 20]
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert simhash.links(nodes).count() > 0
    monkeypatch.setattr(simhash.GrayIndex, "near", lambda self, queries, max_bits, same=0: iter(()))
    assert simhash.links(nodes).count() == 0


def test_the_index_prunes_whole_groups():
    rng = np.random.default_rng(2)
    index = simhash.GrayIndex(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    mask, value = index.levels[-1]
    query = index.prints[:1]
    near = (np.bitwise_count((query ^ value) & mask) <= 3).mean()
    assert near < 0.4  # leaves that a search has to open


def test_hashes_of_many_pieces_are_those_of_each():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    sizes = np.r_[np.arange(0, 130), rng.integers(0, 600, 200), 512, 513, 5000]
    starts = rng.integers(0, len(data) - sizes + 1)
    starts[:3] = len(data) - sizes[:3]
    got = common.xxh64(data, starts, starts + sizes, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes)]


def test_long_and_odd_texts():
    for text in (("Aa bb\tcc  dd\nee " * 40).strip(), "x" * 3000 + " y " + "Zé" * 900, " a  b ", "one", "", " \t", "w " * 30_000):
        assert simhash.fingerprint(text.encode()) == brute_print(text)
