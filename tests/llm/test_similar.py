"""Links by word shingles against brute force over all pairs that share a shingle."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import similar, simhash
from tests.llm.conftest import DOC_SCHEMA
from tests.llm.test_simhash import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_similar(docs, similarity=0.8):
    """(doc_id, component_id) of rows (doc_id, text) with ids, linked by fingerprints or by shingles."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def link(x, y):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)

    groups = defaultdict(list)
    for i, _, c in brute(docs):
        if i is not None:
            link(i, c)
    for i, text in docs:
        if i is not None:
            groups[shingles(text)].append(i)
    held = defaultdict(list)
    for s, ids in groups.items():
        for i in ids:
            link(ids[0], i)
        shared = Counter(o for x in s for o in held[x])
        for o, n in shared.items():
            if n >= similarity * (len(s) + len(o) - n):
                link(ids[0], groups[o][0])
        for x in s:
            held[x].append(s)
    return [(i, find(i)) for i, _ in docs if i is not None]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """Near copies at all similarities, chains of them, a large group, and texts that only share a long passage."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for k in range(60):
        base = fresh(rng.randint(5, 300))
        texts += [" ".join(base), edited(rng, base, min(len(base), 1 + k % 9))]
    link = fresh(200)
    for _ in range(12):  # each is near the next one, the ends are far apart
        texts.append(edited(rng, link, 3))
        link = texts[-1].split()
    hot = fresh(120)
    texts += [edited(rng, hot, rng.choice([0, 1, 1, 2, 6, 20])) for _ in range(150)]
    passage = fresh(60)
    texts += [" ".join(passage + fresh(rng.choice([6, 20, 60]))) for _ in range(60)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts, 10_000)]


def test_links_lose_nothing_and_add_nothing(spark, near_rows, odd_documents):
    rows = near_rows + [r for r in odd_documents if r[0] is not None]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    want = set(brute_similar([(r[0], r[1]) for r in rows]))
    assert got == want
    plain = {(i, c) for i, _, c in brute([(r[0], r[1]) for r in rows])}
    assert len({c for _, c in want}) < len({c for _, c in plain})


def test_one_of_each_group_stays_with_rows_without_ids(spark, near_rows, odd_documents):
    rows = near_rows[:40] + odd_documents
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumnsRenamed({"lang": "content", "source": "bands"})
    kept = simhash.keep_one_of_each(docs, similarity=0.8)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute_similar([(r[0], r[1]) for r in rows])})
    assert ids.count(None) == 0  # the rows without an id are copies of others here
    assert simhash.keep_one_of_each(docs.limit(0), similarity=0.8).count() == 0


def test_rows_that_repeat_in_all_columns_count_once(spark, near_rows, monkeypatch):
    seen = []
    real = similar.close_pairs
    monkeypatch.setattr(similar, "close_pairs", lambda pairs, sets, *rest: (seen.append((sets.count(), sets.select("content").distinct().count())), real(pairs, sets, *rest))[1])
    rows = near_rows[:60] + near_rows[:3] * 40
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(6)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert got == set(brute_similar([(r[0], r[1]) for r in rows])) and all(a == b for a, b in seen) and seen
    assert simhash.keep_one_of_each(docs, similarity=0.8).count() == len({c for _, c in got})


def spread_family(rng, m, size, low, high):
    """Near copies that differ from one base in a share between low and high of their words: many link to a few others only."""
    base = [f"b{i}" for i in range(size)]
    return [edited(rng, base, int(rng.uniform(low, high) * size)) for _ in range(m)]


def test_families_that_mostly_do_not_link_with_their_middle(spark):
    """Documents that brute force joins with another one and the pivots do too, in families made to be hard."""
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(spread_family(rng, 250, 400, 0.005, 0.05) + spread_family(rng, 150, 500, 0.012, 0.03))]
    want = dict(brute_similar(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert all(want[c] == want[i] for i, c in got.items())  # nothing is joined that doesn't hang together
    merged = len(rows) - len(set(want.values()))
    assert merged > 50 and len(rows) - len(set(got.values())) >= 0.98 * merged


def test_no_link_is_lost_where_bands_pivots_and_rounds_find_none(spark, near_rows, monkeypatch):
    """Bands that never meet, then no bound of rounds but one, against brute force; meetings are dealt in small pieces."""
    monkeypatch.setattr(similar, "PIECE_PAIRS", 50)
    rows = [(r[0], r[1]) for r in near_rows]
    rows += [(i, t) for i, t in enumerate(spread_family(random.Random(12), 120, 400, 0.005, 0.05) + spread_family(random.Random(13), 80, 500, 0.012, 0.03))]
    want = set(brute_similar(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real, asked = similar.similar_labels, []
    for blind in (True, False):
        def labels(rows, texts, *rest, blind=blind, **options):
            asked.append(blind)
            apart = F.array(F.xxhash64("content", F.lit("own")), F.xxhash64("content", F.lit("other")))
            return real(rows, texts.withColumn("bands", apart) if blind else texts, *rest, **options, levels=1)

        monkeypatch.setattr(similar, "similar_labels", labels)
        assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, similarity=0.8).collect()} == want
    assert asked == [True, False]


def test_prefixes_of_similar_sets_meet():
    """Sets of all small sizes at, above and below the similarity: two similar ones have as much of their prefixes in common as both need."""
    words = [f"w{i}" for i in range(400)]
    texts, pairs = [], []
    for n in range(1, 80):
        for m in range(n, 100):
            both = -(-4 * (n + m) // 9)
            if both <= n:
                pairs.append(len(texts))
                texts += [" ".join(words[:n]), " ".join(words[n - both : n - both + m])]
    batch = pa.RecordBatch.from_pydict({"rid": pa.array(range(len(texts))), "text": pa.array(texts, pa.large_string())})
    got = {r["rid"]: r for b in similar._prefixes([batch], 1, 0.8) for r in b.to_pylist()}
    assert len(pairs) > 700
    for i in pairs:
        a, b = got[i], got[i + 1]
        assert len(set(a["tokens"]) & set(b["tokens"])) >= max(a["need"], b["need"])


class Counted(similar.Scratch):
    """Rows of the tables that were written."""

    def put(self, df, name):
        out = super().put(df, name)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def test_prefixes_that_no_other_text_shares_are_not_written(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(60)) for i in range(30)]
    for more, laid, links in (([], 0, 0), ([texts[4] + " end"], 2, 1)):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts + more, pa.large_string())})
        content = similar.sketch(batch, "text", 5)[0].to_pylist()
        rows = spark.createDataFrame(list(enumerate(texts + more)), "rid long, text string").repartition(3)
        rooted = spark.createDataFrame([(i, c, c, None) for i, c in enumerate(content)], "rid long, content long, root long, known long")
        scratch = Counted(spark, "counted")
        found = similar.exact_links(rows, rooted, 5, 0.8, scratch).collect()
        assert scratch.rows["laid"] == laid and scratch.rows["whole"] == laid and len(found) == links


def test_shared_tokens_equal_brute_force_and_no_token_is_hot(spark):
    """Three batches of texts; token 7 is in all of them, token 8 in one component only, copies of a text count once. No token
    is any text's content, which shared_tokens would take for one key."""
    rng = random.Random(9)
    rows = [(c, c % 40 if c % 3 else 5, sorted({7, *([8] if c % 40 == 1 and c % 3 else []), *rng.sample(range(100, 900), 6)})) for c in range(1001, 1301)]
    batches, keys = [], Counter()
    for part in (rows[:100], rows[100:200] + rows[100:110], rows[200:] + rows[:3]):
        content, root, tokens = zip(*part)
        batches.append(pa.RecordBatch.from_pydict({"content": pa.array(content), "root": pa.array(root), "need": pa.array([len(t) for t in tokens]), "tokens": pa.array(tokens, pa.list_(pa.int64()))}))
    dealt = [r for b in similar._dealt(batches) for r in b.to_pylist()]
    keys.update(r["key"] for r in dealt if not r["sure"])
    assert keys[7] <= 2 * len(batches)
    frame = spark.createDataFrame([tuple(r.values()) for r in dealt], "key long, other long, root long, need long, sure boolean")
    got = {(r.content, r.token) for r in similar.shared_tokens(frame, "root").collect()}
    holders = defaultdict(set)
    for c, r, tokens in rows:
        for t in tokens:
            holders[t].add(r)
    assert len(holders[8]) == 1 < sum(8 in t for _, _, t in rows)
    assert got == {(c, t) for c, _, tokens in rows for t in tokens if len(holders[t]) > 1}


def test_work_grows_with_the_members_of_a_family(spark, monkeypatch):
    """Pairs that are compared in all rounds, for a family and one of four times its size."""
    counted = []
    real = similar.close_pairs
    monkeypatch.setattr(similar, "close_pairs", lambda pairs, *rest: (counted.append(pairs.count()), real(pairs, *rest))[1])
    sums = []
    for m in (150, 600):
        counted.clear()
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(spread_family(random.Random(4), m, 400, 0, 0.06))], "doc_id long, text string").repartition(4)
        simhash.near_duplicates(docs, similarity=0.8).count()
        sums.append(sum(counted))
    assert sums[1] < 7 * sums[0]


def test_sketches_depend_on_words_alone(monkeypatch):
    texts = ["A b  c d E f", " a\tb c\nd e F ", "a b c", "", None, "a b c d e g " * 50]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})
    content, bands = (x.to_pylist() for x in similar.sketch(batch, "text", 5))
    assert content[0] == content[1] != content[2] and bands[0] == bands[1] and bands[3] == bands[4] == []
    assert all(len(b) == similar.BANDS for i, b in enumerate(bands) if i not in (3, 4))
    monkeypatch.setattr("panelspark.llm.common.SLICE_BYTES", 7)
    assert [x.to_pylist() for x in similar.sketch(batch, "text", 5)] == [content, bands]


def test_bands_meet_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    common, own = rng.integers(0, 1 << 63, 800), rng.integers(0, 1 << 63, (2, 100))
    a, b = (np.concatenate([common, o]).astype(np.uint64) for o in own)
    lowest = np.stack([[(x * f).min() for f in similar._FACTORS] for x in (a, b)])
    assert abs((lowest[0] == lowest[1]).mean() - 0.8) < 0.13
