"""Mixing, sharding and chat formatting against brute force."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import chat, mixing, sharding
from panelspark.llm.queries import ODD_TEXT, op7_mixing, op8_sharding, op9_chat_format
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- mixing

def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        goal = {s: cap * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if goal[s] > cap * sizes[s] + 1e-9}
        if not over:
            return goal
        full |= over


def brute_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for doc, text, source in docs:
        by[source].append((key(doc), -1 if doc is None else doc, size(text), doc))
    sizes = {s: sum(r[2] for r in rows) for s, rows in by.items()}
    goal, out = water(sizes), []
    for s, rows in by.items():
        budget, before = int(goal[s] + 1e-9), 0
        whole = budget // sizes[s] if sizes[s] else 0
        for _, _, n, doc in sorted(rows, key=lambda r: r[:3]):
            out.append((doc, n, sizes[s], round(goal[s], 4), whole * n + max(0, min(n, budget - whole * sizes[s] - before))))
            before += n
    return Counter(out)


@pytest.mark.parametrize("odd", [False, True])
def test_mixing(spark, odd_documents, tmp_path, odd):
    d = str(tmp_path) if odd else SF
    if odd:
        spark.createDataFrame(odd_documents, DOC_SCHEMA).withColumns({"before": F.lit(1), "size": F.lit("clash"), "target": F.lit(1)}).write.parquet(f"{d}/documents.parquet")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op7_mixing(spark, d)
    rows = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4), r.taken) for r in got.collect())
    assert rows == brute_mix(docs)
    taken, target = sum(r[4] * n for r, n in rows.items()), sum({(r[2], r[3]) and r[3]: 1 for r in rows})
    assert taken > 0 and target > 0


def test_rows_that_share_an_id_are_mixed_one_by_one(spark):
    rows = [(None, " ".join(["w"] * (3 + i)), "a", 1) for i in range(30)] + [(7, " ".join(["v"] * n), "b", 2) for n in (5, 50, 50, 500)] + [(i, "x y z", "c", 3) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = Counter(tuple(r) for r in got.collect())
    words, copies = Counter(), Counter()
    for (_, text, source, _), n in counts.items():
        words[source] += n * len(text.split())
    for r in mixing.mix(docs).collect():
        copies[r.source] = r.target
    largest = {"a": 32, "b": 500, "c": 3}
    assert all(target - 1e-6 <= words[s] + 1 and words[s] <= target + largest[s] for s, target in copies.items())
    assert all(n <= 3 * (2 if row[1] == " ".join(["v"] * 50) else 1) for row, n in counts.items())


def test_mixed_rows_repeat_whole_documents(spark, odd_documents):
    docs = spark.createDataFrame([r for r in odd_documents if r[0] != 105], DOC_SCHEMA)
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix(docs).collect() if r.taken}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = Counter(r.doc_id for r in got.collect())
    assert {k: v for k, v in rows.items() if k is not None} == {k: v for k, v in taken.items() if k is not None}
    assert mixing.mix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- sharding

def check_shards(rows, docs, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("odd", [False, True])
def test_sharding(spark, odd_documents, tmp_path, odd):
    d = str(tmp_path) if odd else SF
    if odd:
        spark.createDataFrame(odd_documents, DOC_SCHEMA).withColumns({"shard": F.lit("clash"), "size": F.lit("x")}).write.parquet(f"{d}/documents.parquet")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(op8_sharding(spark, d).collect(), docs, 40)


def test_shards_are_near_equal_with_a_third_of_equal_texts_and_small_runs(spark):
    rows = [(i, "same text" * 5 if i % 3 == 0 else f"text {i} " * (1 + i % 7), "en", "s", 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = sharding.shard_documents(docs, shards=7, run_bytes=9000).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += len(r.text) + 16
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(sizes) == set(range(7))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_starts_no_python_worker(spark, monkeypatch):
    """Workers of another kind, started for a column function or a list of rows, stay beside those of the other stages."""
    def failing(*args):
        raise AssertionError("a list of rows goes through Python workers")

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1700).alias("text"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", failing)
    got = sharding.shard_documents(docs, shards=40, run_bytes=500)
    plan = got._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan
    assert got.select("shard").distinct().count() == 40


def test_runs_against_bisection(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 39, 64, 479, 10_239):
        bounds = sorted([rng.getrandbits(64) - (1 << 63) for _ in range(n)] + [-(1 << 63), (1 << 63) - 1, (1 << 63) - 1][: n // 3])
        keys = [-(1 << 63), (1 << 63) - 1, 0, *bounds[:50], *[b + 1 for b in bounds[:50] if b < (1 << 63) - 1], *[rng.getrandbits(64) - (1 << 63) for _ in range(200)]]
        got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", sharding._number_below(bounds, F.col("key"))).collect()
        assert [tuple(r) for r in got] == [(k, bisect.bisect_right(bounds, k)) for k in keys]


def test_ten_thousand_splitters_against_sorted_keys(spark, monkeypatch):
    rng = random.Random(5)
    rows = sorted((rng.getrandbits(64), rng.randint(16, 5000)) for _ in range(30_000))
    signed = [((k ^ (1 << 63)) - (1 << 64) if (k ^ (1 << 63)) >> 63 else k ^ (1 << 63), n) for k, n in rows]
    total = sum(n for _, n in rows)
    wanted = [total * i / 10_001 for i in range(1, 10_001)]
    seen = []
    real = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (lambda out: (seen.append(len(out)), out)[1])(real(self)))
    got = sharding.splitters(spark.createDataFrame(signed, "key long, size long"), wanted, 0.0)
    monkeypatch.undo()
    assert len(got) == 10_000 and max(seen) <= sharding.COUNTS
    keys, sums = [k for k, _ in rows], [0]
    for _, n in rows:
        sums.append(sums[-1] + n)
    for want, (key, size, before) in zip(wanted, got):
        at = bisect.bisect_left(keys, key)
        assert before == at and size == sums[at]
        near = bisect.bisect_left(sums, want)
        assert abs(size - want) <= min(abs(sums[i] - want) for i in (max(near - 1, 0), min(near, len(rows)))) + 1e-6


# ---------------------------------------------------------------- chat

def chat_digest(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in op9_chat_format(spark, SF).collect()}
    assert got == chat_digest(rows + [(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)])


@pytest.mark.parametrize("part_bytes", [64, 1 << 20])
def test_odd_turns_in_small_parts(spark, part_bytes):
    odd = ["", None, "\\", "\\\\l", "<|assistant|>\nhi</s>\n", "[INST]\\b|", "é<ü>\x00", "a\nb\n", "\\l\\\\p|", "x" * 500]
    rows = [(c, t, ["user", "assistant", None, "a|b>\n", "system"][(c + t) % 5], odd[(c * 3 + t) % len(odd)]) for c in range(7) for t in range(12)]
    rows += [(50, None, "assistant", "last"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (None, 0, "assistant", "no id"), (-5, 0, "user", "only a user")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} <|" * 3) for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("clash"), "loss": F.lit(1)})
    parts = chat.format_conversations(table, part_bytes=part_bytes)
    got = chat.digests(parts)
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == chat_digest(rows)
    formatted = defaultdict(str)
    for r in sorted(parts.collect(), key=lambda r: (str(r.conv_id), r.part)):
        formatted[r.conv_id] += bytes(r.formatted).decode()
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == {k: len(v) for k, v in formatted.items()}
    assert all("[INST]" not in v and "<s>" not in v for v in formatted.values())


def test_a_batch_is_one_buffer_and_a_conversation_many_tasks(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|" * 3) for t in range(4000)] + [(c, 0, "user", "one") for c in range(2, 40)]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert parts.filter("conv_id = 1").select(F.expr("shiftright(part, 32)")).distinct().count() > 3
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(parts).collect()} == chat_digest(rows)


def test_no_conversations(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
