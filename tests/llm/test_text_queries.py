"""Secrets, decontamination and quality against brute force over whole texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, quality, secrets
from panelspark.llm.queries import op2_secrets, op3_decontamination, op4_quality
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"
SECRETS = [
    'a password = "hunter22" token:abcdefgh', "api_key='k/9+=_.-x' ApiKey: 12345", "token=token = abcdefgh", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "x" + "0123456789abcdef" * 2 + "g",
    "é" * 5 + " secret: Zm9vYmFyMTIz", "passwd==abc123", "PASSWORD  :  'abcdef'", "nosecret: here=1", "deadbeef" * 3, "AKIAAKIA" + "Z" * 20]
TOKEN = "".join(random.Random(4).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48))


def spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spelled(found):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in found)


def check_secrets(rows, texts):
    assert len(rows) == len(texts)
    want = Counter()
    for doc, text in texts:
        base = spans(text)
        n = Counter(k for _, k, _ in base)
        want[(doc, n[0], n[1], n[2], hashlib.sha256(spelled(base).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_digest = {(doc, hashlib.sha256(spelled(spans(t)).encode()).hexdigest()): spans(t) for doc, t in texts}
    for r in rows:
        base = spelled(by_digest[r.doc_id, r.base_sha256])
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        places = [int(x.split(":")[1]) for x in r.spans.split(",") if x]
        assert places == sorted(places)


def test_secret_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_secrets(op2_secrets(spark, SF).collect(), texts)


def test_secrets_of_odd_texts(spark, odd_documents, tmp_path):
    rows = odd_documents + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(SECRETS)] + [(2000, f"see {TOKEN} there", "en", "s", 0), (2001, "internationalisation2and_more_words_that_are_long", "en", "s", 0)]
    spark.createDataFrame(rows, DOC_SCHEMA).withColumns({"spans": F.lit("clash"), "tokens": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_secrets(spark, str(tmp_path)).collect()
    check_secrets(got, [(r[0], r[1]) for r in rows])
    by = {r.doc_id: r.spans for r in got}
    assert by[2000] == f"random:4:{4 + len(TOKEN)}" and by[2001] == ""


def test_battery_tells_random_from_language(spark):
    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [("random", "".join(rng.choices(b64, k=rng.randint(24, 64)))) for _ in range(400)]
    rows += [("random", "".join(rng.choices("0123456789abcdef", k=rng.randint(32, 64)))) for _ in range(400)]
    rows += [("language", "_".join(rng.choices(["value", "count", "index", "Total", "row", "of", "item"], k=6)) + str(rng.randint(1, 99))) for _ in range(400)]
    rows += [("language", rng.choice(["abc123", "00112233", "a1b1"]) * 8) for _ in range(100)]
    tested = spark.createDataFrame(rows, "kind string, t string").select("kind", secrets.battery(F.col("t"))["p"].alias("p"))
    share = {r.kind: r.s for r in tested.groupBy("kind").agg(F.avg((F.col("p") > 0.1).cast("double")).alias("s")).collect()}
    assert share["random"] > 0.8 and share["language"] < 0.1


def test_planted_secrets_of_each_encoding_and_length(spark):
    """Random strings outside the base patterns among words, names and paths: how many are found, and what else is."""
    rng = random.Random(8)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"hex": digits + "abcdef", "base32": upper + "234567", "base64": upper + lower + digits + "+/"}
    plain = lambda: rng.choice(["_".join(rng.choices(["value", "Count", "index", "total", "row"], k=5)) + str(rng.randint(1, 99)), "src/main/java/" + "/".join(rng.choices(["Parser", "Reader", "Util", "core"], k=3)),
                                "internationalisation2andmore" * rng.randint(1, 3), "/".join(rng.choices(["usr", "share", "lib64", "python3", "site-packages"], k=5))])
    rows, planted = [], {}
    for i in range(900):
        name = ("hex", "base32", "base64")[i % 3]
        length = rng.randint(20, 23) if name == "hex" else rng.choice([rng.randint(20, 31), rng.randint(32, 63), rng.randint(64, 120)])
        secret = "".join(rng.choices(alphabets[name], k=length))
        if i % 2 and not spans(secret):
            planted[i] = (name, length, f"random:5:{5 + length}")
            rows.append((i, f"see: {secret} and {plain()}"))
        else:
            rows.append((i, f"see: {plain()} and {plain()}"))
    got = {r.doc_id: [x for x in r.s.split(",") if x.startswith("random")] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.spelled(F.col("spans")).alias("s")).collect()}
    found = {i: want[2] in got[i] for i, want in planted.items()}
    wrong = sum(len(v) for v in got.values()) - sum(found.values())
    shares = {}
    for name, low, high in [("hex", 20, 23), ("base32", 20, 31), ("base32", 32, 63), ("base32", 64, 127), ("base64", 20, 31), ("base64", 32, 63), ("base64", 64, 127)]:
        some = [found[i] for i, (n, k, _) in planted.items() if n == name and low <= k <= high]
        assert len(some) > 20
        shares[name, low] = sum(some) / len(some)
    # names and paths of 20 to 31 characters share a group with the shortest base64 strings, so more of these are given up
    assert all(v >= (0.6 if k == ("base64", 20) else 0.9) for k, v in shares.items()), shares
    assert sum(found.values()) >= 0.9 * len(found) and wrong <= 0.1 * (wrong + sum(found.values())), (sum(found.values()), len(found), wrong)


def test_a_string_is_judged_alike_whatever_the_size_of_its_group(spark):
    rng = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    clear = ["".join(rng.choices(b64, k=50)) for _ in range(40)]
    p = {r.t: r.p for r in spark.createDataFrame([(t,) for t in clear], "t string").select("t", secrets.battery(F.col("t"))["p"].alias("p")).collect()}
    clear = [t for t in clear if p[t] > 0.2]
    for n in (1, 5, 19, 20, 21, len(clear)):
        rows = [(i, f"x {t}") for i, t in enumerate(clear[:n])]
        assert all(len(r.spans) == 1 for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_places_of_very_many_matches(spark):
    text = "".join(f"token={'ab1' * 3}{i} ,ü" for i in range(3000))
    got = spark.createDataFrame([(text,)], "t string").select(secrets.spans(F.col("t"), secrets.ASSIGN, 2).alias("s")).first().s
    assert [(r.start, r.end) for r in got] == [(a, b) for a, _, b in spans(text)] and len(got) == 3000


def test_secrets_of_an_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


# ---------------------------------------------------------------- decontamination

def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = sorted({len(g) for g in grams})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def odd_benchmark():
    a, b = " ".join(f"q{i}" for i in range(14)), "The, quick-brown FOX jumps over 13 lazy dogs today again"
    items = [(1, a), (2, b), (10, "short item"), (3, ""), (4, None), (None, " ".join(f"n{i}" for i in range(11))), (5, a), (5, a), (6, "épée ÉPÉE"), (7, "one")]
    docs = [(1, f"x {a} y"), (2, a[:30]), (3, b.replace(",", " ;")), (4, "a short, ITEM and short item"), (5, None), (6, ""), (7, "n0 " + " ".join(f"n{i}" for i in range(11))),
            (8, " ".join(f"q{i}" for i in range(2, 14)) + " " + a), (None, "One one"), (9, "épée ÉPÉE"), (9, "épée ÉPÉE"), (10, "z " * 50_000 + a)]
    return docs, items


def test_decontamination_of_odd_texts(spark):
    docs, items = odd_benchmark()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (5, 10_000):
        got = decontaminate.find_contamination(d.withColumn("items", F.lit(1)), b, block_windows=block)
        rows = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
        assert Counter(tuple(r) for r in rows.collect()) == contamination(docs, items)
        clean = {(r[0], r[1]) for r in decontaminate.decontaminate(d.withColumn("n", F.lit(1)), b, block_windows=block).collect()}
        hit = {x[0] for x in contamination(docs, items) if x[5]}
        assert clean == {(i, t) for i, t in docs if i not in hit}


def test_each_block_is_written_and_only_one_is_in_memory(spark, monkeypatch):
    docs, items = odd_benchmark()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, f"item {i} " + " ".join(f"x{i}y{k}" for k in range(12))) for i in range(20)] + items, "item_id long, text string")
    got = decontaminate.find_contamination(d, b, block_windows=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sum(len(r["items"]) for r in got.collect()) == sum(x[3] for x in contamination(docs, items).elements())


def test_spans_are_cut_out_of_texts(spark):
    docs, items = odd_benchmark()
    got = decontaminate.remove_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=5).collect()
    assert len(got) == len(docs) and not any(x[5] for x in contamination([tuple(r) for r in got], items))
    texts = Counter(r.text for r in got if r.doc_id in (1, 2, 3))
    assert texts == Counter(["x   y", "  ", " "]) and {r.text for r in got if r.doc_id in (5, 6)} == {None, ""}


def test_decontamination_without_rows(spark):
    docs, items = odd_benchmark()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0
    assert decontaminate.find_contamination(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter(tuple(r) for r in op3_decontamination(spark, SF).collect()) == contamination(docs, items)


def test_no_text_is_written_whatever_the_number_of_blocks(spark):
    import glob

    import pyarrow.parquet as pq

    from panelspark.sources.staging import shared_folder

    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 12])) for i in range(20)]
    docs = [(i, " ".join(words[i * 7 : i * 7 + 60]), "en", "s", 0) for i in range(40)] * 2
    d = spark.createDataFrame(docs, DOC_SCHEMA).repartition(4)
    root = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/contamination-*"))
    got = decontaminate.find_contamination(d, spark.createDataFrame(items, "item_id long, text string"), block_windows=3)
    rows = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), ",".join(r["items"])) for r in got.collect())
    want = sorted(x[:4] for x in contamination([(r[0], r[1]) for r in docs], items).elements())
    assert [r[:4] for r in rows] == want
    files = [f for folder in set(glob.glob(f"{root}/contamination-*")) - before for f in glob.glob(f"{folder}/*/*.parquet")]
    assert files and all("text" not in pq.read_schema(f).names for f in files) and len({f.split("/")[-2] for f in files}) > 15


# ---------------------------------------------------------------- quality

def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


@pytest.mark.parametrize("odd", [False, True])
def test_quality_query(spark, odd_documents, tmp_path, odd):
    if odd:
        rows = odd_documents + [(500, "a b c d e f " * 9, "en", "s", 0), (501, "l one\nl two\nl one\n\n \n \nl one", "en", "s", 0), (502, "a b c d e a b c d e", "en", "s", 0), (503, "x " * 5, "en", "s", 0)]
        d = str(tmp_path)
        spark.createDataFrame(rows, DOC_SCHEMA).withColumns({"kept": F.lit("clash"), "metric": F.lit(1)}).write.parquet(f"{d}/documents.parquet")
    else:
        d = SF
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_quality(spark, d).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *counts(t)) for i, t in docs)
    assert not any(r.base_failed and r.kept for r in got)


def brute_kept(rows, fence=quality.FENCE, weight=quality.WEIGHT):
    """doc index -> kept, from sorted values in the sketch's bins; rows (lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)."""
    share = lambda a, b: a / b if b else 0.0
    metrics = {"symbols_per_word": lambda r: share(r[4], r[2]), "chars_per_word": lambda r: share(r[3], r[2]), "dup_line_share": lambda r: share(r[5], r[6]), "repeat_share": lambda r: share(r[7], r[2])}

    def level(value):
        return 0 if value <= 1e-6 else math.ceil(math.log(value / 1e-6) / math.log(quality.GAMMA))

    times = {"symbols_per_word": lambda r: r[4], "dup_line_share": lambda r: r[5], "repeat_share": lambda r: r[7] / 5}

    def at(values, p):
        b = sorted(map(level, values))[max(0, math.ceil(p * len(values)) - 1)]
        return 0.0 if b == 0 else 1e-6 * quality.GAMMA ** (b - 0.5)

    def limit(group, metric):
        """(size, cutoff) of a metric in a group."""
        values = [metrics[metric](r) for r in group]
        least = 0.0
        if at(values, 0.75) == 0:
            values = [v for v in values if level(v)]
            if not values:
                return 0, 0.0
            if at([times[metric](r) for r in group if times[metric](r)], 0.1) >= quality.GAP:
                return len(group), at(values, 0.1) / 2
            least = at(values, 0.25)
        return len(values), at(values, 0.75) + fence * max(at(values, 0.75) - at(values, 0.25), least)

    known = [r for r in rows if r[2] >= 10 and 100 * r[7] <= 20 * r[2]]
    out = []
    for r in rows:
        if r[2] < 10 or 100 * r[7] > 20 * r[2]:
            out.append(False)
            continue
        own, language = [x for x in known if x[:2] == r[:2]], [x for x in known if x[0] == r[0]]
        good = True
        for m in metrics:
            (n, cut), (n_language, wide), (n_all, widest) = (limit(g, m) for g in (own, language, known))
            part, part_language = n / (n + weight), n_language / (n_language + weight)
            good &= not n_all or metrics[m](r) <= part * cut + (1 - part) * (part_language * wide + (1 - part_language) * widest)
        out.append(good)
    return out


def test_kept_agrees_with_sorted_values(spark, odd_documents):
    rng = random.Random(2)
    word = lambda: rng.choice(["plain", "words", "stand", "here", "again", "today", "maybe", "seven", "other", "lines"]) + ("#" * 3 if rng.random() < 0.05 else "")
    rows = odd_documents + [(5000 + i, "".join(word() + rng.choice(" \n") for _ in range(rng.randint(8, 120))) + ("\nsame line\n" * rng.choice([0, 0, 0, 3, 9])), rng.choice(["en", "de"]), f"s{i % 3}", 0) for i in range(300)]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], DOC_SCHEMA)
    measured = {r.doc_id: r for r in quality.measure(docs).collect()}
    want = brute_kept([(r.lang, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) for r in (measured[i] for i in range(len(rows)))])
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want and 20 < sum(want) < len(rows) - 20


def test_each_metric_alone_rejects_a_text(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    clean = [" ".join(fresh(50)) + "\n" + " ".join(fresh(50)) for _ in range(200)]
    repeated = fresh(220)
    odd = [" ".join(w + "#" for w in fresh(100)), " ".join(w * 3 for w in fresh(100)), "\n".join([" ".join(fresh(92)), *["again"] * 12]), " ".join(repeated + repeated[:22])]
    for text in odd:
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*clean, text])], DOC_SCHEMA)
        got = {r.doc_id: r for r in quality.judge(docs).collect()}
        assert all(got[i].kept for i in range(200)) and (got[200].base_failed, got[200].kept) == (False, False)


def test_cutoffs_follow_language_and_source(spark):
    rng = random.Random(5)

    def text(symbols):
        return " ".join(rng.choice(["plain", "words", "stand", "here", "again", "today", "maybe"]) + ("%%" if rng.random() < symbols else "") for _ in range(80))

    rows = [(i, text(0.0), "en", "books", 0) for i in range(300)] + [(1000 + i, text(0.9), "en", "code", 0) for i in range(300)]
    rows += [(2000 + i, text(0.9), "en", "books", 0) for i in range(10)] + [(3000 + i, text(0.0), None, None, 0) for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOC_SCHEMA)).filter("not base_failed").collect()}
    assert all(v for k, v in kept.items() if k < 1300) and all(v for k, v in kept.items() if k >= 3000)
    assert not any(v for k, v in kept.items() if 2000 <= k < 2010)


def test_cutoffs_of_each_metric_differ_between_groups_of_other_levels(spark):
    """Groups whose texts show a metric now and then, each at its own level, have cutoffs of their own for every metric."""
    rng = random.Random(8)
    rows = []
    for g in range(8):
        for i in range(150):
            words = [f"w{rng.randrange(10**5)}" + "x" * (g if rng.random() < 0.5 else 0) for _ in range(60)]
            if rng.random() < 0.2:
                words = [w + "#" * (rng.random() < 0.05 * (g + 1)) for w in words]
            lines = [" ".join(words[k : k + 4]) for k in range(0, 60, 4)]
            if rng.random() < 0.2:
                lines += rng.choices(lines, k=1 + rng.randrange(g // 3 + 1))
            rows.append((len(rows), "\n".join(lines), rng.choice(["en", "de"]) if g == 7 else "en", f"s{g}", 0))
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    limits = quality.cutoffs(quality.sketch(quality.measure(docs).filter("n_words >= 10"))).collect()
    assert len(limits) == 9
    for metric in quality.METRICS:
        values = [r[metric] for r in limits]
        assert len({round(v, 6) for v in values}) >= 5 and max(values) > 1.02 * min(values), (metric, values)
    low = quality.cutoffs(quality.sketch(quality.measure(docs.filter("source = 's0'")).filter("n_words >= 10"))).first()
    high = quality.cutoffs(quality.sketch(quality.measure(docs.filter("source = 's6'")).filter("n_words >= 10"))).first()
    assert high.chars_per_word > 1.5 * low.chars_per_word


def test_sketch_quantiles_are_within_their_error(spark):
    rng = random.Random(9)
    values = [rng.lognormvariate(0, 2) for _ in range(3000)] + [0.0] * 500
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(F.lit("m").alias("metric"), F.lit("share").alias("of"), quality._bin(F.col("v")).alias("bin"))
    a, b = rows.randomSplit([0.3, 0.7], 1)
    both = quality.merge(a.groupBy("metric", "of", "bin").agg(F.count("*").alias("n")).unionAll(b.groupBy("metric", "of", "bin").agg(F.count("*").alias("n"))))
    got = quality.quantiles(both, [], {"q": 0.75, "z": 0.1}).first()
    exact = sorted(values)[int(len(values) * 0.75)]
    assert abs(got.q - exact) / exact < 0.03 and got.z == 0.0


def test_quality_of_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
