"""Alignment of two tokenizers against whole-text encodings and plain loops."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import alignment
from panelspark.llm.queries import op12_cross_tokenizer
from tests.llm.conftest import DOC_SCHEMA

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  two  spaces", "tabs\tand\n lines \n\n end ", "café con leña 日本語 \U0001f600\U0001f468‍\U0001f469 x", "a▁b plain", "wide  space 　x", "<s> [INST] <|endoftext|> <0x41> </s>",
       "\x00nul \x01ctl \x7f", "it's we'll 'S 12345 1,000.50", "trailing ", " leading", "नमस्ते \u0001", "́combining é", "a" * 3000, "x   y \u0085 z", "##  !! ..  ??"]


@pytest.fixture(scope="module")
def both():
    with open(alignment.A_PATH, encoding="utf-8") as a, open(alignment.B_PATH, "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def token(vocabulary, i):
    return vocabulary.joined([i]).tobytes()


def brute(both, text):
    """(A ids, A ends, B ids, B ends) of a whole text by cumulated bytes, or None."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text, return_type=int)
    parts = [[token(both.a_tokens, i) for i in a], [token(both.b_tokens, i) for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = []
    for p in parts:
        at, out = 0, []
        for one in p:
            at += len(one)
            out.append(at)
        ends.append(out)
    return a, ends[0], b, ends[1]


def expected(both, texts):
    """Figures of each text by plain loops over all token pairs of a group."""
    seen, per_doc = defaultdict(int), []
    for text in texts:
        found = brute(both, text)
        links, groups = [], []
        if found:
            a, ae, b, be = found
            i = j = 0
            for cut in sorted(set(ae) & set(be)):
                ga, gb = range(i, ae.index(cut, i) + 1), range(j, be.index(cut, j) + 1)
                groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
                for x in ga:
                    for y in gb:
                        if max(ae[x] - len(token(both.a_tokens, a[x])), be[y] - len(token(both.b_tokens, b[y]))) < min(ae[x], be[y]):
                            links.append((a[x], b[y]))
                i, j = i + len(ga), j + len(gb)
        for pair in set(links):
            seen[pair] += 1
        per_doc.append((found, links, groups))
    top = defaultdict(int)
    for (a, _), n in seen.items():
        top[a] = max(top[a], n)
    out = []
    for found, links, groups in per_doc:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""
        out.append((len(found[0]) if found else 0, len(found[2]) if found else 0, len(groups), len(links),
                    sum(seen[p] == top[p[0]] for p in links), sum(seen[p] for p in links), sha))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  .,'\n\té日 　 \u0085▁s<>1\U0001f600\x00Á")), max_size=40))
def test_pieces_tokenise_as_whole_texts(both, text):
    import pyarrow as pa

    codes, n, pieces = alignment._split(pa.array([text]), both.splits)
    assert both.splits and b" ".join(pieces[c] for c in codes) == text.encode()
    t, place = both.tokens(pieces)
    sizes = {place[k]: len(x) + 1 for k, x in enumerate(pieces)}
    codes = place[codes]
    want = brute(both, text)
    if want is None:
        assert not text or t.bad[codes].any()
        return
    got, base = [[], [], [], []], 0
    for c in codes:
        start, end = t.ends[c] - sizes[c], t.ends[c]
        for k, (ids, ends) in enumerate(((t.a_ids, t.a_ends), (t.b_ids, t.b_ends))):
            mine = (ends > start) & (ends <= end)
            got[2 * k] += ids[mine].tolist()
            got[2 * k + 1] += (base + ends[mine] - start).tolist()
        base += end - start
    assert tuple(got) == tuple(want)


def test_odd_texts_against_loops(spark, both, odd_documents, tmp_path):
    rows = odd_documents + [(3000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).withColumns({"pairs": F.lit("clash"), "batch": F.lit(1), "a.b": F.lit(2)}).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op12_cross_tokenizer(spark, str(tmp_path)).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, expected(both, [r[1] for r in rows])))


def test_given_documents_against_loops(spark, both):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in op12_cross_tokenizer(spark, SF).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, expected(both, [r[1] for r in rows])))


def test_spans_and_counts_beyond_a_broadcast(spark, both, monkeypatch):
    import panelspark.operators.spread as spread

    texts = [t for t in ODD if t] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "name long, body string").select(F.col("name").cast("string"), "body")
    spans = {r.doc_id: r for r in alignment.align(df, doc_id="name", text="body").collect()}
    for i, t in enumerate(texts):
        want, r = brute(both, t), spans[str(i)]
        assert (list(r.a_ids), list(r.a_ends), list(r.b_ids), list(r.b_ends)) == (want or ([], [], [], []))
        assert list(r.cuts) == (sorted(set(want[1]) & set(want[3])) if want else [])
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    got = sorted((int(r[0]), *r[1:]) for r in alignment.linked(df, doc_id="name", text="body").collect())
    assert got == [(i, *x) for i, x in enumerate(expected(both, texts))]
    assert alignment.linked(df.limit(0), doc_id="name", text="body").count() == 0


def test_written_rows_and_row_groups_stay_small(spark, both, monkeypatch, tmp_path):
    """Rows of 4 MB of texts and dozens of them a row group filled an executor's heap when they were read."""
    import glob

    import pyarrow.parquet as pq

    from panelspark.llm import common
    from panelspark.operators import spread

    monkeypatch.setattr(alignment, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    words = ["alpha", "beta,", "naïve", "x1", "kappa's", "42", "Épée", "lambda"]
    text = " ".join(words[(k * k + k // 7) % 8] for k in range(20_000))
    texts = [None, "", *[text] * 24]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    *one, counts, sha = expected(both, [text])[0]
    none = (0, 0, 0, 0, 0, 0, "")
    want = [(i, *(x or none)) for i, x in enumerate([None, None, *[(*one, 24 * counts, sha)] * 24])]
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert sum(size.values()) > 2 * alignment.SLICE_BYTES and sorted(tuple(r) for r in alignment.linked(df).collect()) == want
    held = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/alignment").select("doc_id").collect()]
    assert sorted(i for ids in held for i in ids) == list(size) and all(len(ids) == 1 or sum(size[i] for i in ids) <= alignment.SLICE_BYTES for ids in held)

    monkeypatch.setattr(alignment, "new_folder", lambda _, name: f"{tmp_path}/small-{name}")
    monkeypatch.setattr(common, "BATCH_ROWS", 1)  # each text a row
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    texts = [None, "", *[f"text {i} of many" for i in range(48)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in alignment.linked(df).collect()) == [(i, *x) for i, x in enumerate(expected(both, texts))]
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/small-alignment/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 16


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_tables_without_any_pair(spark, monkeypatch, broadcast_rows):
    from panelspark.operators import spread

    monkeypatch.setattr(spread, "BROADCAST_ROWS", broadcast_rows)
    df = spark.createDataFrame([("a", None), (None, ""), ("b", "x ▁")], "doc_id string, text string")
    assert sorted(map(tuple, alignment.linked(df).collect()), key=str) == [(i, 0, 0, 0, 0, 0, 0, "") for i in ("a", "b", None)]
    assert alignment.linked(df.limit(0)).collect() == []
