"""Each stage on what its predecessor kept, against brute force, and the whole run."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import toxicity
from panelspark.llm.common import materialize
from tests.llm.test_layout_queries import brute_mix
from tests.llm.test_similar import brute_similar
from tests.llm.test_text_queries import contamination

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mix_to_target_weights", "sharding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_toxic_documents_go_and_others_stay_as_they_are(spark, stages):
    docs, kept = stages[0], stages[1]
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("score < 0.5").drop("score")
    assert kept.exceptAll(scored).count() == 0 and scored.exceptAll(kept).count() == 0 and kept.count() < docs.count()


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, c in brute_similar(before)}) and len(before) > stages[2].count()


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in contamination([(r.doc_id, r.text) for r in stages[2].collect()], items) if x[5]}
    assert hit and sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in stages[2].collect() if r.doc_id not in hit)


def test_mix_takes_each_document_as_often_as_it_should(stages):
    want = {r[0]: -(-r[4] // r[1]) for r in brute_mix([(r.doc_id, r.text, r.source) for r in stages[3].collect()]) if r[4]}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(want)


def test_shards_hold_every_row(stages):
    a, b = stages[4], stages[5]
    assert b.drop("shard", "slot").exceptAll(a).count() == 0 and a.count() == b.count()
    slots = defaultdict(list)
    for r in b.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns
    assert got.select(F.sum(F.xxhash64("doc_id", "shard").cast("decimal(30,0)"))).first() == stages[-1].select(F.sum(F.xxhash64("doc_id", "shard").cast("decimal(30,0)"))).first()
