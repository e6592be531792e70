"""Every stage with columns whose names clash with helpers or hold dots, and with ids that are strings."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import decontaminate, simhash, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
NAMES = ["__id", "__rid", "__key", "__copies", "__copy", "__n", "__run", "__r", "__place", "__first", "__toxicity", "toxicity", "score", "kept", "rid", "fp", "c0", "c1", "a.b", "label", "bands"]


def with_clashes(df):
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.col(df.columns[0]).cast("string")).alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_odd_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = with_clashes(docs)
    got = stage(spark, odd, SF)
    added = ["shard", "slot"] if name == "sharding" else []
    assert got.columns == [*odd.columns, *added]
    plain = stage(spark, docs, SF)
    key = lambda rows, n: sorted((tuple(r)[:n] for r in rows), key=str)
    back = got.collect()
    if name != "sharding":  # slots of equal keys may differ
        assert key(back, 5) == key(plain.collect(), 5)
    assert len(back) == plain.count() and all(r[odd.columns.index(n)] == f"{n}:{r[0]}" for r in back for n in NAMES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "toxicity"])
def test_stage_takes_ids_that_are_strings(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    named = docs.withColumn("doc_id", F.format_string("d%08d", "doc_id"))
    got = stage(spark, named, SF)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    if name not in ("mix_to_target_weights", "sharding"):
        assert sorted(r.doc_id for r in got.collect()) == sorted(f"d{r.doc_id:08d}" for r in stage(spark, docs, SF).collect())
    else:
        assert got.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF).count() == 0


def test_operators_beside_the_stages(spark, docs):
    odd = with_clashes(docs)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    cut = decontaminate.remove_spans(odd, bench)
    assert cut.columns == odd.columns and cut.count() == docs.count()
    groups = simhash.near_duplicates(odd.withColumnRenamed("doc_id", "the.id"), doc_id="the.id")
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    scored = toxicity.score(odd, toxicity.train(odd, spark.read.parquet(f"{SF}/labels.parquet")))
    assert scored.columns == [*[c for c in odd.columns if c != "score"], "score"]
    pages = with_clashes(spark.read.parquet(f"{SF}/pages.parquet")).withColumn("Host", F.lit("x"))
    judged = urlfilter.judge_urls(pages, [urlfilter.Rule("net/", False)])
    assert judged.columns == [*pages.drop("host").columns, "host", "path", "rule", "verdict"] and judged.count() == pages.count()
