import hashlib

from pyspark.sql import functions as F

from panelspark.llm import warc
from panelspark.llm.common import new_folder
from panelspark.llm.queries import op1_warc

SCHEMA = "page_id long, url string, html string"
BIG = "é" * 600


def expected(rows, least=1000):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            groups[data] = max(groups.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = groups.get(data)
        again = top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", BIG),
            (8, "x", "\r\n\r\nWARC/1.1\r\n" * 100), (9, "x", "a" * 1000), (9, "x", "a" * 1000), (10, "x", "a" * 1000), (11, "y", "b" * 999), (12, "y", "b" * 999)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages)
    assert sorted([tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == expected(rows)
    payloads = {r.page_id: r.payload for r in got.collect() if r.record_type == "response"}
    assert bytes(payloads[3]) == BIG.encode() and bytes(payloads[6]) == b""


def test_selected_records_are_read_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}" * 50) for i in range(200)], SCHEMA).repartition(3)
    folder = new_folder(spark, "warc")
    index = spark.read.parquet(warc.write_archives(pages, folder))
    assert index.count() == 200
    some = warc.read_records(spark, index.filter("page_id % 7 = 0"), folder, gap=100, span=500)
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in some.collect()} == {(i, f"http://h/{i}", f"page {i}" * 50) for i in range(0, 200, 7)}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted([tuple(r) for r in op1_warc(spark, d).collect()], key=str) == expected(rows)
