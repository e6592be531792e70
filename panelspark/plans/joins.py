"""Queries on joins, canonical documents and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators import joins, panels
from panelspark.plans.registry import query


def yearly(t):
    return t.orders.withColumn("yr", F.year("o_orderdate"))


def by_line(prefix=""):
    return [F.col(prefix + c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]


@query("""
WITH li AS (SELECT l_orderkey, count(*) AS n_lines, min(l_shipdate)::DATE AS filed FROM lineitem GROUP BY 1),
cl AS (SELECT l_orderkey, bool_or(p_type = 'PROMO') AS promo, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey, year(o_orderdate)::INTEGER AS yr, n_lines, filed, coalesce(promo, false) AS promo, coalesce(brands, 0) AS brands FROM orders LEFT JOIN li ON o_orderkey = li.l_orderkey LEFT JOIN cl ON o_orderkey = cl.l_orderkey""")
def canonical_docs(t):
    lines = t.lineitem.join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    doc = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.to_date(F.min("l_shipdate")).alias("filed"), F.bool_or(F.col("p_type") == "PROMO").alias("promo"), F.count_distinct("p_brand").alias("brands"))
    return yearly(t).join(doc, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "yr", "n_lines", "filed", F.coalesce("promo", F.lit(False)).alias("promo"), F.coalesce("brands", F.lit(0)).alias("brands"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_linenumber, l_suppkey, n_name, r_name, round(share, 6) AS share FROM x JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2""")
def doc_places(t):
    placed = panels.share_of_group(t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey"), ["l_orderkey"])
    place = t.nation.join(t.region.filter("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "n_name", "r_name", F.round("share", 6).alias("share"))


@query("""SELECT yr::INTEGER AS yr, ordered, shipped FROM (SELECT year(o_orderdate) AS yr, count(*) AS ordered FROM orders GROUP BY 1) FULL JOIN (SELECT year(l_shipdate) AS yr, count(*) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (yr)""")
def full_join_years(t):
    a = yearly(t).groupBy("yr").agg(F.count(F.lit(1)).alias("ordered"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.year("l_shipdate").alias("yr")).agg(F.count(F.lit(1)).alias("shipped"))
    return a.join(b, ["yr"], "full")


@query("""SELECT p.event_id, p.user_id, p.ts, (SELECT max({'ts': s.ts, 'value': s.value}) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts).value AS value FROM events p WHERE event_type = 'purchase'""")
def asof_last_value(t):
    sign = t.events.filter("event_type = 'signup'").select("user_id", "ts", "value")
    return joins.asof(t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), sign, ["user_id"], "ts", ["value"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_unlinked(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_in_universe(t):
    return t.documents.select("doc_id", "lang").join(t.labels.filter("quality = 1"), "doc_id", "left_semi")


@query("""WITH c AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2 HAVING count(*) >= 5""")
def class_pair_edges(t):
    sets = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("s")).filter("size(s) > 1")
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.expr("s"), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("e")).select("e.a", "e.b").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("""SELECT c_custkey, y::INTEGER AS year FROM (SELECT c_custkey, unnest(range(1995 + c_custkey % 5, least(CASE WHEN c_custkey % 3 = 0 THEN 2001 ELSE 1997 + c_custkey % 4 END, 2001) + 1)) AS y FROM customer)""")
def interval_expand_years(t):
    k = F.col("c_custkey")
    start, end = (1995 + k % 5).cast("int"), F.when(k % 3 != 0, (1997 + k % 4).cast("int"))
    return joins.years_between(t.customer, start, end, 2001).select("c_custkey", "year")


@query("""WITH e AS (SELECT o_custkey, year(o_orderdate) AS yr, min(o_orderpriority) AS p FROM orders GROUP BY 1, 2), a AS (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT c_custkey AS o_custkey, 1998::INTEGER AS yr, coalesce(e.p, a.p) AS p FROM customer LEFT JOIN e ON e.o_custkey = c_custkey AND yr = 1998 LEFT JOIN a ON a.o_custkey = c_custkey""")
def lookup_year_then_any(t):
    y = yearly(t)
    return joins.lookup_two_levels(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(1998).alias("yr")), y.groupBy("o_custkey", "yr").agg(F.min("o_orderpriority").alias("p")),
                                   y.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p")), ["o_custkey", "yr"], ["o_custkey"], "p").select("o_custkey", "yr", "p")


@query("""SELECT n_nationkey, y::INTEGER AS year, coalesce(n, 0) AS n FROM nation CROSS JOIN (SELECT unnest(range(1994, 2003)) AS y) LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS yr, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON c_nationkey = n_nationkey AND yr = y""")
def panel_skeleton(t):
    n = yearly(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("yr").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return joins.skeleton(t.nation.select("n_nationkey"), 1994, 2002).join(n, ["n_nationkey", "year"], "left").select("n_nationkey", "year", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH p AS (SELECT unnest(['Brand#1X', 'Brand#11', 'Brand#XX', 'Brand#3X', 'Brand#45']) AS pattern),
m AS (SELECT p_partkey, pattern, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) - length(replace(pattern, 'X', '')), pattern) AS k FROM part JOIN p ON regexp_full_match(p_brand, replace(pattern, 'X', '.')))
SELECT p_partkey, pattern FROM part LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (p_partkey)""")
def wildcard_code_join(t):
    rules = t.spark.createDataFrame([(p,) for p in ("Brand#1X", "Brand#11", "Brand#XX", "Brand#3X", "Brand#45")], "pattern string")
    return joins.wildcard(t.part.select("p_partkey", "p_brand"), rules, "p_brand", "pattern").select("p_partkey", "pattern")


_COVER = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '29-122' || p_partkey % 10 ELSE (11 + p_partkey % 19)::VARCHAR || '-' || lpad((p_partkey * 7919 % 3000)::VARCHAR, 4, '0') END AS soc FROM part"
_COVERS = """SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN substr(c, 1, 4) || 'XX' WHEN 1 THEN substr(c, 1, 5) || '0' WHEN 2 THEN substr(c, 1, 3) || 'Y00' ELSE c END AS pattern FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 50 = 1 THEN '291210' ELSE (11 + s_suppkey % 19)::VARCHAR || lpad((s_suppkey * 13 % 3000)::VARCHAR, 4, '0') END AS c FROM supplier)"""


@query(f"""WITH c AS (SELECT *, replace(soc, '-', '') AS d FROM ({_COVER})), r AS (SELECT pattern, rpad(regexp_replace(regexp_replace(pattern, '0+$', ''), '[^0-9]', '.', 'g'), 6, '.') AS e FROM ({_COVERS})),
m AS (SELECT p_partkey, pattern, 1 AS turn, CASE WHEN d = pattern THEN 6 ELSE length(replace(e, '.', '')) END AS n FROM c JOIN r ON regexp_full_match(d, e)
UNION ALL SELECT p_partkey, pattern, 2, CASE WHEN pattern = '291210' THEN 6 ELSE length(replace(e, '.', '')) END FROM c JOIN r ON starts_with(d, '29122') AND regexp_full_match('291210', e)),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY turn, n DESC, pattern) AS k FROM m) SELECT p_partkey, soc, pattern FROM c LEFT JOIN (SELECT p_partkey, pattern FROM b WHERE k = 1) USING (p_partkey)""")
def occupation_code_cover(t):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    digits = lambda x: F.lpad((x % 3000).cast("string"), 4, "0")
    soc = F.when(p % 11 == 0, F.concat(F.lit("29-122"), (p % 10).cast("string"))).otherwise(F.concat((11 + p % 19).cast("string"), F.lit("-"), digits(p * 7919)))
    c = F.when(s % 50 == 1, "291210").otherwise(F.concat((11 + s % 19).cast("string"), digits(s * 13)))
    pattern = F.when(s % 4 == 0, F.concat(F.substring(c, 1, 4), F.lit("XX"))).when(s % 4 == 1, F.concat(F.substring(c, 1, 5), F.lit("0"))).when(s % 4 == 2, F.concat(F.substring(c, 1, 3), F.lit("Y00"))).otherwise(c)
    return joins.covering_code(t.part.select("p_partkey", soc.alias("soc")), t.supplier.select(pattern.alias("pattern")), "soc", "pattern")


_PROFILE = "SELECT CASE s_suppkey % 5 WHEN 0 THEN lpad((s_suppkey * 3 % 90 + 10)::VARCHAR, 2, '0') || 'MS' WHEN 1 THEN (s_suppkey * 7 % 900 + 100)::VARCHAR || 'Z' ELSE (s_suppkey * 11 % 90000 + 10000)::VARCHAR END AS code, s_suppkey AS workers, 1 + s_suppkey % 3 AS n, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS pay FROM supplier"


@query(f"""WITH t AS (SELECT *, regexp_extract(code, '^(\\d+)', 1) AS d FROM ({_PROFILE})), k AS (SELECT DISTINCT lpad((c_custkey * 17 % 10000)::VARCHAR, 4, '0') AS naics4 FROM customer),
f AS (SELECT naics4, code, workers, n, pay, CASE WHEN length(d) >= 4 THEN 4 ELSE length(d) END AS lv FROM k JOIN t ON (length(d) >= 4 AND d[1:4] = naics4) OR (length(d) IN (2, 3) AND starts_with(naics4, d))),
b AS (SELECT *, max(lv) OVER (PARTITION BY naics4) AS top FROM f)
SELECT naics4, string_agg(code, ';' ORDER BY code) AS codes, sum(workers)::DOUBLE AS workers, sum(n)::BIGINT AS n, round(sum(pay * workers) / sum(workers) FILTER (WHERE pay IS NOT NULL), 4) AS pay, any_value(top) < 4 AS coarse FROM b WHERE lv = top GROUP BY 1""")
def industry_profiles(t):
    s = F.col("s_suppkey")
    code = F.when(s % 5 == 0, F.concat((s * 3 % 90 + 10).cast("string"), F.lit("MS"))).when(s % 5 == 1, F.concat((s * 7 % 900 + 100).cast("string"), F.lit("Z"))).otherwise((s * 11 % 90000 + 10000).cast("string"))
    table = t.supplier.select(code.alias("code"), s.alias("workers"), (1 + s % 3).alias("n"), F.when(s % 7 != 0, F.col("s_acctbal")).alias("pay"))
    keys = t.customer.select(F.lpad((F.col("c_custkey") * 17 % 10000).cast("string"), 4, "0").alias("naics4"))
    return joins.profiles(keys, table, "naics4", "code", "workers", "n", ["pay"]).withColumn("pay", F.round("pay", 4))


@query("""WITH c AS (SELECT o_orderkey, lpad((o_custkey % 2000)::VARCHAR, 4, '0') AS code FROM orders), k AS (SELECT DISTINCT substr(lpad((c_custkey % 2000)::VARCHAR, 4, '0'), 1, 2 + (c_custkey % 3)::INTEGER) AS key FROM customer),
m AS (SELECT o_orderkey, key, length(key) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(key) DESC) AS r FROM c JOIN k ON starts_with(code, key))
SELECT o_orderkey, code, key AS value, n::INTEGER AS matched FROM c LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (o_orderkey)""")
def prefix_fallback_join(t):
    code = lambda c: F.lpad((F.col(c) % 2000).cast("string"), 4, "0")
    table = t.customer.select(F.substring(code("c_custkey"), F.lit(1), (2 + F.col("c_custkey") % 3).cast("int")).alias("key")).distinct().withColumn("value", F.col("key"))
    return joins.longest_prefix(t.orders.select("o_orderkey", code("o_custkey").alias("code")), table, "code", "key", [4, 3, 2], "value")


@query("""WITH c AS (SELECT o_orderkey, lpad((o_custkey % 2000)::VARCHAR, 4, '0') AS code FROM orders), k AS (SELECT DISTINCT substr(lpad((c_custkey % 2000)::VARCHAR, 4, '0'), 1, 2 + (c_custkey % 3)::INTEGER) AS key FROM customer),
m AS (SELECT o_orderkey, key, length(key) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(key) DESC) AS r FROM c JOIN k ON starts_with(code, key))
SELECT o_orderkey, code, key AS value, n::INTEGER AS matched FROM c LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (o_orderkey)""")
def prefix_fallback_whole(t):
    """The longest prefix over the whole lookup table."""
    code = lambda c: F.lpad((F.col(c) % 2000).cast("string"), 4, "0")
    table = t.customer.select(F.substring(code("c_custkey"), F.lit(1), (2 + F.col("c_custkey") % 3).cast("int")).alias("key")).distinct().withColumn("value", F.col("key"))
    return joins.longest_prefix(t.orders.select("o_orderkey", code("o_custkey").alias("code")), table, "code", "key", [4, 3, 2], "value")


_FLOW = """SELECT s_nationkey AS origin, c_nationkey AS dest, year(l_shipdate)::INTEGER AS yr, count(*) AS returns, sum(l_extendedprice) AS agi FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"""


def flows(t):
    """Supplier nation to customer nation by ship year."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", F.year("l_shipdate").alias("yr")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("dest")), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("origin")), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("origin", "dest", "yr").agg(F.count(F.lit(1)).alias("returns"), F.sum("l_extendedprice").alias("agi"))


@query(f"""WITH f AS ({_FLOW}), a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT yr, round(sum((d.v - o.v) * returns) / sum(returns), 4) AS shift, round(sum((d.v - o.v) * agi) / sum(agi), 4) AS shift_income FROM f JOIN a o ON origin = o.k JOIN a d ON dest = d.k WHERE origin <> dest GROUP BY 1""")
def flow_attribute_shift(t):
    a = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    f = flows(t).filter("origin <> dest").join(a.toDF("origin", "vo"), "origin").join(a.toDF("dest", "vd"), "dest").withColumn("d", F.col("vd") - F.col("vo"))
    return f.groupBy("yr").agg(F.round(panels.weighted_mean(F.col("d"), F.col("returns")), 4).alias("shift"), F.round(panels.weighted_mean(F.col("d"), F.col("agi")), 4).alias("shift_income"))


@query("SELECT r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def bridge_rollup(t):
    up = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(up, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer""")
def union_tagged(t):
    a = t.orders.filter("o_orderstatus = 'F'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(t.customer.select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("SELECT count(*) FILTER (WHERE a AND b) AS both_sources, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM (SELECT l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)")
def source_overlap(t):
    by = t.lineitem.filter("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n"), F.min("l_returnflag").alias("f"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return by.agg(n(F.col("n") == 2).alias("both_sources"), n((F.col("n") == 1) & (F.col("f") == "R")).alias("only_a"), n((F.col("n") == 1) & (F.col("f") == "A")).alias("only_b"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_new_docs(t):
    from panelspark.operators.tasks import unseen

    return unseen(t.documents, t.labels, "doc_id").select("doc_id")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_first_publication(t):
    # the hash stands for the text in the shuffle; min_by keeps the one row that is wanted
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("x")).select("x.*")


@query("""SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC) AS r FROM lineitem) WHERE r = 1""")
def prefer_source_rank(t):
    r = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") == "R").desc()))
    return t.lineitem.select("l_orderkey", "l_suppkey", r.alias("r")).filter("r = 1").select("l_orderkey", "l_suppkey").distinct()


@query("SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, md5(text) DESC) AS r FROM conversations) WHERE r = 1")
def longest_text_per_key(t):
    return t.conversations.groupBy("conv_id").agg(F.max_by("text", F.struct(F.length("text"), F.md5(F.col("text").cast("binary")))).alias("text"))


@query(f"WITH f AS ({_FLOW}) SELECT origin, dest, sum(returns)::BIGINT AS n FROM f WHERE origin <> dest GROUP BY 1, 2 ORDER BY n DESC, origin, dest LIMIT 15")
def topk_corridors(t):
    return flows(t).filter("origin <> dest").groupBy("origin", "dest").agg(F.sum("returns").alias("n")).orderBy(F.desc("n"), "origin", "dest").limit(15)


@query("SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5")
def topk_per_group(t):
    r = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.withColumn("r", r).filter("r <= 5").select("p_type", "p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders WHERE o_orderstatus = 'F')")
def latest_slice(t):
    last = yearly(t).filter("o_orderstatus = 'F'").agg(F.max("yr").alias("yr"))
    return yearly(t).join(F.broadcast(last), "yr").select("o_orderkey", "o_orderdate")  # one row


@query("""WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), c AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem), last AS (SELECT max(y) AS m FROM d),
f AS (SELECT cited, count(*) AS n, count(*) FILTER (WHERE a.y - b.y BETWEEN 0 AND 2) AS n2 FROM c JOIN d a ON citing = a.o_orderkey JOIN d b ON cited = b.o_orderkey GROUP BY 1), b AS (SELECT citing, count(*) AS n FROM c GROUP BY 1)
SELECT o_orderkey, coalesce(b.n, 0) AS back, coalesce(f.n, 0) AS forward, CASE WHEN y + 2 <= m THEN coalesce(f.n2, 0) END AS forward2 FROM d CROSS JOIN last LEFT JOIN f ON cited = o_orderkey LEFT JOIN b ON citing = o_orderkey""")
def citation_counts(t):
    """An order cites the orders whose keys are its parts' keys. Forward counts need both ends; a window that is not over is unknown."""
    d = yearly(t).select("o_orderkey", "yr")
    c = t.lineitem.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).distinct()
    both = c.join(d.toDF("citing", "y1"), "citing").join(d.toDF("cited", "y0"), "cited")
    forward = both.groupBy(F.col("cited").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("f"), F.count_if((F.col("y1") - F.col("y0")).between(0, 2)).alias("f2"))
    back = c.groupBy(F.col("citing").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("b"))
    last = d.agg(F.max("yr").alias("m"))  # one row
    zero = lambda x: F.coalesce(x, F.lit(0))
    return d.join(forward, "o_orderkey", "left").join(back, "o_orderkey", "left").join(F.broadcast(last), F.lit(True)).select("o_orderkey", zero("b").alias("back"), zero("f").alias("forward"), F.when(F.col("yr") + 2 <= F.col("m"), zero("f2")).alias("forward2"))
