"""Queries on windows, linkage, texts, statistics, graphs and panels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import codes, names
from panelspark.operators import ladder, linkage, nearest, novelty, panels, ranks, resampling, spatial, stats, tasks
from panelspark.plans.aggregates import _YEARLY, PARTIES, customer_years, parties
from panelspark.plans.joins import _FLOW, flows, yearly
from panelspark.plans.registry import query
from panelspark.sources.staging import staged


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey), 6) AS share, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def share_of_group(t):
    a = panels.share_of_group(t.lineitem, ["l_orderkey"])
    return panels.share_of_group(a, ["l_orderkey"], "weight", F.col("l_quantity")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("share", 6).alias("share"), F.round("weight", 6).alias("weight"))


@query("WITH m AS (SELECT event_type AS dest, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS origin FROM events) SELECT origin, dest, count(*) AS moves FROM m WHERE origin <> dest GROUP BY 1, 2")
def entity_moves(t):
    return novelty.moves(t.events, "user_id", "event_type", "ts", "event_id")


_DOCS = """d AS (SELECT o_custkey, o_orderkey, year(o_orderdate)::INTEGER AS yr FROM orders), a AS (SELECT DISTINCT o_custkey, yr, p_type FROM d JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT o_custkey, yr, o_orderkey, arg_min(p_type, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS p_type FROM d JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def firm_docs(t):
    lines = yearly(t).select("o_custkey", "o_orderkey", "yr").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = staged(lines.select("o_custkey", "yr", "o_orderkey", "p_type", *order), "firm-lines")  # read for main and for all classes
    main = lines.groupBy("o_custkey", "yr", "o_orderkey").agg(F.min_by("p_type", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).alias("p_type"))
    return main.withColumn("share", F.lit(1.0)), lines.select("o_custkey", "yr", "p_type")


@query(f"""WITH {_DOCS}, n AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = m.o_custkey AND a.p_type = m.p_type AND a.yr BETWEEN m.yr - 2 AND m.yr - 1) AS fresh FROM m),
c AS (SELECT o_custkey, yr, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.o_custkey = a.o_custkey AND b.p_type = a.p_type AND b.yr BETWEEN a.yr - 2 AND a.yr - 1)) AS nc FROM a GROUP BY 1, 2)
SELECT o_custkey, yr, count(*)::DOUBLE AS docs, CASE WHEN yr >= (SELECT min(yr) + 2 FROM m) THEN (count(*) FILTER (WHERE fresh))::DOUBLE END AS explore, CASE WHEN yr >= (SELECT min(yr) + 2 FROM m) THEN any_value(nc) END AS new_classes FROM n JOIN c USING (o_custkey, yr) GROUP BY 1, 2""")
def explore_new_class(t):
    main, every = firm_docs(t)
    return novelty.exploration(main, every, "o_custkey", "yr", "p_type", "share", 2)


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, yr, n, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY yr RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM y")
def prior_activity(t):
    return customer_years(t).select("o_custkey", "yr", "n", F.coalesce(F.sum("n").over(panels.years_before(["o_custkey"], "yr", 3)), F.lit(0)).alias("prior"))


@query("""WITH c AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, l_partkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey, l_partkey ORDER BY yr RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS prior FROM c)
SELECT o_custkey, yr, round(sum(n * prior) / sum(n)::DOUBLE, 6) AS depth, round(sum(CASE WHEN prior = 0 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS scope FROM p GROUP BY 1, 2""")
def search_depth_scope(t):
    cites = yearly(t).select("o_custkey", "o_orderkey", "yr").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return novelty.search(cites, "o_custkey", "yr", "l_partkey", 5).select("o_custkey", "yr", F.round("depth", 6).alias("depth"), F.round("scope", 6).alias("scope"))


@query("SELECT p_partkey, p_type, round(percent_rank() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey), 6) AS pct FROM part")
def percentile_in_group(t):
    rows = panels.percentile(t.part.select("p_partkey", "p_type", "p_retailprice"), "p_type", ["p_retailprice", "p_partkey"], "pct")
    return rows.select("p_partkey", "p_type", F.round("pct", 6).alias("pct"))


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, yr, round((v - avg(v) OVER (PARTITION BY yr)) / stddev_samp(v) OVER (PARTITION BY yr), 5) + 0.0 AS z, round(v - avg(v) OVER (PARTITION BY o_custkey), 4) + 0.0 AS demeaned FROM y")
def zscore_in_year(t):
    z = panels.standardised(customer_years(t), "yr", "v", "z")
    return z.select("o_custkey", "yr", (F.round("z", 5) + 0.0).alias("z"), (F.round(F.col("v") - F.avg("v").over(Window.partitionBy("o_custkey")), 4) + 0.0).alias("demeaned"))


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, yr, ntile(5) OVER (PARTITION BY yr ORDER BY v, o_custkey)::INTEGER AS fifth FROM y")
def ntile_by_year(t):
    return panels.ntile(customer_years(t).select("o_custkey", "yr", "v"), "yr", ["v", "o_custkey"], 5, "fifth").select("o_custkey", "yr", "fifth")


@query(f"WITH y AS ({_YEARLY}), q AS (SELECT yr, list_distinct(quantile_cont(n::DOUBLE, [0.2, 0.4, 0.6, 0.8])) AS e FROM y GROUP BY 1) SELECT o_custkey, yr, (len(list_filter(e, lambda x: x < n)) + 1)::INTEGER AS fifth FROM y JOIN q USING (yr)")
def quantile_cut(t):
    return ranks.quantile_class(customer_years(t).withColumn("x", F.col("n").cast("double")), "yr", "x", 5, "fifth").select("o_custkey", "yr", "fifth")


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS k FROM events)
SELECT event_id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM e""")
def ffill_bfill(t):
    e = t.events.select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("k"))
    return panels.filled(e, "user_id", "at", "k", "state").select("event_id", "state")


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, yr, round(lag(v) OVER (PARTITION BY o_custkey ORDER BY yr), 2) AS before FROM y")
def lag_one_year(t):
    return customer_years(t).select("o_custkey", "yr", F.round(F.lag("v").over(Window.partitionBy("o_custkey").orderBy("yr")), 2).alias("before"))


_P = "SELECT p_brand, 1.0::DOUBLE / (1 + sum(p_size) % 97) AS p FROM part GROUP BY 1"


@query(f"WITH p AS ({_P}), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_brand) AS raw, row_number() OVER (ORDER BY p, p_brand) AS k FROM p) SELECT p_brand, round(p, 8) AS p, round(least(1.0, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r")
def bh_qvalues(t):
    p = t.part.groupBy("p_brand").agg((1.0 / (1 + F.sum("p_size") % 97)).alias("p"))
    return panels.q_values(p, "p", "p_brand").select("p_brand", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, round(arg_max(v, yr) - arg_min(v, yr), 2) AS change, min(yr) AS first, max(yr) AS last, round(max(v) FILTER (WHERE yr = 1999) / max(v) FILTER (WHERE yr = 1996) - 1, 6) AS growth FROM y GROUP BY 1")
def endpoint_change(t):
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("v")))
    return customer_years(t).groupBy("o_custkey").agg(F.round(F.max_by("v", "yr") - F.min_by("v", "yr"), 2).alias("change"), F.min("yr").alias("first"), F.max("yr").alias("last"), F.round(at(1999) / at(1996) - 1, 6).alias("growth"))


# ---------------------------------------------------------------- linkage

def _left(t):
    return t.customer.select("c_custkey", names.company(F.concat(F.lit("The Firm "), (F.col("c_custkey") % 400).cast("string"), F.lit(" Inc."))).alias("name"))


def _right(t):
    return t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), names.company(F.concat(F.lit("firm "), (F.col("s_suppkey") % 80).cast("string"), F.lit(" co"))).alias("name"))


_LINK = "l AS (SELECT c_custkey, 'firm ' || (c_custkey % 400) AS name FROM customer), r AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, 'firm ' || (s_suppkey % 80) AS name FROM supplier)"


@query(f"WITH {_LINK}, k AS (SELECT name, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(DISTINCT code) > 1 AS m FROM r GROUP BY 1) SELECT c_custkey, codes, coalesce(m, false) AS ambiguous FROM l LEFT JOIN k USING (name)")
def name_link_exact(t):
    return linkage.exact(_left(t), _right(t), "name", "code").select("c_custkey", F.array_join("codes", ",").alias("codes"), "ambiguous")


#: Spans of units and candidates, some without a year, some that never meet.
_SPANS = "1995 + c_custkey % 4 AS y0, CASE WHEN c_custkey % 13 <> 0 THEN 1997 + c_custkey % 5 END AS y1, CASE WHEN code::INTEGER % 5 <> 0 THEN 1989 + code::INTEGER % 17 END AS f0, 1991 + code::INTEGER % 17 + code::INTEGER % 3 AS f1"


@query(f"""WITH {_LINK}, p AS (SELECT c_custkey, code, {_SPANS} FROM l JOIN r USING (name)),
o AS (SELECT *, CASE WHEN y0 IS NULL OR y1 IS NULL OR f0 IS NULL OR f1 IS NULL THEN NULL WHEN y1 < f1 THEN y1 ELSE f1 END AS e, CASE WHEN y0 > f0 THEN y0 ELSE f0 END AS s FROM p),
k AS (SELECT c_custkey, code, CASE WHEN e IS NULL THEN 1 WHEN e - s >= 0 THEN 0 ELSE 2 END AS c, CASE WHEN e IS NULL THEN 0 WHEN e - s >= 0 THEN -e ELSE s - e END AS a, CASE WHEN e - s >= 0 THEN s - e ELSE 0 END AS b FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c, a, b, code) AS r, count(*) OVER (PARTITION BY c_custkey) AS candidates FROM (SELECT DISTINCT * FROM k)) SELECT c_custkey, code, candidates FROM n WHERE r = 1""")
def name_link_by_years(t):
    c, k = F.col("c_custkey"), F.col("code").cast("int")
    left = _left(t).select("c_custkey", "name", (1995 + c % 4).alias("y0"), F.when(c % 13 != 0, 1997 + c % 5).alias("y1"))
    right = _right(t).select("code", "name", F.when(k % 5 != 0, 1989 + k % 17).alias("f0"), (1991 + k % 17 + k % 3).alias("f1"))
    return linkage.name_by_years(left, right, "name", "c_custkey", "code", "y0", "y1", "f0", "f1")


@query()
def name_link_fuzzy(t):
    left = t.part.select(names.company(F.concat("p_name", F.lit(" works"))).alias("name"))
    right = t.part.select(names.company(F.concat("p_name", F.lit(" workz"))).alias("name"), F.col("p_partkey").cast("string").alias("code")).groupBy("name").agg(F.min("code").alias("code"))
    return linkage.fuzzy(left, right, "name", "code", 90.0)


@query()
def title_link_cascade(t):
    left = t.part.select(names.title(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " senior").otherwise(""))).alias("title"))
    right = t.part.select(names.title(F.col("p_name")).alias("title"), F.col("p_brand").alias("code"))
    return linkage.title_cascade(left, right, "title", "code")


@query("""WITH l AS (SELECT s_suppkey AS k, 'city' || (s_suppkey % 30) AS f, ['city' || (s_suppkey % 30), 'city' || (s_suppkey % 7)] AS cs, 'S' || (s_suppkey % 3) AS st FROM supplier), r AS (SELECT c_custkey AS code, 'city' || (c_custkey % 40) AS f, ['city' || (c_custkey % 40), 'city' || (c_custkey % 11)] AS cs, 'S' || (c_custkey % 3) AS st FROM customer),
p AS (SELECT DISTINCT k, code, max(CASE WHEN l.f = r.f THEN 3 ELSE 2 END) OVER (PARTITION BY k, code) AS s FROM l JOIN r ON l.st = r.st AND len(list_intersect(l.cs, r.cs)) > 0), b AS (SELECT k, code, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, code) AS n FROM p)
SELECT k, code, coalesce(s, 0)::INTEGER AS score FROM l LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (k)""")
def place_match_cascade(t):
    city = lambda c, n: F.concat(F.lit("city"), (F.col(c) % n).cast("string"))
    state = lambda c: F.array(F.concat(F.lit("S"), (F.col(c) % 3).cast("string")))
    left = t.supplier.select(F.col("s_suppkey").alias("k"), F.array(city("s_suppkey", 30), city("s_suppkey", 7)).alias("cities"), state("s_suppkey").alias("states"))
    right = t.customer.select(F.col("c_custkey").alias("code"), F.array(city("c_custkey", 40), city("c_custkey", 11)).alias("cities"), state("c_custkey").alias("states"))
    return linkage.place_cascade(left, right, "k", "code")


@query("""WITH l AS (SELECT s_suppkey AS k, ['city' || (s_suppkey * 13 % 60), 'city' || (s_suppkey * 17 % 90)] AS cs, 'S' || (s_suppkey % 3) AS st, s_suppkey * 3 AS own FROM supplier), r AS (SELECT c_custkey AS code, ['city' || (c_custkey % 40), 'city' || (c_custkey % 11)] AS cs, 'S' || (c_custkey % 3) AS st FROM customer),
pc AS (SELECT c_custkey AS code, 'city' || (40 + c_custkey % 47) AS city, 'S' || (c_custkey % 3) AS st FROM customer WHERE c_custkey % 5 = 0), kn AS (SELECT code, unnest(cs) AS city FROM r UNION SELECT code, city FROM pc),
p AS (SELECT k, 4 AS s, code FROM l JOIN kn ON own = code AND list_contains(cs, city) UNION ALL SELECT k, CASE WHEN l.cs[1] = r.cs[1] THEN 3 ELSE 2 END, code FROM l JOIN r ON l.st = r.st AND len(list_intersect(l.cs, r.cs)) > 0),
o AS (SELECT k, i, min(code) AS code FROM (SELECT k, st, unnest(cs) AS city, generate_subscripts(cs, 1) AS i FROM l) JOIN pc USING (st, city) GROUP BY 1, 2 HAVING count(DISTINCT code) = 1), u AS (SELECT * FROM p UNION ALL SELECT k, 1, arg_min(code, i) FROM o GROUP BY 1),
b AS (SELECT k, code, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, code) AS n FROM u) SELECT k, code, coalesce(s, 0)::INTEGER AS score FROM l LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (k)""")
def place_match_levels(t):
    """All levels of the cascade over the whole customer table."""
    city = lambda n: F.concat(F.lit("city"), n.cast("string"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    state = lambda k: F.concat(F.lit("S"), (k % 3).cast("string"))
    left = t.supplier.select(s.alias("k"), F.array(city(s * 13 % 60), city(s * 17 % 90)).alias("cities"), F.array(state(s)).alias("states"), (s * 3).alias("own"))
    right = t.customer.select(c.alias("code"), F.array(city(c % 40), city(c % 11)).alias("cities"), F.array(state(c)).alias("states"))
    principal = t.customer.filter(c % 5 == 0).select(c.alias("code"), city(40 + c % 47).alias("city"), state(c).alias("state"))
    return linkage.place_cascade(left, right, "k", "code", own="own", principal=principal)


@query("""SELECT o_orderkey, CASE WHEN m = 'exact' AND r BETWEEN 0.5 AND 2 THEN 'high' WHEN m = 'exact' OR (s >= 95 AND r BETWEEN 0.5 AND 2) THEN 'medium' ELSE 'low' END AS tier FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'exact' ELSE 'fuzzy' END AS m, o_totalprice / 150000 AS r, 90 + o_custkey % 10 AS s FROM orders)""")
def match_tiers(t):
    return t.orders.select("o_orderkey", linkage.tier(F.when(F.col("o_orderstatus") == "F", "exact").otherwise("fuzzy"), F.col("o_totalprice") / 150000, 90 + F.col("o_custkey") % 10).alias("tier"))


@query("""SELECT c_custkey, first, last, code FROM (SELECT c_custkey, (1990 + c_custkey % 9)::INTEGER AS first, CASE WHEN c_custkey % 4 = 0 THEN 2005 ELSE (1990 + c_custkey % 9 + c_custkey % 5 - 1)::INTEGER END AS last, 'a' || c_custkey AS code FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 >= 1
UNION ALL SELECT c_custkey, (1990 + c_custkey % 9)::INTEGER, NULL, 'a' || c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 2001, 2003, 'b' || c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def spells_wide_to_long(t):
    k = F.col("c_custkey")
    wide = t.customer.select("c_custkey", (1990 + k % 9).cast("int").alias("f1"), F.when(k % 4 == 0, 2005).otherwise((k % 5).cast("int")).alias("n1"), F.concat(F.lit("a"), k.cast("string")).alias("c1"),
                             F.lit(2001).alias("f2"), F.lit(3).alias("n2"), F.when(k % 3 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("c2"))
    return linkage.spells(wide, ["c_custkey"], [("f1", "n1", "c1"), ("f2", "n2", "c2")])


@query("""WITH own AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS yr, 'owner' AS method FROM orders WHERE o_custkey % 3 = 0), last AS (SELECT max(yr) AS y FROM own WHERE yr < 1999)
SELECT * FROM own UNION ALL SELECT o_orderkey, year(o_orderdate)::INTEGER, 'name' FROM orders, last WHERE o_custkey % 2 = 0 AND year(o_orderdate) > y AND o_orderkey NOT IN (SELECT o_orderkey FROM own)""")
def fill_unlinked_after(t):
    y = yearly(t).select("o_orderkey", "o_custkey", "yr")
    own = y.filter("o_custkey % 3 = 0").select("o_orderkey", "yr", F.lit("owner").alias("method"))
    last = own.filter("yr < 1999").agg(F.max("yr").alias("__y"))
    fill = y.filter("o_custkey % 2 = 0").join(own, "o_orderkey", "left_anti").join(F.broadcast(last), F.col("yr") > F.col("__y")).select("o_orderkey", "yr", F.lit("name").alias("method"))  # one row
    return own.unionByName(fill)


@query("""WITH app AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS gvkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F')
SELECT *, round(1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey, l_linenumber), 6) AS share FROM app""")
def inherit_link(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    granted = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*key, F.col("o_custkey").alias("gvkey"))
    named = t.lineitem.filter("l_returnflag <> 'R' and l_linestatus = 'F'").select(*key, F.col("l_suppkey").alias("gvkey"))
    return panels.share_of_group(granted.unionByName(named).distinct(), ["l_orderkey", "l_linenumber"]).withColumn("share", F.round("share", 6))


@query("""WITH d AS (SELECT o_custkey % 500 AS name, min(o_clerk) AS code FROM (SELECT o_custkey, o_orderpriority AS o_clerk, o_orderdate FROM orders) WHERE year(o_orderdate) <= 1998 GROUP BY 1), x AS (SELECT o_custkey % 500 AS name, o_orderpriority AS truth FROM orders WHERE year(o_orderdate) BETWEEN 1999 AND 2000)
SELECT count(*) AS total, count(code) AS matched, count(*) FILTER (WHERE code = truth) AS agree, round(count(code) / count(*)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE code = truth) / count(code)::DOUBLE, 6) AS agreement FROM x LEFT JOIN d USING (name)""")
def link_holdout_eval(t):
    y = yearly(t).withColumn("name", F.col("o_custkey") % 500)
    d = y.filter("yr <= 1998").groupBy("name").agg(F.min("o_orderpriority").alias("code"))
    x = y.filter("yr between 1999 and 2000").join(d, "name", "left")
    s = x.agg(F.count(F.lit(1)).alias("total"), F.count("code").alias("matched"), F.count_if(F.col("code") == F.col("o_orderpriority")).alias("agree"))
    return s.select("*", F.round(F.col("matched") / F.col("total"), 6).alias("recall"), F.round(F.try_divide(F.col("agree"), F.col("matched")), 6).alias("agreement"))


@query("SELECT 'documents to labels' AS step, 'documents' AS unit, count(toxic) AS matched, count(*) AS total, count(toxic) / count(*)::DOUBLE AS share FROM documents LEFT JOIN labels USING (doc_id)")
def match_rate_report(t):
    return panels.match_rate(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), F.col("toxic").isNotNull(), "documents to labels", "documents")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def grain_check(t):
    return panels.grain_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


_EXAMPLES = "(SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3))"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(({c} IS NOT NULL)::INTEGER) AS filled, count(DISTINCT {c}) AS \"distinct\", count(try_cast({c}::VARCHAR AS DOUBLE)) / nullif(count({c}), 0)::DOUBLE AS numeric, {_EXAMPLES.format(c=c)} AS examples FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def column_profile(t):
    return panels.column_profile(t.customer)


# ---------------------------------------------------------------- texts and tasks

@query("SELECT doc_id, coalesce(toxic, CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END) = 1 AS label, toxic IS NOT NULL AS modelled FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT item_id + 1000000000, false, false FROM benchmark")
def label_universe(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", (F.coalesce("toxic", F.contains("text", F.lit("!!")).cast("int")) == 1).alias("label"), F.col("toxic").isNotNull().alias("modelled"))
    return d.unionByName(t.benchmark.select((F.col("item_id") + 1000000000).alias("doc_id"), F.lit(False).alias("label"), F.lit(False).alias("modelled")))


_STOP = ", ".join(f"'{w}'" for w in tasks.STOP)
_PAIRS = """(SELECT DISTINCT {key}, w[i] AS first, w[i + 1] AS second FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN (""" + _STOP + """)) AS w FROM {table})))"""


@query(f"SELECT first, second, count(*) AS docs FROM {_PAIRS.format(key='doc_id', table='documents')} GROUP BY 1, 2 HAVING count(*) >= 3")
def text_word_pairs(t):
    return tasks.word_pairs(t.documents, ["doc_id"], "text").groupBy("first", "second").agg(F.count(F.lit(1)).alias("docs")).filter("docs >= 3")


def _importance(t):
    item = F.col("item_id")
    raw = t.benchmark.select(item.alias("task"), (item % 10).alias("soc"), F.when(item % 4 != 0, 1.0 + item % 5).alias("im"))
    own = F.avg("im").over(Window.partitionBy("soc"))
    return raw.select("task", "soc", F.coalesce("im", own, F.lit(1.0)).alias("importance"))


_IMPORTANCE = "SELECT task, soc, coalesce(im, avg(im) OVER (PARTITION BY soc), 1.0) AS importance FROM (SELECT item_id AS task, item_id % 10 AS soc, CASE WHEN item_id % 4 <> 0 THEN 1.0::DOUBLE + item_id % 5 END AS im FROM benchmark)"


@query(f"SELECT task, soc, round(importance, 6) AS importance FROM ({_IMPORTANCE})")
def importance_fallback(t):
    return _importance(t).withColumn("importance", F.round("importance", 6))


@query(f"""WITH i AS ({_IMPORTANCE}), tp AS (SELECT item_id AS task, first, second FROM {_PAIRS.format(key='item_id', table='benchmark')}), dp AS {_PAIRS.format(key='doc_id', table='documents')}, n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM dp),
s AS (SELECT first, second, count(*) / any_value(n) AS share FROM dp, n GROUP BY 1, 2), e AS (SELECT task, sum(share) AS e FROM tp JOIN s USING (first, second) GROUP BY 1)
SELECT soc, round(sum(coalesce(e, 0) * importance) / sum(importance), 6) AS exposure, count(e) AS matched, count(*) AS tasks, round(percent_rank() OVER (ORDER BY round(sum(coalesce(e, 0) * importance) / sum(importance), 6), soc), 6) AS pct FROM i LEFT JOIN e USING (task) GROUP BY 1""")
def task_exposure(t):
    wanted = tasks.word_pairs(t.benchmark.withColumnRenamed("item_id", "task"), ["task"], "text")
    share = tasks.pair_document_shares(t.documents, wanted, "text")
    e = wanted.join(share, ["first", "second"]).groupBy("task").agg(F.sum("share").alias("e"))
    unit = _importance(t).join(e, "task", "left").groupBy("soc").agg(F.round(F.sum(F.coalesce("e", F.lit(0.0)) * F.col("importance")) / F.sum("importance"), 6).alias("exposure"), F.count("e").alias("matched"), F.count(F.lit(1)).alias("tasks"))
    return panels.percentile(unit, None, ["exposure", "soc"], "pct").withColumn("pct", F.round("pct", 6))


_INCIDENCE = f"""WITH i AS ({_IMPORTANCE}), tp AS (SELECT task, soc, importance / sum(importance) OVER (PARTITION BY soc) AS w, first, second FROM i JOIN (SELECT item_id AS task, first, second FROM {_PAIRS.format(key='item_id', table='benchmark')}) USING (task)),
g AS (SELECT first, second FROM tp GROUP BY 1, 2 HAVING count(DISTINCT soc) <= 2), touch AS (SELECT DISTINCT doc_id, soc, task, importance AS w FROM {_PAIRS.format(key='doc_id', table='documents')} JOIN (SELECT task, soc, importance, first, second FROM i JOIN (SELECT item_id AS task, first, second FROM {_PAIRS.format(key='item_id', table='benchmark')}) USING (task)) USING (first, second) JOIN g USING (first, second)),
s AS (SELECT doc_id, soc, sum(w) / sum(sum(w)) OVER (PARTITION BY doc_id) AS share FROM touch GROUP BY 1, 2) """


def _incidence(t):
    units = tasks.word_pairs(t.benchmark.withColumnRenamed("item_id", "task"), ["task"], "text").join(_importance(t), "task")
    return tasks.incidence(tasks.word_pairs(t.documents, ["doc_id"], "text"), units, "doc_id", "soc", "importance", 2)


@query(_INCIDENCE + "SELECT doc_id, soc, round(share, 6) AS share FROM s")
def doc_unit_incidence(t):
    return _incidence(t).withColumn("share", F.round("share", 6))


@query(_INCIDENCE + "SELECT soc, (doc_id % 5)::BIGINT AS yr, round(sum(share), 5) AS incidence FROM s GROUP BY 1, 2")
def incidence_year(t):
    return _incidence(t).groupBy("soc", (F.col("doc_id") % 5).alias("yr")).agg(F.round(F.sum("share"), 5).alias("incidence"))


# ---------------------------------------------------------------- statistics

@query("""WITH m AS (SELECT l_returnflag AS g, sum(l_discount * l_quantity) / sum(l_quantity) AS mx, sum(l_tax * l_quantity) / sum(l_quantity) AS my FROM lineitem GROUP BY 1)
SELECT g, round(sum(l_quantity * (l_discount - mx) * (l_tax - my)) / sqrt(sum(l_quantity * (l_discount - mx) * (l_discount - mx)) * sum(l_quantity * (l_tax - my) * (l_tax - my))), 6) AS r, count(*) AS n FROM lineitem JOIN m ON l_returnflag = g GROUP BY 1""")
def weighted_corr_by_group(t):
    return stats.weighted_corr(t.lineitem.withColumnRenamed("l_returnflag", "g"), ["g"], "l_discount", "l_tax", "l_quantity").withColumn("r", F.round("r", 6))


@query("""WITH r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT p_type, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def rank_corr(t):
    return ranks.rank_corr(t.part, "p_type", "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


@query()
def bootstrap_ci(t):
    """Intervals of a weighted mean, correlation and slope over the same draws."""
    wanted = {"mean": resampling.mean("l_extendedprice"), "correlation": resampling.correlation("l_discount", "l_extendedprice"), "slope": resampling.slope("l_extendedprice", "l_discount")}
    return resampling.bootstrap(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_discount", "l_extendedprice"], wanted, weight="l_quantity")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, count(*) AS n FROM lineitem")
def ols_one_regressor(t):
    fit = stats.least_squares(t.lineitem, "l_extendedprice", ["l_quantity"])
    a, b = (x[1] for x in fit["terms"])
    return t.lineitem.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(b), 4).alias("slope"), F.round(F.lit(a), 3).alias("intercept"), "n")


def _fit_sql(table: str, y: str, xs: list[str], *, w: str = "1.0", p: str = "0", g: str = "0", cl: str, least: int | None = None) -> str:
    """SQL (p, term, estimate, se, t, r2, n) of a weighted regression for each p: regressors in standard deviations, group means of
    g taken out, normal equations solved by cofactors, errors clustered by cl."""
    k = len(xs)
    each = range(k)

    def det(m: list[list[str]]) -> str:
        return m[0][0] if len(m) == 1 else "(" + " + ".join(f"({'-' if j % 2 else ''}{m[0][j]}) * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"

    xx = [[f"a{min(i, j)}{max(i, j)}" for j in each] for i in each]
    cofactor = lambda i, j: f"(({'-1' if (i + j) % 2 else '1'}) * {det([[xx[r][c] for c in each if c != j] for r in each if r != i]) if k > 1 else '1.0'})"
    cols = [f"x{i}" for i in each]
    pairs = [(i, j) for i in each for j in range(i, k)]
    enough = f"n >= {k + 5 if least is None else least}"
    d = f"SELECT {p} AS p, {g} AS g, {cl} AS cl, ({w})::DOUBLE AS w, ({y})::DOUBLE AS y0, " + ", ".join(f"({x})::DOUBLE AS r{i}" for i, x in enumerate(xs)) + f" FROM {table}"
    d = f"SELECT * FROM ({d}) WHERE p IS NOT NULL AND g IS NOT NULL AND cl IS NOT NULL AND w IS NOT NULL AND y0 IS NOT NULL AND " + " AND ".join(f"r{i} IS NOT NULL" for i in each)
    z = "SELECT p, g, cl, w, y0, " + ", ".join(f"CASE WHEN bool_and(r{i} IN (0, 1)) OVER (PARTITION BY p) THEN r{i} ELSE (r{i} - avg(r{i}) OVER (PARTITION BY p)) / stddev_samp(r{i}) OVER (PARTITION BY p) END AS z{i}" for i in each) + " FROM d"
    m = "SELECT p, g, cl, w, y0, y0 - sum(w * y0) OVER q / sum(w) OVER q AS y, " + ", ".join(f"z{i} - sum(w * z{i}) OVER q / sum(w) OVER q AS x{i}" for i in each) + " FROM z WINDOW q AS (PARTITION BY p, g)"
    n = "SELECT p, count(*)::DOUBLE AS n, count(DISTINCT g) AS gs, count(DISTINCT cl) AS cs, sum(w * y0) / sum(w) AS ybar, " + ", ".join(f"sum(w * x{i} * x{j}) AS a{i}{j}" for i, j in pairs) + ", " + ", ".join(f"sum(w * x{i} * y) AS c{i}" for i in each) + " FROM m GROUP BY p"
    v = "SELECT *, " + ", ".join(f"{cofactor(j, i)} / {det(xx)} AS i{i}{j}" for i in each for j in each) + " FROM n"
    b = "SELECT *, " + ", ".join("(" + " + ".join(f"i{i}{j} * c{j}" for j in each) + f") AS b{i}" for i in each) + " FROM v"
    e = "SELECT m.*, m.w * (m.y - " + " - ".join(f"b{i} * x{i}" for i in each) + ") AS e, m.y - " + " - ".join(f"b{i} * x{i}" for i in each) + " AS u, ybar FROM m JOIN b USING (p)"
    sc = "SELECT p, cl, " + ", ".join(f"sum(e * x{i}) AS s{i}" for i in each) + " FROM e GROUP BY p, cl"
    mt = "SELECT p, " + ", ".join(f"sum(s{i} * s{j}) AS m{i}{j}" for i in each for j in each) + " FROM sc GROUP BY p"
    rs = "SELECT p, 1 - sum(e * u) / sum(w * (y0 - ybar) * (y0 - ybar)) AS r2 FROM e GROUP BY p"
    var = lambda i: "(" + " + ".join(f"i{i}{x} * m{x}{y2} * i{y2}{i}" for x in each for y2 in each) + ") * cs / (cs - 1.0) * (n - 1) / (n - " + str(k) + " - gs)"
    out = " UNION ALL ".join(f"SELECT p, {i} AS k, b{i} AS estimate, sqrt({var(i)}) AS se, r2, n FROM b JOIN mt USING (p) JOIN rs USING (p) WHERE {enough}" for i in each)
    return f"(WITH d AS ({d}), z AS ({z}), m AS ({m}), n AS ({n}), v AS ({v}), b AS ({b}), e AS ({e}), sc AS ({sc}), mt AS ({mt}), rs AS ({rs}) {out})"


_WLS = ["l_quantity", "l_discount", "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END"]


@query(f"SELECT CASE k WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' ELSE 'taxed' END AS term, round(estimate, 3) AS estimate, round(se, 3) AS se, round(estimate / se, 3) AS t, round(r2, 6) AS r2, n::BIGINT AS n FROM {_fit_sql('lineitem', 'l_extendedprice', _WLS, w='l_quantity', g='l_returnflag', cl='l_suppkey')}")
def wls_coefficients(t):
    rows = t.lineitem.withColumn("taxed", (F.col("l_tax") > 0.04).cast("int"))
    fit = stats.least_squares(rows, "l_extendedprice", ["l_quantity", "l_discount", "taxed"], weight="l_quantity", absorb=["l_returnflag"], cluster="l_suppkey", standardise=True)
    r = lambda c, n=3: F.round(c, n).alias(c)
    terms = t.spark.createDataFrame([x[:4] for x in fit["terms"]], "term string, estimate double, se double, t double")
    return terms.select("term", r("estimate"), r("se"), r("t"), F.round(F.lit(fit["r2"]), 6).alias("r2"), F.lit(fit["n"]).alias("n"))


#: Means of unit and year taken out in turn, to far below the digits that are compared.
_TWFE = """WITH RECURSIVE d AS (SELECT o_custkey AS u, year(o_orderdate)::INTEGER AS t, sum(o_totalprice) AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
l AS (SELECT u, t, y, lag(n) OVER (PARTITION BY u ORDER BY t) AS r FROM d), k AS (SELECT * FROM l WHERE r IS NOT NULL),
z AS (SELECT u, t, y, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS x FROM k),
m AS (SELECT 0 AS i, u, t, y, x FROM z UNION ALL
      SELECT i + 1, u, t, y - avg(y) OVER (PARTITION BY t), x - avg(x) OVER (PARTITION BY t) FROM (SELECT i, u, t, y - avg(y) OVER (PARTITION BY u) AS y, x - avg(x) OVER (PARTITION BY u) AS x FROM m) WHERE i < 60),
f AS (SELECT * FROM m WHERE i = 60), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*)::DOUBLE AS n, count(DISTINCT u)::DOUBLE AS us, count(DISTINCT t)::DOUBLE AS ts FROM f),
s AS (SELECT sum(x * (y - b * x)) AS s FROM f, b GROUP BY u), e AS (SELECT sqrt(sum(s * s)) AS e FROM s)
SELECT round(b, 2) AS estimate, round(e / xx * sqrt(us / (us - 1) * (n - 1) / (n - 1 - (us + ts - 1))), 2) AS se, round(b * xx / (e * sqrt(us / (us - 1) * (n - 1) / (n - 1 - (us + ts - 1)))), 4) AS t, n::BIGINT AS n FROM b, e"""


@query(_TWFE)
def twfe_within(t):
    y = customer_years(t).withColumn("before", F.lag("n").over(Window.partitionBy("o_custkey").orderBy("yr"))).filter("before is not null")
    fit = stats.two_way(y, "v", "before", "o_custkey", "yr")
    rows = t.spark.createDataFrame([fit] if fit else [], "estimate double, se double, t double, p double, n long")
    return rows.select(F.round("estimate", 2).alias("estimate"), F.round("se", 2).alias("se"), F.round("t", 4).alias("t"), "n")


@query("SELECT p_partkey, round(p_retailprice - (regr_intercept(p_retailprice, p_size) OVER (PARTITION BY p_type) + regr_slope(p_retailprice, p_size) OVER (PARTITION BY p_type) * p_size), 4) AS residual FROM part")
def residual_from_fit(t):
    fit = t.part.groupBy("p_type").agg(F.regr_slope("p_retailprice", "p_size").alias("b"), F.regr_intercept("p_retailprice", "p_size").alias("a"))
    return t.part.join(fit, "p_type").select("p_partkey", F.round(F.col("p_retailprice") - (F.col("a") + F.col("b") * F.col("p_size")), 4).alias("residual"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query, vec_id, list_distance(e::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q JOIN embeddings ON vec_id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM d)
SELECT query, vec_id, round(distance, 5) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def knn_topk(t):
    return nearest.neighbours(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 5))


_PLACES = "SELECT s_suppkey AS k, (s_suppkey * 37 % 1790) / 10.0::DOUBLE - 89.5 AS lat, (s_suppkey * 101 % 3590) / 10.0::DOUBLE - 179.5 AS lon FROM supplier"


@query(f"""WITH p AS ({_PLACES}), d AS (SELECT a.k AS k, b.k AS neighbour, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM p a JOIN p b ON a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km, neighbour) AS n FROM d) SELECT k, neighbour, round(km, 4) AS km, 0.125::DOUBLE AS weight FROM r WHERE n <= 8""")
def nearest_weights(t):
    k = F.col("s_suppkey")
    places = t.supplier.select(k.alias("k"), ((k * 37 % 1790) / 10.0 - 89.5).alias("lat"), ((k * 101 % 3590) / 10.0 - 179.5).alias("lon"))
    return stats.nearest_weights(places, "k", "lat", "lon", 8).withColumn("km", F.round("km", 4))


_MORAN = """WITH v AS (SELECT n_nationkey AS unit, n_regionkey AS g, coalesce(avg(c_acctbal), 0) AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
z AS (SELECT unit, g, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM v), l AS (SELECT a.unit, a.z, avg(b.z) AS lag FROM z a JOIN z b ON a.g = b.g AND a.unit <> b.unit GROUP BY 1, 2)"""


def _nations(t):
    v = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("unit"), "n_regionkey").agg(F.coalesce(F.avg("c_acctbal"), F.lit(0.0)).alias("x"))
    e = t.nation.select(F.col("n_nationkey").alias("unit"), "n_regionkey").join(t.nation.select(F.col("n_nationkey").alias("neighbour"), "n_regionkey"), "n_regionkey").filter("unit <> neighbour").select("unit", "neighbour")
    return v.select("unit", "x"), e


@query(f"""{_MORAN} SELECT unit, round(z, 5) AS z, round(lag, 5) AS lag, round(z * lag, 5) AS local, CASE WHEN z > 0 AND lag > 0 THEN 'high-high' WHEN z < 0 AND lag < 0 THEN 'low-low' WHEN z > 0 AND lag < 0 THEN 'high-low' WHEN z < 0 AND lag > 0 THEN 'low-high' ELSE 'none' END AS quadrant,
round(sum(z * lag) OVER () / sum(z * z) OVER (), 5) AS i FROM l""")
def moran_i(t):
    return spatial.moran(*_nations(t), "unit", "x").select("unit", *[F.round(c, 5).alias(c) for c in ("z", "lag", "local", "i")], "quadrant")


@query()
def pca_scores(t):
    scores, _ = stats.principal_components(t.embeddings, "vec_id", "embedding", 2)
    return scores.select("vec_id", F.round(F.col("scores")[0], 6).alias("first"), F.round(F.col("scores")[1], 6).alias("second"))


@query()
def pca_loadings(t):
    _, loadings = stats.principal_components(t.embeddings, "vec_id", "embedding", 2)
    return loadings.select("place", F.round(F.col("loadings")[0], 6).alias("first"), F.round(F.col("loadings")[1], 6).alias("second"), F.round(F.col("explained")[0], 6).alias("first_part"), F.round(F.col("explained")[1], 6).alias("second_part"))


@query()
def kmeans_clusters(t):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    best = max((ClusteringEvaluator().evaluate(m.transform(rows)), -k, m) for k in (3, 4, 5, 6) for m in [KMeans(k=k, seed=7, maxIter=10).fit(rows)])[2]
    return best.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


# ---------------------------------------------------------------- graphs

@query(f"WITH f AS ({_FLOW}), e AS (SELECT origin AS node, returns FROM f UNION ALL SELECT dest, returns FROM f), s AS (SELECT node, sum(returns)::BIGINT AS strength, row_number() OVER (ORDER BY sum(returns) DESC, node) AS r FROM e GROUP BY 1) SELECT o.node AS origin, d.node AS dest, sum(returns)::BIGINT AS w, any_value(o.strength) AS strength FROM f JOIN s o ON origin = o.node AND o.r <= 8 JOIN s d ON dest = d.node AND d.r <= 8 GROUP BY 1, 2")
def node_strength(t):
    f = flows(t)
    e = f.select(F.explode(F.array("origin", "dest")).alias("node"), "returns")
    top = e.groupBy("node").agg(F.sum("returns").alias("strength")).orderBy(F.desc("strength"), "node").limit(8)
    return f.join(top.withColumnRenamed("node", "origin"), "origin").join(top.select(F.col("node").alias("dest")), "dest").groupBy("origin", "dest").agg(F.sum("returns").alias("w"), F.first("strength").alias("strength"))


#: The nodes' ranks as one list, multiplied by the rows of shares until the changes sum to less than 1e-6 a node.
_RANKS = f"""WITH RECURSIVE f AS (SELECT origin, dest, sum(returns)::DOUBLE AS w FROM ({_FLOW}) GROUP BY 1, 2), p AS (SELECT origin, dest, w / sum(w) OVER (PARTITION BY origin) AS p FROM f),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS k, count(*) OVER () AS n FROM (SELECT origin AS node FROM f UNION SELECT dest FROM f)),
rows AS (SELECT d.k, list(coalesce(p, 0.0::DOUBLE) ORDER BY o.k) AS row FROM nodes d CROSS JOIN nodes o LEFT JOIN p ON p.origin = o.node AND p.dest = d.node GROUP BY d.k),
m AS (SELECT list(row ORDER BY k) AS m, (SELECT list(CASE WHEN node IN (SELECT origin FROM p) THEN 0.0 ELSE 1.0 END::DOUBLE ORDER BY k) FROM nodes) AS ends, count(*)::DOUBLE AS n FROM rows),
r AS (SELECT 0 AS turn, list_transform(ends, lambda e: 1.0::DOUBLE / n) AS v, list_transform(ends, lambda e: 1e9::DOUBLE) AS old, n FROM m UNION ALL
      SELECT turn + 1, list_transform(m.m, lambda row: 0.15::DOUBLE / m.n + 0.85::DOUBLE * (list_dot_product(row, v) + list_dot_product(m.ends, v) / m.n)), v, r.n FROM r, m
      WHERE list_sum(list_transform(list_zip(v, old), lambda x: abs(x[1] - x[2]))) >= r.n * 1e-6),
z AS (SELECT v FROM r ORDER BY turn DESC LIMIT 1)
SELECT node, round(v[k], 7) AS rank FROM nodes, z"""


@query(_RANKS)
def pagerank_flows(t):
    f = flows(t).groupBy("origin", "dest").agg(F.sum("returns").cast("double").alias("w"))
    return stats.pagerank(f, "origin", "dest", "w").select("node", F.round("rank", 7).alias("rank"))


@query(f"WITH f AS ({_FLOW}) SELECT node, sum(x)::BIGINT AS net FROM (SELECT dest AS node, returns AS x FROM f UNION ALL SELECT origin, -returns FROM f) GROUP BY 1")
def net_moves(t):
    f = flows(t)
    return f.select(F.explode(F.array(F.struct(F.col("dest").alias("node"), F.col("returns").alias("x")), F.struct(F.col("origin").alias("node"), (-F.col("returns")).alias("x")))).alias("e")).groupBy("e.node").agg(F.sum("e.x").alias("net"))


# ---------------------------------------------------------------- panels

@query(f"""WITH {_DOCS}, f AS (SELECT o_custkey, yr, count(*) AS docs FROM m GROUP BY 1, 2), p AS (SELECT o_custkey, year(l_shipdate)::INTEGER AS yr, count(DISTINCT o_orderkey) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_custkey, yr, coalesce(docs, 0) AS docs, coalesce(shipped, 0) AS shipped, coalesce(sum(docs) OVER (PARTITION BY o_custkey ORDER BY yr RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM f FULL JOIN p USING (o_custkey, yr)""")
def panel_firm_year(t):
    main, _ = firm_docs(t)
    filed = main.groupBy("o_custkey", "yr").agg(F.count(F.lit(1)).alias("docs"))
    lines = t.lineitem.select("l_orderkey", F.year("l_shipdate").alias("yr")).distinct().join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = lines.groupBy("o_custkey", "yr").agg(F.count(F.lit(1)).alias("shipped"))
    both = filed.join(shipped, ["o_custkey", "yr"], "full")
    return both.select("o_custkey", "yr", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("shipped", F.lit(0)).alias("shipped"), F.coalesce(F.sum("docs").over(panels.years_before(["o_custkey"], "yr", 5)), F.lit(0)).alias("prior"))


@query(f"""WITH k AS (SELECT n_nationkey AS state, y::INTEGER AS yr FROM nation CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y)), f AS ({_FLOW}), b AS (SELECT k.state, k.yr, sum(CASE WHEN dest = state AND origin <> state THEN returns ELSE 0 END)::BIGINT AS inflow, sum(CASE WHEN origin = state AND dest <> state THEN returns ELSE 0 END)::BIGINT AS outflow FROM k LEFT JOIN f ON f.yr = k.yr AND (dest = state OR origin = state) GROUP BY 1, 2),
v AS (SELECT s_nationkey AS state, yr, sum(rep) / sum(dem + rep)::DOUBLE AS share FROM ({PARTIES}) JOIN supplier ON l_suppkey = s_suppkey WHERE yr % 2 = 0 GROUP BY 1, 2)
SELECT state, yr, inflow, outflow, round((SELECT arg_max(share, v.yr) FROM v WHERE v.state = b.state AND v.yr <= b.yr), 6) AS vote FROM b""")
def panel_state_year(t):
    from panelspark.operators import joins

    base = joins.skeleton(t.nation.select(F.col("n_nationkey").alias("state")), 1995, 2001, "yr")
    f = flows(t).filter("origin <> dest")
    side = lambda c, name: f.groupBy(F.col(c).alias("state"), "yr").agg(F.sum("returns").alias(name))
    joined = base.join(side("dest", "inflow"), ["state", "yr"], "left").join(side("origin", "outflow"), ["state", "yr"], "left").fillna(0, ["inflow", "outflow"])
    votes = parties(t).filter("yr % 2 = 0").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("state"), "yr").agg(F.try_divide(F.sum("rep").cast("double"), F.sum(F.col("dem") + F.col("rep"))).alias("share"))
    return joins.asof(joined, votes, ["state"], "yr", ["share"]).select("state", "yr", "inflow", "outflow", F.round("share", 6).alias("vote"))


@query("""WITH p AS (SELECT c_custkey, 40 + c_custkey % 10 AS lat, -100 + c_nationkey AS lon FROM customer) SELECT c_custkey, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * pow(sin(radians(-90 - lon) / 2), 2)))), 3) AS km, round(1 - abs(2 * ((c_custkey % 10) / 10.0::DOUBLE) - 1), 6) AS balance FROM p""")
def distance_and_balance(t):
    p = t.customer.select("c_custkey", (40 + F.col("c_custkey") % 10).cast("double").alias("lat"), (-100 + F.col("c_nationkey")).cast("double").alias("lon"))
    return p.select("c_custkey", F.round(codes.haversine_km(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(-90.0)), 3).alias("km"), F.round(codes.balance((F.col("c_custkey") % 10) / 10.0), 6).alias("balance"))


@query("""WITH s AS (SELECT p_brand AS code, p_type AS sector, sum(l_quantity) AS emp, sum(l_quantity * l_discount) / sum(l_quantity) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT sector, sum(rate * emp) / sum(emp) AS rate FROM s GROUP BY 1),
a AS (SELECT code, sum(s.emp) AS emp, sum(s.rate * s.emp) / sum(s.emp) AS actual, sum(r.rate * s.emp) / sum(s.emp) AS predicted, count(*) AS sectors FROM s JOIN r USING (sector) GROUP BY 1)
SELECT substr(code, 1, 7) AS code4, sum(emp) AS emp, round(sum(actual * emp) / sum(emp), 6) AS actual, round(sum(predicted * emp) / sum(emp), 6) AS predicted, round(sum(actual * emp) / sum(emp) - sum(predicted * emp) / sum(emp), 6) + 0.0 AS gap, sum(sectors)::BIGINT AS sectors FROM a GROUP BY 1""")
def panel_industry(t):
    s = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("code"), F.col("p_type").alias("sector")).agg(F.sum("l_quantity").alias("emp"), (F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("rate"))
    r = s.groupBy("sector").agg(panels.weighted_mean(F.col("rate"), F.col("emp")).alias("norm"))
    a = s.join(r, "sector").groupBy("code").agg(F.sum("emp").alias("e"), panels.weighted_mean(F.col("rate"), F.col("emp")).alias("actual"), panels.weighted_mean(F.col("norm"), F.col("emp")).alias("predicted"), F.count(F.lit(1)).alias("k"))
    out = a.groupBy(F.substring("code", 1, 7).alias("code4")).agg(F.sum("e").alias("emp"), panels.weighted_mean(F.col("actual"), F.col("e")).alias("x"), panels.weighted_mean(F.col("predicted"), F.col("e")).alias("y"), F.sum("k").alias("sectors"))
    return out.select("code4", "emp", F.round("x", 6).alias("actual"), F.round("y", 6).alias("predicted"), (F.round(F.col("x") - F.col("y"), 6) + 0.0).alias("gap"), "sectors")


@query("""WITH u AS (SELECT p_type AS soc, p_brand AS kind, year(l_shipdate)::INTEGER AS yr, sum(l_quantity) AS emp, sum(l_extendedprice) / sum(l_quantity) AS wage FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), y AS (SELECT soc, yr, sum(emp) AS emp, ln(sum(wage * emp) / sum(emp)) AS log_wage, sum(emp) FILTER (WHERE kind IN ('Brand#11', 'Brand#12')) / sum(emp) AS part_share FROM u GROUP BY 1, 2)
SELECT soc, yr, emp, round(log_wage, 6) AS log_wage, round(part_share, 6) AS part_share, round(emp / first_value(emp) OVER (PARTITION BY soc ORDER BY yr) - 1, 6) AS growth, round(percent_rank() OVER (PARTITION BY yr ORDER BY emp, soc), 6) AS pct FROM y""")
def panel_occupation_year(t):
    u = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("soc"), F.col("p_brand").alias("kind"), F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("emp"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("wage"))
    y = u.groupBy("soc", "yr").agg(F.sum("emp").alias("n"), F.log(panels.weighted_mean(F.col("wage"), F.col("emp"))).alias("w"), (F.sum(F.when(F.col("kind").isin("Brand#11", "Brand#12"), F.col("emp"))) / F.sum("emp")).alias("s"))
    first = F.first("n").over(Window.partitionBy("soc").orderBy("yr"))
    y = panels.percentile(y.withColumn("growth", F.col("n") / first - 1), "yr", ["n", "soc"], "pct")
    return y.select("soc", "yr", F.col("n").alias("emp"), F.round("w", 6).alias("log_wage"), F.round("s", 6).alias("part_share"), F.round("growth", 6).alias("growth"), F.round("pct", 6).alias("pct"))


@query(f"""WITH k AS (SELECT s_suppkey AS county, y::INTEGER AS yr FROM supplier CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y)), v AS ({PARTIES}), b AS (SELECT l_suppkey AS county, year(l_shipdate)::INTEGER AS yr, count(*) AS returns, round(sum(l_extendedprice), 2) AS agi FROM lineitem GROUP BY 1, 2)
SELECT k.county AS county, k.yr AS yr, s_nationkey AS state, coalesce(returns, 0) AS returns, agi, v.yr AS vote_year, round(rep / nullif(dem + rep, 0)::DOUBLE, 6) AS vote FROM k JOIN supplier ON s_suppkey = k.county LEFT JOIN b ON b.county = k.county AND b.yr = k.yr
LEFT JOIN v ON v.l_suppkey = k.county AND v.yr = (SELECT max(w.yr) FROM v w WHERE w.l_suppkey = k.county AND w.yr % 4 = 0 AND w.yr <= k.yr)""")
def panel_county_year(t):
    from panelspark.operators import joins

    base = joins.skeleton(t.supplier.select(F.col("s_suppkey").alias("county"), F.col("s_nationkey").alias("state")), 1995, 2001, "yr")
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("county"), F.year("l_shipdate").alias("yr")).agg(F.count(F.lit(1)).alias("returns"), F.round(F.sum("l_extendedprice"), 2).alias("agi"))
    v = parties(t).filter("yr % 4 = 0").select(F.col("l_suppkey").alias("county"), "yr", F.col("yr").alias("vote_year"), F.round(F.try_divide(F.col("rep").cast("double"), F.col("dem") + F.col("rep")), 6).alias("vote"))
    return joins.asof(base.join(b, ["county", "yr"], "left").fillna(0, ["returns"]), v, ["county"], "yr", ["vote_year", "vote"]).select("county", "yr", "state", "returns", "agi", "vote_year", "vote")


@query(f"""WITH m AS (SELECT s_nationkey AS metro, year(l_shipdate)::INTEGER AS yr, p_type AS industry, sum(l_quantity) AS emp FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), x AS (SELECT p_type AS industry, avg(p_size) AS score FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT r_name AS region, n_name AS metro, yr, sum(emp) AS emp, round(sum(score * emp) / sum(emp) FILTER (WHERE score IS NOT NULL), 6) AS exposure, round(sum(emp) FILTER (WHERE score IS NOT NULL) / sum(emp), 6) AS coverage FROM m LEFT JOIN x USING (industry) JOIN nation ON metro = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def panel_metro_year(t):
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("yr")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    m = lines.groupBy("s_nationkey", "yr", "p_type").agg(F.sum("l_quantity").alias("e"))
    x = t.part.filter("p_type <> 'PROMO'").groupBy("p_type").agg(F.avg("p_size").alias("score"))
    known = F.sum(F.when(F.col("score").isNotNull(), F.col("e")))
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("metro"), F.col("r_name").alias("region"))
    out = m.join(x, "p_type", "left").groupBy("s_nationkey", "yr").agg(F.sum("e").alias("emp"), F.round(panels.weighted_mean(F.col("score"), F.col("e")), 6).alias("exposure"), F.round(known / F.sum("e"), 6).alias("coverage"))
    return out.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("region", "metro", "yr", "emp", "exposure", "coverage")


@query("""WITH t AS (SELECT DISTINCT p_type AS a, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS x FROM part), n AS (SELECT DISTINCT p_name AS b, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS y FROM part)
SELECT a, b FROM t, n WHERE x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))""")
def title_containment_whole(t):
    return linkage.containment(t.part, t.part, "p_type", "p_name").toDF("a", "b")


_LADDER = " UNION ALL ".join(
    f"SELECT p AS period, {i} AS controls, round(estimate, 3) AS estimate, round(se, 3) AS se, round(estimate / se, 3) AS t, round(r2, 6) AS r2, n::BIGINT AS n FROM {_fit_sql('lineitem', 'l_extendedprice', ['l_quantity', 'l_discount', 'l_tax'][: i + 1], p='l_returnflag', cl='l_suppkey')} WHERE k = 0"
    for i in range(3))


@query(_LADDER)
def control_ladder(t):
    fits = ladder.ladder(t.lineitem, "l_extendedprice", "l_quantity", [["l_discount"], ["l_tax"]], "l_returnflag", cluster="l_suppkey")
    r = lambda c, n=3: F.round(c, n).alias(c)
    return t.spark.createDataFrame(fits, "period string, controls int, estimate double, se double, t double, r2 double, n long").select("period", "controls", r("estimate"), r("se"), r("t"), r("r2", 6), "n")


@query()
def moran_permutations(t):
    return spatial.permutations(*_nations(t), "unit", "x", draws=999)
