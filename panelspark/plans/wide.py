"""Panels put together from their parts, by the operators of this library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import codes
from panelspark.operators import joins, linkage, novelty, panels, tasks
from panelspark.plans.aggregates import PARTIES, parties
from panelspark.plans.joins import yearly
from panelspark.plans.panels import _DOCS, firm_docs
from panelspark.plans.registry import query
from panelspark.sources.staging import staged


@query(f"""WITH {_DOCS}, y0 AS (SELECT min(year(l_shipdate))::INTEGER AS y0 FROM lineitem), b AS (SELECT min(yr) AS first FROM m),
fy AS (SELECT o_custkey, yr, count(*)::DOUBLE AS filed, (count(*) FILTER (WHERE p_type = 'PROMO'))::DOUBLE AS flagged FROM m GROUP BY 1, 2),
gy AS (SELECT o_custkey, year(l_shipdate)::INTEGER AS yr, count(DISTINCT o_orderkey)::DOUBLE AS granted FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
n AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = m.o_custkey AND a.p_type = m.p_type AND a.yr BETWEEN m.yr - 2 AND m.yr - 1) AS fresh FROM m),
nc AS (SELECT o_custkey, yr, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM a b2 WHERE b2.o_custkey = a.o_custkey AND b2.p_type = a.p_type AND b2.yr BETWEEN a.yr - 2 AND a.yr - 1)) AS new_classes FROM a GROUP BY 1, 2),
ex AS (SELECT o_custkey, yr, (count(*) FILTER (WHERE fresh))::DOUBLE AS explore, any_value(new_classes) AS new_classes FROM n JOIN nc USING (o_custkey, yr) GROUP BY 1, 2),
c AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, l_partkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey, l_partkey ORDER BY yr RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
ka AS (SELECT o_custkey, yr, sum(n * prior) / sum(n)::DOUBLE AS depth, sum(CASE WHEN prior = 0 THEN n ELSE 0 END) / sum(n)::DOUBLE AS scope FROM p GROUP BY 1, 2),
hs AS (SELECT o_custkey, yr, coalesce(sum(filed) OVER (PARTITION BY o_custkey ORDER BY yr RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS prior FROM fy),
ay AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, count(*)::DOUBLE AS apps, (count(*) FILTER (WHERE o_orderstatus = 'O'))::DOUBLE AS pending FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT o_custkey, yr, coalesce(filed, 0) AS filed, coalesce(flagged, 0) AS flagged, coalesce(granted, 0) AS granted, CASE WHEN yr >= first + 2 THEN explore END AS explore, CASE WHEN yr >= first + 2 THEN new_classes END AS new_classes, prior,
  round(CASE WHEN yr >= first + 2 THEN depth END, 6) AS depth, round(CASE WHEN yr >= first + 2 THEN scope END, 6) AS scope, coalesce(apps, 0) AS apps, coalesce(pending, 0) AS pending
FROM fy FULL JOIN gy USING (o_custkey, yr) LEFT JOIN ex USING (o_custkey, yr) LEFT JOIN ka USING (o_custkey, yr) LEFT JOIN hs USING (o_custkey, yr) FULL JOIN ay USING (o_custkey, yr) CROSS JOIN y0 CROSS JOIN b WHERE yr >= y0""")
def panel_firm_measures(t):
    """Firm by year: filings and grants with the flag, novelty and search over two years before, history, applications. Counts
    are 0 where a firm has none; the measures are null in the first years, which lack the years before."""
    key, width = ["o_custkey", "yr"], 2
    main, every = firm_docs(t)
    filed = main.groupBy(*key).agg(F.sum("share").alias("filed"), F.sum(F.when(F.col("p_type") == "PROMO", F.col("share")).otherwise(0.0)).alias("flagged"))
    history = filed.select(*key, F.coalesce(F.sum("filed").over(panels.years_before(["o_custkey"], "yr", width)), F.lit(0.0)).alias("prior"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("shipped")).join(yearly(t).select("o_orderkey", *key), F.col("l_orderkey") == F.col("o_orderkey"))
    granted = lines.select("o_custkey", F.col("shipped").alias("yr"), "o_orderkey").distinct().groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("granted"))
    explored = novelty.exploration(main, every, "o_custkey", "yr", "p_type", "share", width).drop("docs")
    searched = novelty.search(lines, "o_custkey", "yr", "l_partkey", width)
    apps = yearly(t).filter("o_orderstatus <> 'F'").groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("apps"), F.sum((F.col("o_orderstatus") == "O").cast("double")).alias("pending"))
    edges = t.lineitem.agg(F.min(F.year("l_shipdate")).alias("y0")).join(F.broadcast(main.agg(F.min("yr").alias("first"))), F.lit(True))  # one row
    out = filed.join(granted, key, "full").join(explored, key, "left").join(searched, key, "left").join(history, key, "left").join(apps, key, "full").join(F.broadcast(edges), F.lit(True))
    known = F.col("yr") >= F.col("first") + width
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("filed", "flagged", "granted", "apps", "pending")]
    return out.filter("yr >= y0").select(*key, *zero, "explore", "new_classes", "prior", *[F.round(F.when(known, F.col(c)), 6).alias(c) for c in ("depth", "scope")])


_MERGED = f"""WITH {_DOCS}, f AS (SELECT o_custkey, yr, count(*) AS filed FROM m GROUP BY 1, 2),
w AS (SELECT o_custkey, year(l_shipdate)::INTEGER AS yr, sum(l_quantity) AS workforce_workers, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS workforce_share FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= '1996-01-01' AND o_custkey % 4 <> 1 GROUP BY 1, 2),
ld AS (SELECT c_custkey AS o_custkey, unnest(range(1997, 2000))::INTEGER AS yr, c_acctbal AS leaders_score FROM customer WHERE c_custkey % 3 = 0),
p AS (SELECT * FROM f FULL JOIN w USING (o_custkey, yr) FULL JOIN ld USING (o_custkey, yr))"""


def _merged_firms(t):
    main, _ = firm_docs(t)
    filed = main.groupBy("o_custkey", "yr").agg(F.count(F.lit(1)).alias("filed"))
    lines = t.lineitem.filter("l_shipdate >= '1996-01-01'").join(t.orders.filter("o_custkey % 4 <> 1"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_quantity")
    work = lines.groupBy("o_custkey", F.year("l_shipdate").alias("yr")).agg(F.sum(n).alias("workers"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", n).otherwise(0)) / F.sum(n), 6).alias("share"))
    leaders = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.sequence(F.lit(1997), F.lit(1999))).alias("yr"), F.col("c_acctbal").alias("score"))
    return panels.merge_panels(filed, {"workforce": work, "leaders": leaders}, ["o_custkey", "yr"])


@query(f"{_MERGED} SELECT o_custkey, yr, filed, workforce_workers, workforce_share, leaders_score FROM p")
def panel_firm_merged(t):
    """Firms by year: filings, workforce and leaders, all rows of each."""
    return _merged_firms(t)


@query(f"""{_MERGED}, s AS (SELECT 'workforce' AS source, yr, filed, workforce_workers AS v FROM p UNION ALL SELECT 'leaders', yr, filed, leaders_score FROM p),
y AS (SELECT source, min(yr) AS first, max(yr) AS last FROM s WHERE v IS NOT NULL GROUP BY 1)
SELECT source, first, last, count(v) AS matched, count(*) AS total, round(count(v) / count(*)::DOUBLE, 6) AS share FROM s JOIN y USING (source) WHERE filed > 0 AND yr BETWEEN first AND last GROUP BY 1, 2, 3""")
def panel_firm_coverage(t):
    """Of the firm-years with filings within the years that a source covers, those that it has."""
    return panels.coverage(_merged_firms(t), F.col("filed") > 0, "yr", {"workforce": "workforce_workers", "leaders": "leaders_score"}).withColumn("share", F.round("share", 6))


_OCC = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '11-' || lpad((p_partkey % 900)::VARCHAR, 4, '0') END AS soc, 'o' || (p_partkey % 97) || CASE p_partkey % 4 WHEN 0 THEN ', All Other (note)' WHEN 1 THEN 'y' ELSE '' END AS title FROM part"
_DICT = "SELECT '11-' || lpad((s_suppkey % 800)::VARCHAR, 4, '0') AS soc, min('o' || (s_suppkey % 71) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'y' END) AS title, avg(s_acctbal) AS score FROM supplier GROUP BY 1"


@query(f"""WITH o AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\b(all other|except.*$)', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM ({_OCC})), d AS ({_DICT}),
tl AS (SELECT title AS t, min(soc) AS code FROM d GROUP BY 1), l AS (SELECT p_partkey, coalesce(d.soc, tl.code) AS link, CASE WHEN d.soc IS NOT NULL THEN 'code' WHEN tl.code IS NOT NULL THEN 'exact' END AS method FROM o LEFT JOIN d USING (soc) LEFT JOIN tl ON d.soc IS NULL AND o.t = tl.t),
y AS (SELECT l_partkey AS p_partkey, year(l_shipdate)::INTEGER AS yr, sum(l_quantity) AS workers, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS share FROM lineitem GROUP BY 1, 2),
e AS (SELECT p_partkey, arg_max(workers, yr) AS workers, arg_min(share, yr) AS first, arg_max(share, yr) AS last, min(yr) AS y0, max(yr) AS y1 FROM y GROUP BY 1), j AS (SELECT e.*, link, method, score FROM e JOIN l USING (p_partkey) LEFT JOIN d ON link = d.soc)
SELECT p_partkey, link, method, workers, y0, y1, round(100 * (last - first), 4) AS change_pp, round(score, 4) AS score, round(percent_rank() OVER (PARTITION BY method ORDER BY workers, p_partkey), 6) AS pct, round((SELECT sum(workers) FILTER (WHERE score IS NOT NULL) / sum(workers) FROM j), 6) AS matched FROM j""")
def panel_occupation_linked(t):
    """Occupations linked by their own code, else by title, with the exposure of what they link to, the change of a share from
    the first to the last year, the place by size among those linked alike, and the part of all workers that is linked."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    soc = lambda x: F.concat(F.lit("11-"), F.lpad(x.cast("string"), 4, "0"))
    title = F.concat(F.lit("o"), (p % 97).cast("string"), F.when(p % 4 == 0, ", All Other (note)").when(p % 4 == 1, "y").otherwise(""))
    left = t.part.select("p_partkey", F.when(p % 3 == 0, soc(p % 900)).alias("soc"), title.alias("title"))
    table = t.supplier.groupBy(soc(s % 800).alias("soc")).agg(F.min(F.concat(F.lit("o"), (s % 71).cast("string"), F.when(s % 2 == 0, "").otherwise("y"))).alias("title"), F.avg("s_acctbal").alias("score"))
    linked = linkage.code_or_title(left, table, "soc", "title").select("p_partkey", "link", "method")
    n = F.col("l_quantity")
    y = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("yr")).agg(F.sum(n).alias("w"), (F.sum(F.when(F.col("l_returnflag") == "R", n).otherwise(0)) / F.sum(n)).alias("share"))
    e = y.groupBy("p_partkey").agg(F.max_by("w", "yr").alias("workers"), F.min_by("share", "yr").alias("first"), F.max_by("share", "yr").alias("last"), F.min("yr").alias("y0"), F.max("yr").alias("y1"))
    j = e.join(linked, "p_partkey").join(table.select(F.col("soc").alias("link"), "score"), "link", "left")
    rate = j.agg((F.sum(F.when(F.col("score").isNotNull(), F.col("workers"))) / F.sum("workers")).alias("matched"))
    return panels.percentile(j, "method", ["workers", "p_partkey"], "pct").join(F.broadcast(rate), F.lit(True)).select(  # one row
        "p_partkey", "link", "method", "workers", "y0", "y1", F.round(100 * (F.col("last") - F.col("first")), 4).alias("change_pp"), F.round("score", 4).alias("score"), F.round("pct", 6).alias("pct"), F.round("matched", 6).alias("matched"))


_IND = "SELECT p_partkey, (p_partkey * 7 % 9000 + 1000)::VARCHAR || '00' AS code, CASE WHEN p_partkey % 10 = 0 THEN 'Goods (' || (1000 + p_partkey % 50) || ', ' || (1100 + p_partkey % 50) || ' only)' ELSE p_name END AS title FROM part"


@query(f"""WITH i AS ({_IND}), m AS (SELECT p_partkey, unnest(CASE WHEN p_partkey % 10 = 0 THEN regexp_extract_all(title, '\\d{{4}}') ELSE [code[1:4]] END) AS naics4 FROM i),
w AS (SELECT l_partkey AS p_partkey, sum(l_quantity) AS workers FROM lineitem GROUP BY 1), k AS (SELECT naics4, sum(workers) AS workers, count(DISTINCT p_partkey) AS members FROM m JOIN w USING (p_partkey) GROUP BY 1),
t AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 37 % 90 + 10)::VARCHAR || 'MS' ELSE (s_suppkey * 11 % 9000 + 1000)::VARCHAR || '9' END AS code, s_suppkey AS n, s_acctbal AS pay FROM supplier), u AS (SELECT *, regexp_extract(code, '^(\\d+)', 1) AS d FROM t),
f AS (SELECT naics4, n, pay, CASE WHEN length(d) >= 4 THEN 4 ELSE length(d) END AS lv FROM k JOIN u ON (length(d) >= 4 AND d[1:4] = naics4) OR (length(d) IN (2, 3) AND starts_with(naics4, d))), b AS (SELECT *, max(lv) OVER (PARTITION BY naics4) AS top FROM f),
pr AS (SELECT naics4, round(sum(pay * n) / nullif(sum(n), 0), 4) AS pay, any_value(top) < 4 AS coarse FROM b WHERE lv = top GROUP BY 1),
sec AS (SELECT n_nationkey + 10 AS s2, n_name AS name FROM nation), rep AS (SELECT r_name AS g, r_regionkey::DOUBLE AS rate FROM region UNION ALL SELECT n_name || ' and more', n_nationkey + 0.5 FROM nation WHERE n_nationkey % 2 = 0),
sc AS (SELECT s2, min(rate) AS rate FROM sec JOIN rep ON contains(regexp_replace(lower(g), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(g), '[^a-z0-9]', '', 'g')) GROUP BY 1)
SELECT naics4, workers, members, pay, coarse, rate FROM k LEFT JOIN pr USING (naics4) LEFT JOIN sc ON s2 = naics4[1:2]::INTEGER""")
def panel_industry_profiles(t):
    """Industries of four digits: combined codes told apart, profiles from fine codes or a coarser stand-in, and the rate of the
    sector whose title contains the report's or is contained in it."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda x: x.cast("string")
    title = F.when(p % 10 == 0, F.concat(F.lit("Goods ("), text(1000 + p % 50), F.lit(", "), text(1100 + p % 50), F.lit(" only)"))).otherwise(F.col("p_name"))
    members = t.part.select("p_partkey", F.explode(codes.member_codes(F.concat(text(p * 7 % 9000 + 1000), F.lit("00")), title)).alias("naics4"))
    workers = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("w"))
    k = members.join(workers, "p_partkey").groupBy("naics4").agg(F.sum("w").alias("workers"), F.count_distinct("p_partkey").alias("members"))
    table = t.supplier.select(F.when(s % 2 == 0, F.concat(text(s * 37 % 90 + 10), F.lit("MS"))).otherwise(F.concat(text(s * 11 % 9000 + 1000), F.lit("9"))).alias("code"), s.alias("n"), F.lit(1).alias("c"), F.col("s_acctbal").alias("pay"))
    found = joins.profiles(k.select("naics4"), table, "naics4", "code", "n", "c", ["pay"]).select("naics4", F.round("pay", 4).alias("pay"), "coarse")
    sectors = t.nation.select((F.col("n_nationkey") + 10).alias("s2"), F.col("n_name").alias("name"))
    report = t.region.select(F.col("r_name").alias("g"), F.col("r_regionkey").cast("double").alias("rate")).unionByName(t.nation.filter("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit(" and more")).alias("g"), (F.col("n_nationkey") + 0.5).cast("double").alias("rate")))
    rates = linkage.containment(sectors, report, "name", "g").join(sectors, "name").join(report, "g").groupBy("s2").agg(F.min("rate").alias("rate"))
    return k.join(found, "naics4", "left").join(rates, F.substring("naics4", 1, 2).cast("int") == F.col("s2"), "left").select("naics4", "workers", "members", "pay", "coarse", "rate")


@query(f"""WITH k AS (SELECT n_nationkey AS state, y::INTEGER AS yr FROM nation CROSS JOIN (SELECT unnest(range(1994, 2003)) AS y)), v AS (SELECT s_nationkey AS state, yr, sum(rep) / sum(dem + rep)::DOUBLE AS share FROM ({PARTIES}) JOIN supplier ON l_suppkey = s_suppkey WHERE yr % 3 = 0 GROUP BY 1, 2),
s AS (SELECT c_nationkey AS state, year(o_orderdate)::INTEGER AS yr, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
j AS (SELECT k.state, k.yr, share, f, o, p FROM k LEFT JOIN v USING (state, yr) LEFT JOIN s USING (state, yr)), c AS (SELECT 'f' AS x, count(f) AS n FROM j UNION ALL SELECT 'o', count(o) FROM j UNION ALL SELECT 'p', count(p) FROM j), best AS (SELECT x FROM c ORDER BY n DESC, x LIMIT 1)
SELECT state, yr, round(coalesce(last_value(share IGNORE NULLS) OVER (PARTITION BY state ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(share IGNORE NULLS) OVER (PARTITION BY state ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS vote,
  round(f, 2) AS f, round(o, 2) AS o, round(p, 2) AS p, (SELECT x FROM best) AS best, round(lag(f) OVER (PARTITION BY state ORDER BY yr), 2) AS f_before FROM j""")
def panel_state_context(t):
    """State by year on the whole skeleton: a vote share filled forward and back, status totals turned into columns, the
    best-covered of these by name, and one of them a year before."""
    base = joins.skeleton(t.nation.select(F.col("n_nationkey").alias("state")), 1994, 2002, "yr")
    votes = parties(t).filter("yr % 3 = 0").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("state"), "yr").agg(F.try_divide(F.sum("rep").cast("double"), F.sum(F.col("dem") + F.col("rep"))).alias("share"))
    spend = yearly(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("state"), "yr").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")).toDF("state", "yr", "f", "o", "p")
    j = panels.filled(base.join(votes, ["state", "yr"], "left").join(spend, ["state", "yr"], "left"), "state", "yr", "share", "vote")
    covered = j.agg(*[F.struct((-F.count(c)).alias("n"), F.lit(c).alias("x")).alias(c) for c in ("f", "o", "p")])
    best = covered.select(F.least("f", "o", "p")["x"].alias("best"))
    before = F.lag("f").over(Window.partitionBy("state").orderBy("yr"))
    return j.withColumn("f_before", before).join(F.broadcast(best), F.lit(True)).select("state", "yr", "best", *[F.round(c, n).alias(c) for c, n in (("vote", 6), ("f", 2), ("o", 2), ("p", 2), ("f_before", 2))])  # one row


@query("""WITH l AS (SELECT s_suppkey AS k, ['city' || (s_suppkey * 13 % 60), 'city' || (s_suppkey * 17 % 90)] AS cs, 'S' || (s_suppkey % 3) AS st FROM supplier), r AS (SELECT c_custkey AS code, ['city' || (c_custkey % 40), 'city' || (c_custkey % 11)] AS cs, 'S' || (c_custkey % 3) AS st FROM customer),
p AS (SELECT k, CASE WHEN l.cs[1] = r.cs[1] THEN 3 ELSE 2 END AS s, code FROM l JOIN r ON l.st = r.st AND len(list_intersect(l.cs, r.cs)) > 0), b AS (SELECT k, code, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, code) AS n FROM p), m AS (SELECT k, code, s FROM b WHERE n = 1),
e AS (SELECT l_suppkey AS k, year(l_shipdate)::INTEGER AS yr, p_type AS industry, sum(l_quantity) AS emp FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), x AS (SELECT p_type AS industry, avg(p_size) AS score FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT code AS metro, yr, count(DISTINCT k) AS places, max(s)::INTEGER AS link, sum(emp) AS emp, round(sum(score * emp) / sum(emp) FILTER (WHERE score IS NOT NULL), 6) AS exposure FROM e JOIN m USING (k) LEFT JOIN x USING (industry) GROUP BY 1, 2""")
def panel_metro_linked(t):
    """Metro by year: places linked by the cascade of cities and states, exposure from the industry mix of what links."""
    city = lambda n: F.concat(F.lit("city"), n.cast("string"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    state = lambda k: F.array(F.concat(F.lit("S"), (k % 3).cast("string")))
    left = t.supplier.select(s.alias("k"), F.array(city(s * 13 % 60), city(s * 17 % 90)).alias("cities"), state(s).alias("states"))
    right = t.customer.select(c.alias("code"), F.array(city(c % 40), city(c % 11)).alias("cities"), state(c).alias("states"))
    m = linkage.place_cascade(left, right, "k", "code").filter("score > 0")
    e = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("yr"), F.col("p_type").alias("industry")).agg(F.sum("l_quantity").alias("e"))
    x = t.part.filter("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("industry")).agg(F.avg("p_size").alias("score"))
    out = e.join(m.select("k", "code", F.col("score").alias("s")), "k").join(x, "industry", "left").groupBy(F.col("code").alias("metro"), "yr")
    return out.agg(F.count_distinct("k").alias("places"), F.max("s").cast("int").alias("link"), F.sum("e").alias("emp"), F.round(panels.weighted_mean(F.col("score"), F.col("e")), 6).alias("exposure"))


@query("""WITH j AS (SELECT l_suppkey AS employer, year(l_shipdate)::INTEGER AS yr, p_brand AS occ, sum(l_quantity) AS emp FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), z AS (SELECT p_brand AS occ, 1 + min(p_partkey) % 5 AS zone FROM part GROUP BY 1),
n AS (SELECT occ, yr, sum(emp * CASE WHEN employer % 2 = 0 THEN 1 ELSE 0 END) / sum(emp) AS norm FROM j GROUP BY 1, 2), s AS (SELECT s_suppkey AS employer, s_nationkey AS state, s_acctbal AS bal FROM supplier)
SELECT employer, yr, any_value(state) AS state, sum(emp) AS emp, round(sum(emp) FILTER (WHERE zone >= 4) / sum(emp), 6) AS prepared, round(sum(emp) FILTER (WHERE zone <= 2) / sum(emp), 6) AS unprepared, round(sum(zone * emp) / sum(emp), 6) AS zone, round(sum(norm * emp) / sum(emp), 6) AS predicted, count(*) AS occupations,
  round(sum(emp) / first_value(sum(emp)) OVER (PARTITION BY employer ORDER BY yr) - 1, 6) AS growth FROM j JOIN z USING (occ) JOIN n USING (occ, yr) JOIN s USING (employer) GROUP BY 1, 2""")
def panel_employer_staffing(t):
    """Employer by year: staffing by job zone, the mean zone, what its mix of occupations predicts, and growth since its first year."""
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("employer"), F.year("l_shipdate").alias("yr"), F.col("p_brand").alias("occ")).agg(F.sum("l_quantity").alias("e"))
    zones = t.part.groupBy(F.col("p_brand").alias("occ")).agg((1 + F.min("p_partkey") % 5).alias("z"))
    norms = j.groupBy("occ", "yr").agg((F.sum(F.when(F.col("employer") % 2 == 0, F.col("e")).otherwise(0)) / F.sum("e")).alias("norm"))
    rows = j.join(zones, "occ").join(norms, ["occ", "yr"]).join(t.supplier.select(F.col("s_suppkey").alias("employer"), "s_nationkey"), "employer")
    part = lambda c: F.sum(F.when(c, F.col("e"))) / F.sum("e")
    out = rows.groupBy("employer", "yr").agg(F.first("s_nationkey").alias("state"), F.sum("e").alias("emp"), F.round(part(F.col("z") >= 4), 6).alias("prepared"), F.round(part(F.col("z") <= 2), 6).alias("unprepared"),
                                             F.round(panels.weighted_mean(F.col("z"), F.col("e")), 6).alias("zone"), F.round(panels.weighted_mean(F.col("norm"), F.col("e")), 6).alias("predicted"), F.count(F.lit(1)).alias("occupations"))
    first = F.first("emp").over(Window.partitionBy("employer").orderBy("yr"))
    return out.withColumn("growth", F.round(F.col("emp") / first - 1, 6))


_VOTES = "SELECT l_suppkey, year(l_shipdate)::INTEGER AS yr, count(*) FILTER (WHERE l_returnflag = 'A') AS dem, count(*) FILTER (WHERE l_returnflag = 'R') AS rep, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS dem_raw, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 4) AS rep_raw FROM lineitem GROUP BY 1, 2"
_FOUR = f"""v AS ({_VOTES}), full_ AS (SELECT l_suppkey FROM v GROUP BY 1 HAVING count(DISTINCT yr) = (SELECT count(DISTINCT yr) FROM v)),
p AS (SELECT 'all counts' AS variant, yr, dem, rep FROM v UNION ALL SELECT 'raw counts', yr, dem_raw, rep_raw FROM v UNION ALL SELECT 'units in every year', yr, dem, rep FROM v SEMI JOIN full_ USING (l_suppkey) UNION ALL SELECT 'units of 25 or more', yr, dem, rep FROM v WHERE dem + rep >= 25),
o AS (SELECT variant, yr, sum(dem * (dem - 1) / (dem + rep - 1)::DOUBLE) / sum(dem) AS oa, sum(rep * (rep - 1) / (dem + rep - 1)::DOUBLE) / sum(rep) AS ob, sum(dem) / sum(dem + rep)::DOUBLE AS sa, sum(rep) / sum(dem + rep)::DOUBLE AS sb FROM p WHERE dem + rep >= 2 GROUP BY 1, 2),
e AS (SELECT variant, yr, oa / sa AS dem_exposure, ob / sb AS rep_exposure, (oa * sa + ob * sb) / (sa * sa + sb * sb) AS combined FROM o)"""


def _exposures(t):
    """Own-party exposure by variant and year: all, raw counts, units seen in every year, and units of 25 or more."""
    flag, n = F.col("l_returnflag"), F.count_if
    v = staged(t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(
        n(flag == "A").alias("dem"), n(flag == "R").alias("rep"), n((flag == "A") & (F.col("l_linestatus") == "F")).alias("dem_raw"), n((flag == "R") & (F.col("l_linenumber") < 4)).alias("rep_raw")), "votes")
    years = v.agg(F.count_distinct("yr").alias("all"))  # one row
    balanced = v.groupBy("l_suppkey").agg(F.count_distinct("yr").alias("k")).join(F.broadcast(years), F.col("k") == F.col("all")).select("l_suppkey")
    tagged = lambda name, df, a="dem", b="rep": df.select(F.lit(name).alias("variant"), "yr", F.col(a).alias("dem"), F.col(b).alias("rep"))
    rows = tagged("all counts", v).unionByName(tagged("raw counts", v, "dem_raw", "rep_raw")).unionByName(tagged("units in every year", v.join(balanced, "l_suppkey", "left_semi"))).unionByName(tagged("units of 25 or more", v.filter("dem + rep >= 25")))
    both = F.col("dem") + F.col("rep")
    own = lambda x: F.try_divide(F.sum(F.col(x) * (F.col(x) - 1) / (both - 1)), F.sum(x))
    o = rows.filter(both >= 2).groupBy("variant", "yr").agg(own("dem").alias("oa"), own("rep").alias("ob"), (F.sum("dem") / F.sum(both)).alias("sa"), (F.sum("rep") / F.sum(both)).alias("sb"))
    oa, ob, sa, sb = (F.col(c) for c in ("oa", "ob", "sa", "sb"))
    return o.select("variant", "yr", F.try_divide(oa, sa).alias("dem_exposure"), F.try_divide(ob, sb).alias("rep_exposure"), F.try_divide(oa * sa + ob * sb, sa * sa + sb * sb).alias("combined"))


@query(f"WITH {_FOUR} SELECT variant, yr, round(dem_exposure, 5) AS dem_exposure, round(rep_exposure, 5) AS rep_exposure, round(combined, 5) AS combined FROM e")
def exposure_four_variants(t):
    return _exposures(t).select("variant", "yr", *[F.round(c, 5).alias(c) for c in ("dem_exposure", "rep_exposure", "combined")])


@query(f"""WITH {_FOUR}, b AS (SELECT min(yr) AS y0, max(yr) AS y1 FROM e), c AS (SELECT a.variant, z.dem_exposure - a.dem_exposure AS dem_change, z.rep_exposure - a.rep_exposure AS rep_change FROM b JOIN e a ON a.yr = y0 JOIN e z ON z.yr = y1 AND z.variant = a.variant)
SELECT variant, round(dem_change, 5) AS dem_change, round(rep_change, 5) AS rep_change, rep_change > 0 AND dem_change < 0 AS asymmetry FROM c""")
def exposure_change(t):
    """Change from the first year of all to the last, and whether it is the one way up and the other way down."""
    e = staged(_exposures(t), "exposures")
    edges = e.agg(F.min("yr").alias("y0"), F.max("yr").alias("y1"))  # one row
    at = lambda y, c: F.max(F.when(F.col("yr") == F.col(y), F.col(c)))
    change = e.join(F.broadcast(edges), F.lit(True)).groupBy("variant").agg(*[(at("y1", f"{c}_exposure") - at("y0", f"{c}_exposure")).alias(c) for c in ("dem", "rep")]).filter("dem is not null or rep is not null")
    return change.select("variant", F.round("dem", 5).alias("dem_change"), F.round("rep", 5).alias("rep_change"), ((F.col("rep") > 0) & (F.col("dem") < 0)).alias("asymmetry"))


_GATES = """WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT year(l_shipdate) AS y, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, o_totalprice, l.v AS rebuilt FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey),
f AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity) AS workers, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1, 2), m AS (SELECT avg(b) AS mid FROM f)
SELECT 'rows against the list' AS gate, round(max(abs(100 * (c.n / k.n::DOUBLE - 1))), 4) AS value, 0.1::DOUBLE AS threshold, max(abs(100 * (c.n / k.n::DOUBLE - 1))) < 0.1 AS pass FROM c JOIN k USING (y)
UNION ALL SELECT 'duplicate unit-years', (SELECT count(*) - count(DISTINCT (l_suppkey, y)) FROM f)::DOUBLE, 0.0::DOUBLE, (SELECT count(*) = count(DISTINCT (l_suppkey, y)) FROM f)
UNION ALL SELECT 'totals rebuilt from parts', round(max(abs(rebuilt / nullif(o_totalprice, 0) - 1)), 6), 1e-6::DOUBLE, max(abs(rebuilt / nullif(o_totalprice, 0) - 1)) < 1e-6 FROM s
UNION ALL SELECT 'correlation, all', round(corr(a, b), 6), 0.35::DOUBLE, corr(a, b) > 0.35 FROM f UNION ALL SELECT 'correlation, large units', round(corr(a, b), 6), 0.45::DOUBLE, corr(a, b) > 0.45 FROM f WHERE workers >= 200
UNION ALL SELECT 'same side of the middle', round(avg(CASE WHEN (a > 25) = (b > mid) THEN 1.0 ELSE 0.0 END), 6), 0.6::DOUBLE, avg(CASE WHEN (a > 25) = (b > mid) THEN 1.0 ELSE 0.0 END) > 0.6 FROM f, m"""


@query(_GATES)
def validation_gates_full(t):
    """Gates that data can fail: row counts against a list, duplicate keys, totals rebuilt from their parts, correlations with
    another source for all and for large units, and agreement on the side of the middle."""
    def gate(df, name, value, threshold, passed):
        return df.select(F.lit(name).alias("gate"), value.alias("value"), F.lit(float(threshold)).alias("threshold"), passed.alias("pass"))

    c = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    k = t.lineitem.select(F.year("l_shipdate").alias("y"), "l_orderkey").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("m"))
    rows = c.join(k, "y").agg(F.max(F.abs(100 * (F.col("n") / F.col("m") - 1))).alias("x"))
    f = staged(t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("workers"), F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b")), "gate-units")
    twice = panels.grain_violations(f, ["l_suppkey", "y"]).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("double").alias("x"))
    parts = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    built = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.max(F.abs(F.try_divide(F.col("v"), F.col("o_totalprice")) - 1)).alias("x"))
    middle = f.agg(F.avg("b").alias("mid"))  # one row
    agree = f.join(F.broadcast(middle), F.lit(True)).agg(F.avg(((F.col("a") > 25) == (F.col("b") > F.col("mid"))).cast("double")).alias("x"))
    x, corr = F.col("x"), F.corr("a", "b").alias("x")
    return (gate(rows, "rows against the list", F.round(x, 4), 0.1, x < 0.1).unionByName(gate(twice, "duplicate unit-years", x, 0, x == 0)).unionByName(gate(built, "totals rebuilt from parts", F.round(x, 6), 1e-6, x < 1e-6))
            .unionByName(gate(f.agg(corr), "correlation, all", F.round(x, 6), 0.35, x > 0.35)).unionByName(gate(f.filter("workers >= 200").agg(corr), "correlation, large units", F.round(x, 6), 0.45, x > 0.45))
            .unionByName(gate(agree, "same side of the middle", F.round(x, 6), 0.6, x > 0.6)))


_WPAIRS = "SELECT DISTINCT doc_id, w[i] AS first, w[i + 1] AS second FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({stop})) AS w FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)))".format(stop=", ".join(f"'{w}'" for w in tasks.STOP))


@query(f"WITH p AS ({_WPAIRS}) SELECT doc_id, first, second FROM p UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM p)")
def incremental_stored_pairs(t):
    """What a run adds to its store: pairs of the documents that are new, and an empty row for each new one without any."""
    new = tasks.unseen(t.documents, t.labels, "doc_id")
    return tasks.stored_pairs(tasks.word_pairs(new, ["doc_id"], "text"), new, "doc_id")
