"""Queries on aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators import panels
from panelspark.plans.joins import _FLOW, flows, yearly
from panelspark.plans.registry import query
from panelspark.sources.staging import staged

PARTIES = "SELECT l_suppkey, year(l_shipdate)::INTEGER AS yr, count(*) FILTER (WHERE l_returnflag = 'A') AS dem, count(*) FILTER (WHERE l_returnflag = 'R') AS rep FROM lineitem GROUP BY 1, 2"


def parties(t):
    """Two parties per supplier and ship year."""
    return t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(F.count_if(F.col("l_returnflag") == "A").alias("dem"), F.count_if(F.col("l_returnflag") == "R").alias("rep"))


@query("""WITH x AS (SELECT l_orderkey, l_suppkey, l_returnflag, year(l_shipdate) AS yr, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS share FROM lineitem)
SELECT s_nationkey, yr::INTEGER AS yr, round(sum(share), 6) AS docs, round(sum(CASE WHEN l_returnflag = 'R' THEN share ELSE 0 END), 6) AS returned, count(DISTINCT l_suppkey) AS suppliers,
count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS returning_suppliers FROM x JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def fractional_place_year(t):
    share = panels.share_of_group(t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("yr")), ["l_orderkey"])
    # summed by supplier first: places get a row a supplier, and the distinct counts need no second expansion of lines
    returned = F.col("l_returnflag") == "R"
    by = share.groupBy("l_suppkey", "yr").agg(F.sum("share").alias("s"), F.sum(F.when(returned, F.col("share")).otherwise(0.0)).alias("r"), F.bool_or(returned).alias("any_r"))
    placed = by.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return placed.groupBy("s_nationkey", "yr").agg(F.round(F.sum("s"), 6).alias("docs"), F.round(F.sum("r"), 6).alias("returned"), F.count(F.lit(1)).alias("suppliers"), F.count_if("any_r").alias("returning_suppliers"))


@query("""SELECT l_orderkey, bool_or(p_type = 'PROMO') AS promo, count(*) AS n, count(DISTINCT p_brand) AS brands, arg_min(p_type, (coalesce(l_linenumber, 999999), l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS first_type
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def doc_class_summary(t):
    order = F.struct(F.coalesce("l_linenumber", F.lit(999999)), "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.bool_or(F.col("p_type") == "PROMO").alias("promo"), F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"), F.min_by("p_type", order).alias("first_type"))


@query("""SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s_nationkey < 10) AS home, arg_min(s_name, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS first_name,
(arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))::INTEGER % 10)::INTEGER AS kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def doc_party_summary(t):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_nationkey") < 10).alias("home"), F.min_by("s_name", order).alias("first_name"), (F.min_by(F.col("l_quantity").cast("string"), order).try_cast("double").cast("int") % 10).alias("kind"))


@query("SELECT year(ts)::INTEGER AS yr, month(ts)::INTEGER AS mon, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS flagged, count(toxic) AS covered FROM events LEFT JOIN labels ON event_id = doc_id GROUP BY 1, 2")
def yearly_flag_counts(t):
    return t.events.join(t.labels, F.col("event_id") == F.col("doc_id"), "left").groupBy(F.year("ts").alias("yr"), F.month("ts").alias("mon")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count("toxic").alias("covered"))


@query("""SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY min(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END), count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1""")
def mode_with_ties(t):
    return panels.mode(t.orders, ["o_custkey"], "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).otherwise(2))


@query("""WITH w AS (SELECT item_id, CASE WHEN item_id % 3 < 2 THEN 'p' || (item_id % 3) END AS period, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('the','a','an','of','to','and','or','in','on','for','with','by','at','from','as','is','are','be','it','this','that')) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, period, w[i] AS first, w[i + 1] AS second FROM (SELECT item_id, period, w, unnest(range(1, len(w))) AS i FROM w)),
a AS (SELECT period, first, second, count(DISTINCT item_id) AS n FROM p WHERE period IS NOT NULL GROUP BY ALL UNION ALL SELECT 'all', first, second, count(DISTINCT item_id) FROM p GROUP BY ALL),
d AS (SELECT period, count(DISTINCT item_id) AS docs FROM p WHERE period IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT item_id) FROM p)
SELECT period, first, second, n, docs, round(n::DOUBLE / docs, 6) AS share FROM a JOIN d USING (period)""")
def pair_share_grouping_sets(t):
    from panelspark.operators.tasks import pair_shares, word_pairs

    period = F.when(F.col("item_id") % 3 < 2, F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")))
    return pair_shares(word_pairs(t.benchmark.withColumn("period", period), ["item_id", "period"], "text"), "item_id", "period").withColumn("share", F.round("share", 6))


@query("""SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) <= greatest(1, 0.01 * (SELECT count(*) FROM part))""")
def having_specific_pairs(t):
    total = t.part.agg(F.count(F.lit(1)).alias("total"))
    return t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.col("n") <= F.greatest(F.lit(1.0), 0.01 * F.col("total"))).select("p_brand", "p_type", "n")


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 4")
def balanced_units(t):
    return yearly(t).filter("yr between 1996 and 1999").groupBy("o_custkey").agg(F.count_distinct("yr").alias("n")).filter("n = 4").select("o_custkey")


@query(f"""WITH p AS ({PARTIES}), s AS (SELECT *, rep / nullif(dem + rep, 0)::DOUBLE AS share FROM p)
SELECT l_suppkey, round(regr_slope(share, yr) * 600, 4) AS points, arg_max(rep, yr) AS last_rep, round(avg(share), 6) AS mean_share, count(share) AS years,
CASE WHEN regr_slope(share, yr) * 600 <= -5 THEN 'down' WHEN regr_slope(share, yr) * 600 >= 5 THEN 'up' ELSE 'flat' END AS drift FROM s GROUP BY 1""")
def unit_trend_slope(t):
    s = parties(t).withColumn("share", F.try_divide(F.col("rep").cast("double"), F.col("dem") + F.col("rep")))
    points = F.regr_slope("share", "yr") * 600
    return s.groupBy("l_suppkey").agg(F.round(points, 4).alias("points"), F.max_by("rep", "yr").alias("last_rep"), F.round(F.avg("share"), 6).alias("mean_share"), F.count("share").alias("years"), F.when(points <= -5, "down").when(points >= 5, "up").otherwise("flat").alias("drift"))


@query("""SELECT l_linestatus, year(l_shipdate)::INTEGER AS yr, sum(l_quantity) AS weight, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS discounted,
round(sum(CASE WHEN l_returnflag = 'R' AND l_tax > 0.02 THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_tax > 0.02 THEN l_quantity ELSE 0 END), 0), 6) AS returned_of_taxed FROM lineitem GROUP BY 1, 2""")
def weighted_profile(t):
    q = F.col("l_quantity")
    taxed = F.col("l_tax") > 0.02
    return t.lineitem.groupBy("l_linestatus", F.year("l_shipdate").alias("yr")).agg(F.sum(q).alias("weight"), F.round(panels.weighted_share(F.col("l_discount") > 0.05, q), 6).alias("discounted"),
        F.round(F.try_divide(F.sum(F.when(taxed & (F.col("l_returnflag") == "R"), q).otherwise(0.0)), F.sum(F.when(taxed, q).otherwise(0.0))), 6).alias("returned_of_taxed"))


@query("""SELECT p_brand, round(sum(l_discount * l_quantity) FILTER (WHERE l_returnflag <> 'N') / sum(l_quantity) FILTER (WHERE l_returnflag <> 'N'), 6) AS mean_discount, round(ln(sum(l_extendedprice * l_quantity) / sum(l_quantity)), 6) AS log_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def weighted_mean_group(t):
    known = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.round(panels.weighted_mean(known, F.col("l_quantity")), 6).alias("mean_discount"), F.round(F.log(panels.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity"))), 6).alias("log_price"))


@query("""WITH p AS (SELECT o_custkey, l_suppkey % 10 AS place, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 10 <> 3 GROUP BY 1, 2)
SELECT o_custkey, round(sum(w * w) / (sum(w) * sum(w)), 6) AS hhi, count(*) AS places FROM p GROUP BY 1""")
def herfindahl(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.when(F.col("l_suppkey") % 10 != 3, F.col("l_suppkey") % 10).alias("place"), "l_quantity")
    return panels.herfindahl(rows, "o_custkey", "place", "l_quantity").withColumn("hhi", F.round("hhi", 6))


@query("""WITH x AS (SELECT year(o_orderdate)::INTEGER AS yr, o_totalprice AS x, count(*)::DOUBLE AS w FROM orders GROUP BY 1, 2), c AS (SELECT *, sum(x * w) OVER (PARTITION BY yr ORDER BY x ROWS UNBOUNDED PRECEDING) AS cx FROM x)
SELECT yr, round(1 - sum(w * (2 * cx - x * w)) / (sum(w) * sum(x * w)), 6) AS gini FROM c GROUP BY 1""")
def gini_by_year(t):
    return panels.gini(yearly(t).withColumn("w", F.lit(1.0)), "yr", "o_totalprice", "w").withColumn("gini", F.round("gini", 6))


@query(f"""WITH p AS ({PARTIES}), s AS (SELECT yr, dem / sum(dem) OVER (PARTITION BY yr) AS d, rep / sum(rep) OVER (PARTITION BY yr) AS r FROM p) SELECT yr, round(0.5 * sum(abs(d - r)), 6) AS dissimilarity FROM s GROUP BY 1""")
def dissimilarity_index(t):
    return panels.dissimilarity(parties(t), "yr", "dem", "rep").withColumn("dissimilarity", F.round("dissimilarity", 6))


_OWN = """o AS (SELECT yr, sum(dem * (dem - 1) / (dem + rep - 1)::DOUBLE) / sum(dem) AS oa, sum(rep * (rep - 1) / (dem + rep - 1)::DOUBLE) / sum(rep) AS ob, sum(dem) / sum(dem + rep)::DOUBLE AS sa, sum(rep) / sum(dem + rep)::DOUBLE AS sb FROM p WHERE dem + rep >= {least} GROUP BY 1)
SELECT yr, round_even(oa / sa, 4) AS ratio_a, round_even(ob / sb, 4) AS ratio_b, round_even((oa * sa + ob * sb) / (sa * sa + sb * sb), 4) AS ratio FROM o"""


@query(f"WITH p AS ({PARTIES}), {_OWN.format(least=2)}")
def exposure_leave_one_out(t):
    return panels.exposure_to_own(parties(t), "yr", "dem", "rep")


_VARIANTS = "WITH p AS (SELECT v || ':' || yr AS yr, dem, rep FROM (SELECT unnest(CASE WHEN dem + rep >= 25 THEN ['all', 'large'] ELSE ['all'] END) AS v, * FROM (" + PARTIES + "))), "


@query(_VARIANTS + _OWN.format(least=2))
def exposure_variants(t):
    p = parties(t)
    n = F.col("dem") + F.col("rep")
    rows = p.withColumn("v", F.explode(F.when(n >= 25, F.array(F.lit("all"), F.lit("large"))).otherwise(F.array(F.lit("all")))))
    return panels.exposure_to_own(rows.withColumn("yr", F.concat_ws(":", "v", F.col("yr").cast("string"))), "yr", "dem", "rep")


@query("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def pivot_flags(t):
    return t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996), 2) AS y1996, round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 2) AS y1997 FROM orders GROUP BY 1""")
def pivot_years(t):
    p = yearly(t).groupBy("o_orderpriority").pivot("yr", [1996, 1997]).agg(F.round(F.sum("o_totalprice"), 2))
    return p.toDF("o_orderpriority", "y1996", "y1997")


@query("""SELECT o_custkey, measure, value FROM (UNPIVOT (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*)::DOUBLE AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1) ON total, n, top INTO NAME measure VALUE value)""")
def unpivot_measures(t):
    wide = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).cast("double").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))
    return wide.unpivot(["o_custkey"], ["total", "n", "top"], "measure", "value")


@query("""WITH x AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, o_orderstatus = 'F' AS total, o_totalprice FROM orders), m AS (SELECT *, bool_or(total) OVER (PARTITION BY o_custkey, yr) AS has FROM x)
SELECT o_custkey, yr, round(sum(o_totalprice), 2) AS votes FROM m WHERE total = has GROUP BY 1, 2""")
def prefer_total_rows(t):
    x = yearly(t).withColumn("total", F.col("o_orderstatus") == "F")
    sums = x.groupBy("o_custkey", "yr").agg(F.bool_or("total").alias("has"), F.sum(F.when(F.col("total"), F.col("o_totalprice"))).alias("a"), F.sum(F.when(~F.col("total"), F.col("o_totalprice"))).alias("b"))
    return sums.select("o_custkey", "yr", F.round(F.when(F.col("has"), F.col("a")).otherwise(F.col("b")), 2).alias("votes"))


@query(f"""WITH f AS ({_FLOW}), e AS (SELECT dest AS k, yr, returns AS inn, 0 AS outn, 0 AS stay, agi AS agi_in, 0.0 AS agi_out FROM f WHERE origin <> dest UNION ALL SELECT origin, yr, 0, returns, 0, 0, agi FROM f WHERE origin <> dest UNION ALL SELECT origin, yr, 0, 0, returns, 0, 0 FROM f WHERE origin = dest)
SELECT k, yr, sum(inn)::BIGINT AS inflow, sum(outn)::BIGINT AS outflow, sum(stay)::BIGINT AS stayers, (sum(inn) - sum(outn))::BIGINT AS net, (sum(inn) + sum(outn))::BIGINT AS gross, round((sum(inn) - sum(outn)) / nullif(sum(outn) + sum(stay), 0)::DOUBLE, 6) AS net_rate,
round(sum(agi_in) / nullif(sum(inn), 0) - sum(agi_out) / nullif(sum(outn), 0), 2) AS income_gap FROM e GROUP BY 1, 2""")
def flow_balance(t):
    move, ends = F.col("origin") != F.col("dest"), F.array(F.struct(F.col("dest").alias("k"), F.lit(True).alias("inward")), F.struct(F.col("origin").alias("k"), F.lit(False).alias("inward")))
    stays = F.array(F.struct(F.col("origin").alias("k"), F.lit(None).cast("boolean").alias("inward")))
    e = flows(t).select("yr", "returns", "agi", F.explode(F.when(move, ends).otherwise(stays)).alias("e")).select("yr", "returns", "agi", "e.*")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    inward, outward = F.col("inward"), ~F.col("inward")
    s = e.groupBy("k", "yr").agg(total("returns", inward).alias("inflow"), total("returns", outward).alias("outflow"), total("returns", F.col("inward").isNull()).alias("stayers"), total("agi", inward).alias("ai"), total("agi", outward).alias("ao"))
    return s.select("k", "yr", "inflow", "outflow", "stayers", (F.col("inflow") - F.col("outflow")).alias("net"), (F.col("inflow") + F.col("outflow")).alias("gross"),
                    F.round(F.try_divide((F.col("inflow") - F.col("outflow")).cast("double"), F.col("outflow") + F.col("stayers")), 6).alias("net_rate"), F.round(F.try_divide(F.col("ai"), F.col("inflow")) - F.try_divide(F.col("ao"), F.col("outflow")), 2).alias("income_gap"))


@query(f"""WITH f AS ({_FLOW}) SELECT o.n_regionkey AS origin, d.n_regionkey AS dest, yr, sum(returns)::BIGINT AS returns FROM f JOIN nation o ON origin = o.n_nationkey JOIN nation d ON dest = d.n_nationkey WHERE o.n_regionkey <> d.n_regionkey GROUP BY 1, 2, 3""")
def flow_rollup_pairs(t):
    region = t.nation.select("n_nationkey", "n_regionkey")
    f = flows(t).join(region.toDF("origin", "ro"), "origin").join(region.toDF("dest", "rd"), "dest").filter("ro <> rd")
    return f.groupBy(F.col("ro").alias("origin"), F.col("rd").alias("dest"), "yr").agg(F.sum("returns").alias("returns"))


_YEARLY = "SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2"


def customer_years(t):
    return yearly(t).groupBy("o_custkey", "yr").agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"WITH y AS ({_YEARLY}) SELECT o_custkey, round(coalesce(avg(v) FILTER (WHERE yr BETWEEN 1996 AND 1997), arg_max(v, yr) FILTER (WHERE yr <= 2000)), 4) AS profile FROM y GROUP BY 1")
def profile_avg_else_last(t):
    return customer_years(t).groupBy("o_custkey").agg(F.round(F.coalesce(F.avg(F.when(F.col("yr").between(1996, 1997), F.col("v"))), F.max_by(F.when(F.col("yr") <= 2000, F.col("v")), F.when(F.col("yr") <= 2000, F.col("yr")))), 4).alias("profile"))


@query(f"""WITH y AS ({_YEARLY}), u AS (SELECT yr, 'value' AS variable, CASE WHEN v > 200000 THEN v END AS x FROM y UNION ALL SELECT yr, 'count', CASE WHEN n > 1 THEN n::DOUBLE END FROM y)
SELECT variable, round(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE yr >= 1998), 6) AS coverage, max(yr) FILTER (WHERE x IS NOT NULL) AS last_year FROM u GROUP BY 1""")
def variable_catalog(t):
    wide = customer_years(t).select("yr", F.when(F.col("v") > 200000, F.col("v")).alias("value"), F.when(F.col("n") > 1, F.col("n").cast("double")).alias("count"))
    u = wide.unpivot(["yr"], ["value", "count"], "variable", "x")
    return u.groupBy("variable").agg(F.round(F.avg(F.when(F.col("yr") >= 1998, F.col("x").isNotNull().cast("double"))), 6).alias("coverage"), F.max(F.when(F.col("x").isNotNull(), F.col("yr"))).alias("last_year"))


@query("""WITH m AS (SELECT l_suppkey, p_type, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT p_type, sum(d) / sum(w) AS rate FROM m WHERE p_type <> 'PROMO' GROUP BY 1),
j AS (SELECT l_suppkey, w, d, rate FROM m LEFT JOIN r USING (p_type)), a AS (SELECT l_suppkey, sum(rate * w) / sum(w) FILTER (WHERE rate IS NOT NULL) AS predicted, sum(w) FILTER (WHERE rate IS NOT NULL) / sum(w) AS coverage, sum(d) / sum(w) AS actual FROM j GROUP BY 1)
SELECT l_suppkey, round(predicted, 6) AS predicted, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.7 THEN round(actual - predicted, 6) END AS gap FROM a""")
def predicted_from_mix(t):
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum("l_quantity").alias("w"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("d"))
    r = m.filter("p_type <> 'PROMO'").groupBy("p_type").agg((F.sum("d") / F.sum("w")).alias("rate"))
    known = F.sum(F.when(F.col("rate").isNotNull(), F.col("w")))
    a = m.join(r, "p_type", "left").groupBy("l_suppkey").agg(panels.weighted_mean(F.col("rate"), F.col("w")).alias("predicted"), (known / F.sum("w")).alias("coverage"), (F.sum("d") / F.sum("w")).alias("actual"))
    return a.select("l_suppkey", F.round("predicted", 6).alias("predicted"), F.round("coverage", 6).alias("coverage"), F.when(F.col("coverage") >= 0.7, F.round(F.col("actual") - F.col("predicted"), 6)).alias("gap"))


@query("""WITH c AS (SELECT c_nationkey % 10 AS area, c_nationkey AS part, count(*)::DOUBLE AS pop, CASE WHEN c_nationkey = 3 THEN NULL ELSE median(c_acctbal) END AS med FROM customer GROUP BY 1, 2)
SELECT area, sum(pop) AS pop, count(*) AS parts, CASE WHEN count(med) = count(*) THEN round(sum(med * pop) / sum(pop), 4) END AS med FROM c GROUP BY 1""")
def merge_areas(t):
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("pop"), F.median("c_acctbal").alias("m")).withColumn("med", F.when(F.col("c_nationkey") != 3, F.col("m")))
    whole = F.count("med") == F.count(F.lit(1))
    return c.groupBy((F.col("c_nationkey") % 10).alias("area")).agg(F.sum("pop").alias("pop"), F.count(F.lit(1)).alias("parts"), F.when(whole, F.round(F.sum(F.col("med") * F.col("pop")) / F.sum("pop"), 4)).alias("med"))


@query("""WITH g AS (SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT p_brand, (a / sum(a) OVER ()) / (b / sum(b) OVER ()) AS ratio FROM g),
k AS (SELECT p_brand, ratio, row_number() OVER (ORDER BY ratio DESC, p_brand) AS top, row_number() OVER (ORDER BY ratio, p_brand) AS bottom FROM r) SELECT p_brand, round(ratio, 6) AS ratio, top <= 5 AS is_top FROM k WHERE top <= 5 OR bottom <= 5""")
def over_representation_topk(t):
    g = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "A").cast("double").alias("a"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("b"))
    g = staged(g, "brands")
    totals = g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    r = g.join(F.broadcast(totals), F.lit(True)).select("p_brand", F.try_divide(F.col("a") / F.col("ta"), F.col("b") / F.col("tb")).alias("ratio"))
    top = staged(r.orderBy(F.desc("ratio"), "p_brand").limit(5), "top")
    bottom = r.orderBy("ratio", "p_brand").limit(5).join(top.select("p_brand"), "p_brand", "left_anti")
    return top.withColumn("is_top", F.lit(True)).unionByName(bottom.withColumn("is_top", F.lit(False))).select("p_brand", F.round("ratio", 6).alias("ratio"), "is_top")


@query(f"""WITH p AS ({PARTIES}), u AS (SELECT l_suppkey, sum(dem) / sum(dem + rep)::DOUBLE AS s, sum(dem + rep) AS n FROM p GROUP BY 1 HAVING sum(dem + rep) > 0), m AS (SELECT var_samp(s) AS v, avg(s * (1 - s) / n) AS e, avg(s * (1 - s)) AS w FROM u)
SELECT round(greatest(v - e, 0), 8) AS between_units, r AS reliability, ceil(r / (1 - r) * w / nullif(greatest(v - e, 0), 0))::BIGINT AS least_n FROM m, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE]) AS r)""")
def reliability_thresholds(t):
    u = parties(t).groupBy("l_suppkey").agg(F.sum("dem").alias("d"), F.sum(F.col("dem") + F.col("rep")).alias("n")).filter("n > 0").withColumn("s", F.col("d").cast("double") / F.col("n"))
    m = u.agg(F.var_samp("s").alias("v"), F.avg(F.col("s") * (1 - F.col("s")) / F.col("n")).alias("e"), F.avg(F.col("s") * (1 - F.col("s"))).alias("w")).withColumn("b", F.greatest(F.col("v") - F.col("e"), F.lit(0.0)))
    return m.withColumn("r", F.explode(F.array(F.lit(0.5), F.lit(0.8)))).select(F.round("b", 8).alias("between_units"), F.col("r").alias("reliability"), F.ceil(F.try_divide(F.col("r") / (1 - F.col("r")) * F.col("w"), F.nullif("b", F.lit(0.0)))).alias("least_n"))


@query("""SELECT 'orders rows per customer' AS gate, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS value, 5.0::DOUBLE AS threshold, count(*)::DOUBLE / (SELECT count(*) FROM customer) >= 5 AS pass FROM orders
UNION ALL SELECT 'duplicate order keys', count(*)::DOUBLE, 0.0::DOUBLE, count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'price and quantity agree', round(corr(l_quantity, l_extendedprice), 6), 0.35::DOUBLE, round(corr(l_quantity, l_extendedprice), 6) >= 0.35 FROM lineitem""")
def validation_gates(t):
    rows = t.orders.agg(F.count(F.lit(1)).alias("o")).join(F.broadcast(t.customer.agg(F.count(F.lit(1)).alias("c"))), F.lit(True)).select(F.lit("orders rows per customer").alias("gate"), (F.col("o").cast("double") / F.col("c")).alias("value"), F.lit(5.0).alias("threshold")).withColumn("pass", F.col("value") >= F.col("threshold"))
    twice = panels.grain_violations(t.orders, ["o_orderkey"]).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("duplicate order keys").alias("gate"), "value", F.lit(0.0).alias("threshold"), (F.col("value") == 0).alias("pass"))
    agree = t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("value")).select(F.lit("price and quantity agree").alias("gate"), "value", F.lit(0.35).alias("threshold"), (F.col("value") >= 0.35).alias("pass"))
    return rows.unionByName(twice).unionByName(agree)


@query("""WITH m AS (SELECT label, i, avg(v) AS rel FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), w AS (SELECT i, (i % 5 + 1)::DOUBLE AS w FROM (SELECT DISTINCT i FROM m)),
s AS (SELECT label, sum(w * rel) / sum(w) AS score FROM m JOIN w USING (i) GROUP BY 1) SELECT label, round(score, 6) AS score, round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 4) AS z FROM s""")
def matrix_weighted_score(t):
    m = t.embeddings.select("label", F.posexplode("embedding").alias("p", "v")).groupBy("label", (F.col("p") + 1).alias("i")).agg(F.avg(F.col("v").cast("double")).alias("rel"))
    s = m.withColumn("w", (F.col("i") % 5 + 1).cast("double")).groupBy("label").agg((F.sum(F.col("w") * F.col("rel")) / F.sum("w")).alias("score"))
    return s.select("label", F.round("score", 6).alias("score"), F.round((F.col("score") - F.avg("score").over(Window.partitionBy())) / F.stddev_samp("score").over(Window.partitionBy()), 4).alias("z"))


@query("""WITH m AS (SELECT label, i, avg(v) AS rel FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
s AS (SELECT label, sum((i % 5 + 1)::DOUBLE * rel) / sum((i % 5 + 1)::DOUBLE) AS score FROM m GROUP BY 1) SELECT label, round(score, 6) AS score, round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 4) AS z FROM s""")
def matrix_weighted_whole(t):
    """The score over all coordinates."""
    m = t.embeddings.select("label", F.posexplode("embedding").alias("p", "v")).groupBy("label", (F.col("p") + 1).alias("i")).agg(F.avg(F.col("v").cast("double")).alias("rel"))
    s = m.withColumn("w", (F.col("i") % 5 + 1).cast("double")).groupBy("label").agg((F.sum(F.col("w") * F.col("rel")) / F.sum("w")).alias("score"))
    return s.select("label", F.round("score", 6).alias("score"), F.round((F.col("score") - F.avg("score").over(Window.partitionBy())) / F.stddev_samp("score").over(Window.partitionBy()), 4).alias("z"))


@query("SELECT n_regionkey AS state, sum(n)::BIGINT AS n, round(avg(CASE WHEN c_nationkey % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS multistate FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def first_state_rollup(t):
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    states = F.when(F.col("c_nationkey") % 2 == 0, F.array("n_regionkey", F.lit(99))).otherwise(F.array("n_regionkey"))
    return c.withColumn("s", states).groupBy(F.col("s")[0].alias("state")).agg(F.sum("n").alias("n"), F.round(F.avg((F.size("s") > 1).cast("double")), 6).alias("multistate"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem) SELECT l_orderkey, l_linenumber, round(avg(l_quantity), 6) AS quantity, min(l_returnflag) AS flag, count(*) AS clashes FROM d GROUP BY 1, 2""")
def average_repeats(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").dropDuplicates()
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.min("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("clashes"))


@query(f"""WITH y AS ({_YEARLY}), m AS (SELECT max(yr) AS last FROM y) SELECT o_custkey, sum(n) FILTER (WHERE yr > last - 2)::BIGINT AS recent, sum(n) FILTER (WHERE yr BETWEEN last - 5 AND last - 4)::BIGINT AS early,
round(ln(1 + coalesce(sum(n) FILTER (WHERE yr > last - 2), 0)) - ln(1 + coalesce(sum(n) FILTER (WHERE yr BETWEEN last - 5 AND last - 4), 0)), 6) AS growth, round(median(v), 4) AS mid FROM y, m GROUP BY 1 HAVING sum(n) >= 5""")
def two_window_growth(t):
    y = customer_years(t)
    y = y.join(F.broadcast(y.agg(F.max("yr").alias("last"))), F.lit(True))  # one row
    recent, early = F.sum(F.when(F.col("yr") > F.col("last") - 2, F.col("n"))), F.sum(F.when(F.col("yr").between(F.col("last") - 5, F.col("last") - 4), F.col("n")))
    g = y.groupBy("o_custkey").agg(recent.alias("recent"), early.alias("early"), F.sum("n").alias("total"), F.round(F.median("v"), 4).alias("mid")).filter("total >= 5")
    return g.select("o_custkey", "recent", "early", F.round(F.log1p(F.coalesce("recent", F.lit(0))) - F.log1p(F.coalesce("early", F.lit(0))), 6).alias("growth"), "mid")


@query("""WITH w AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, CASE WHEN l_suppkey % 2 = 0 THEN count(*) FILTER (WHERE l_returnflag = 'N') END AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((a * 1.0 + r * 3.0 + coalesce(n, 0) * 2.0) / (a + r + coalesce(n, 0))::DOUBLE, 6) AS score FROM w""")
def sector_mix_score(t):
    c = lambda f: F.count_if(F.col("l_returnflag") == f)
    w = t.lineitem.groupBy("l_suppkey").agg(c("A").alias("a"), c("R").alias("r"), F.when(F.col("l_suppkey") % 2 == 0, c("N")).alias("n"))
    long = w.unpivot(["l_suppkey"], ["a", "r", "n"], "sector", "weight")
    score = F.when(F.col("sector") == "a", 1.0).when(F.col("sector") == "r", 3.0).otherwise(2.0)
    return long.groupBy("l_suppkey").agg(F.round(F.try_divide(F.sum(score * F.col("weight")), F.sum("weight").cast("double")), 6).alias("score"))


@query("""WITH g AS (SELECT s_nationkey, sum(l_quantity) FILTER (WHERE p_type IN ('PROMO', 'SMALL')) / sum(l_quantity) AS share, avg(s_acctbal) AS bal FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT round(avg(share), 6) AS mean_share, round(corr(share, bal), 6) AS r, count(*) AS places FROM g""")
def selected_group_share(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    g = rows.groupBy("s_nationkey").agg((F.sum(F.when(F.col("p_type").isin("PROMO", "SMALL"), F.col("l_quantity"))) / F.sum("l_quantity")).alias("share"), F.avg("s_acctbal").alias("bal"))
    return g.agg(F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.corr("share", "bal"), 6).alias("r"), F.count(F.lit(1)).alias("places"))
