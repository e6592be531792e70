"""Queries on sources, codes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import codes, names
from panelspark.plans.registry import query
from panelspark.sources import quoted, readers


@query("SELECT c_custkey, c_name AS raw, ltrim(regexp_extract(c_name, '(\\d+)', 1), '0') AS doc_id FROM customer")
def norm_doc_id(t):
    return t.customer.select("c_custkey", F.col("c_name").alias("raw"), codes.doc_number(F.col("c_name")).alias("doc_id"))


@query("""
WITH v AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || '.0' WHEN 1 THEN '00' || s_suppkey WHEN 2 THEN 're-' || s_suppkey ELSE s_name END AS raw FROM supplier),
b AS (SELECT *, regexp_replace(upper(trim(raw)), '\\.0+$', '') AS bare FROM v)
SELECT s_suppkey, nullif(CASE WHEN regexp_full_match(bare, '\\d+') THEN ltrim(bare, '0') ELSE regexp_replace(bare, '[^A-Z0-9]', '', 'g') END, '') AS pid FROM b""")
def norm_patent_number(t):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 1, F.concat(F.lit("00"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("re-"), k.cast("string"))).otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", codes.patent_number(raw).alias("pid"))


@query("""SELECT o_orderkey, nullif(CASE WHEN length((o_custkey % 1000)::VARCHAR) >= 6 THEN (o_custkey % 1000)::VARCHAR ELSE lpad((o_custkey % 1000)::VARCHAR, 6, '0') END, '000000') AS gvkey,
nullif(regexp_replace((o_orderkey % 50)::VARCHAR || '.0', '\\.0+$', ''), '') AS code FROM orders""")
def firm_key_pad(t):
    return t.orders.select("o_orderkey", codes.firm_key((F.col("o_custkey") % 1000).cast("string")).alias("gvkey"), codes.float_text(F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(".0"))).alias("code"))


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '04' WHEN 1 THEN '06' WHEN 2 THEN '36' WHEN 3 THEN '48' END AS state,
CASE WHEN n_nationkey % 2 = 0 THEN lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0') ELSE lpad((n_nationkey + 6000)::VARCHAR, 5, '0') END AS county FROM nation""")
def place_codes(t):
    county = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 6000)
    return t.nation.select("n_nationkey", codes.mapped(F.col("n_regionkey").cast("string"), {"0": "04", "1": "06", "2": "36", "3": "48"}).alias("state"), codes.county_code(F.col("n_regionkey"), county).alias("county"))


@query("""SELECT p_partkey, nullif(substr(upper(replace(p_brand || ' 3/08', ' ', '')), 1, 4), '') AS subclass, nullif(split_part(upper(replace(p_brand || ' 3/08', ' ', '')), '/', 1), '') AS main_group FROM part""")
def class_code_parts(t):
    return t.part.select("p_partkey", codes.class_parts(F.concat("p_brand", F.lit(" 3/08"))).alias("c")).select("p_partkey", "c.*")


@query("""SELECT p_partkey, coalesce(starts_with(p_type, 'S') OR starts_with(p_type, 'M'), false) AS broad, coalesce(p_brand LIKE 'Brand#1%', false) AS narrow,
coalesce(p_brand LIKE 'Brand#1%' OR p_type IN ('PROMO', 'ECONOMY'), false) AS either FROM part""")
def class_rule_flags(t):
    narrow = codes.any_prefix(F.col("p_brand"), ["Brand#1"])
    return t.part.select("p_partkey", codes.any_prefix(F.col("p_type"), ["S", "M"]).alias("broad"), narrow.alias("narrow"), (narrow | F.coalesce(F.col("p_type").isin("PROMO", "ECONOMY"), F.lit(False))).alias("either"))


@query("""SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(CASE toxic WHEN 0 THEN 'Utility' WHEN 1 THEN 'Design' END, 'utility') ILIKE 'utility' AND coalesce(quality, 1) = 1""")
def filter_default_keep(t):
    kind = F.when(F.col("toxic") == 0, "Utility").when(F.col("toxic") == 1, "Design")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").filter((F.coalesce(F.lower(kind), F.lit("utility")) == "utility") & (F.coalesce("quality", F.lit(1)) == 1)).select("doc_id", "toxic")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate::DATE END AS filed, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE year(o_orderdate)::INTEGER END AS yr FROM orders""")
def date_year_mixed(t):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return t.orders.select("o_orderkey", codes.mixed_date(text).alias("filed")).withColumn("yr", F.year("filed"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN 'late' END AS period FROM orders""")
def period_bins(t):
    return t.orders.select("o_orderkey", codes.binned(F.year("o_orderdate"), [(1995, 1996, "early"), (1997, 1999, "late")]).alias("period"))


_LEGAL = "|".join(names.LEGAL)
_ABBREV = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.ABBREVIATIONS.items())


@query(f"""
WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'The ' || c_name || ' Corporation' WHEN 1 THEN c_name || ' & Sons (Old) Co., Inc.' WHEN 2 THEN 'I B M ' || c_name || ' /DE/ Holdings' WHEN 3 THEN c_name || ' Technologies Ltd - Cl A'
  WHEN 4 THEN 'American Pharmaceuticals National ' || c_name || ' Class-class B, Group' WHEN 5 THEN 'the the ' || c_name || ' America /new/LLC' ELSE c_name END AS raw FROM customer),
a AS (SELECT k, raw, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\(.*?\\)', ' ', 'g'), '/[a-z]{{2,4}}/?', ' ', 'g'), '-\\s*(cl|class)\\s*[a-z]\\b', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g') AS s FROM r),
b AS (SELECT k, raw, array_to_string(list_transform(regexp_split_to_array(trim(s), ' +'), lambda w: CASE w {_ABBREV} ELSE w END), ' ') AS s FROM a),
c AS (SELECT k, raw, replace(s, 'i b m ', 'ibm ') AS s FROM b)
SELECT k, raw, trim(regexp_replace(regexp_replace(s, '^(?:the(?: |$))+', ''), '(?:(?:^| )(?:{_LEGAL}))+$', '')) AS norm FROM c""")
def norm_company_name(t):
    m, name = F.col("c_custkey") % 7, F.col("c_name")
    raw = (F.when(m == 0, F.concat(F.lit("The "), name, F.lit(" Corporation"))).when(m == 1, F.concat(name, F.lit(" & Sons (Old) Co., Inc."))).when(m == 2, F.concat(F.lit("I B M "), name, F.lit(" /DE/ Holdings")))
           .when(m == 3, F.concat(name, F.lit(" Technologies Ltd - Cl A"))).when(m == 4, F.concat(F.lit("American Pharmaceuticals National "), name, F.lit(" Class-class B, Group")))
           .when(m == 5, F.concat(F.lit("the the "), name, F.lit(" America /new/LLC"))).otherwise(name))
    return t.customer.select(F.col("c_custkey").alias("k"), raw.alias("raw"), names.company(raw).alias("norm"))


@query("""WITH r AS (SELECT p_partkey, lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' & Helpers (Senior)' WHEN 1 THEN ', All Other' WHEN 2 THEN ', Except Red' WHEN 3 THEN ', All Other (note)' ELSE ' All Other, Small except (b) c' END) AS s FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(s, '&', ' and '), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\b(all other|except.*$)', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM r""")
def norm_title(t):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " & Helpers (Senior)").when(k == 1, ", All Other").when(k == 2, ", Except Red").when(k == 3, ", All Other (note)").otherwise(" All Other, Small except (b) c")
    return t.part.select("p_partkey", names.title(F.concat("p_name", tail)).alias("norm"))


@query("""WITH r AS (SELECT n_nationkey, n_name || '-Fort ' || n_name || '/Low, ' || CASE WHEN n_nationkey % 2 = 0 THEN 'TX-OK' ELSE 'NY' END || ' Metro' AS s FROM nation)
SELECT n_nationkey, lower(n_name) AS first_city, 3::INTEGER AS n_cities, CASE WHEN n_nationkey % 2 = 0 THEN 'TX' ELSE 'NY' END AS first_state, n_nationkey % 2 = 0 AS multistate FROM r JOIN nation USING (n_nationkey)""")
def parse_place_name(t):
    raw = F.concat("n_name", F.lit("-Fort "), "n_name", F.lit("/Low, "), F.when(F.col("n_nationkey") % 2 == 0, "TX-OK").otherwise("NY"), F.lit(" Metro"))
    p = t.nation.select("n_nationkey", names.place(raw).alias("p"))
    return p.select("n_nationkey", F.col("p.cities")[0].alias("first_city"), F.size("p.cities").alias("n_cities"), F.col("p.states")[0].alias("first_state"), (F.size("p.states") > 1).alias("multistate"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(^| )the( |$)') THEN 'english' WHEN regexp_matches(text, '(^| )(der|die|und)( |$)') THEN 'german' WHEN regexp_matches(text, '(^| )(le|la|les)( |$)') THEN 'romance' ELSE 'other' END AS tag,
contains(text, '$') AS money, contains(text, '@') AS mail FROM documents""")
def regex_tag_first_match(t):
    rules = [("english", r"(^| )the( |$)"), ("german", r"(^| )(der|die|und)( |$)"), ("romance", r"(^| )(le|la|les)( |$)")]
    return t.documents.select("doc_id", codes.first_match(F.col("text"), rules, "other").alias("tag"), F.contains("text", F.lit("$")).alias("money"), F.contains("text", F.lit("@")).alias("mail"))


@query("""WITH r AS (SELECT p_partkey, p_size::VARCHAR || '0000' AS code, CASE WHEN p_partkey % 2 = 0 THEN 'Goods (3251, 3252 and ' || (3300 + p_size) || ' only)' ELSE p_name END AS title FROM part)
SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN regexp_extract_all(title, '\\d{4}') ELSE [substr(code, 1, 4)] END) AS code FROM r""")
def explode_combined_codes(t):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Goods (3251, 3252 and "), (F.col("p_size") + 3300).cast("string"), F.lit(" only)"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.explode(codes.member_codes(F.concat(F.col("p_size").cast("string"), F.lit("0000")), title)).alias("code"))


@query("""SELECT *, CASE WHEN pay >= 0 THEN pay END AS known FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN -1.0::DOUBLE ELSE abs(c_acctbal::BIGINT)::DOUBLE END AS pay, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS seen FROM customer)""")
def clean_numeric(t):
    whole = F.abs(F.rint("c_acctbal").cast("long"))
    text = F.when(F.col("c_custkey") % 7 == 0, "#").when(F.col("c_custkey") % 11 == 0, " -1").otherwise(F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("%")))
    pay = codes.clean_number(text)
    return t.customer.select("c_custkey", pay.alias("pay"), codes.unsuppressed(F.col("c_acctbal")).alias("seen"), codes.unsuppressed(pay).alias("known"))


@query(r"""SELECT doc_id, array_to_string((string_split(trim(regexp_replace('Doc' || '. ' || text, '\s+', ' ', 'g')), ' '))[1:25], ' ') AS words FROM documents""")
def text_first_words(t):
    flat = F.trim(F.regexp_replace(F.concat(F.lit("Doc. "), F.col("text")), r"\s+", " "))
    return t.documents.select("doc_id", F.array_join(F.slice(F.split(flat, " "), 1, 25), " ").alias("words"))


@query("""SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'metro' WHEN 1 THEN 'state' ELSE 'nation' END AS level, CASE WHEN s_nationkey % 3 = 0 THEN lpad((s_suppkey % 10000)::VARCHAR, 4, '0') || '0' ELSE s_suppkey::VARCHAR END AS area FROM supplier""")
def area_level_recode(t):
    code = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("C"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"))).otherwise(F.col("s_suppkey").cast("string"))
    level = F.when(F.col("s_nationkey") % 3 == 0, "metro").when(F.col("s_nationkey") % 3 == 1, "state").otherwise("nation")
    return t.supplier.select("s_suppkey", level.alias("level"), F.when(code.startswith("C"), F.concat(F.regexp_replace(code, "^C", ""), F.lit("0"))).otherwise(code).alias("area"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0.0 ELSE round(o_totalprice / pow(10.0, floor(log10(abs(o_totalprice))) - 2)) * pow(10.0, floor(log10(abs(o_totalprice))) - 2) END, 6) AS shown FROM orders""")
def round_signif(t):
    return t.orders.select("o_orderkey", F.round(codes.significant(F.col("o_totalprice"), 3), 6).alias("shown"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND contains(o_orderstatus, 'F')""")
def keep_one_level(t):
    return t.orders.filter(F.lower("o_orderpriority").isin("1-urgent", "2-high") & F.contains("o_orderstatus", F.lit("F"))).select("o_orderkey", "o_orderpriority")


@query("""SELECT doc_id::VARCHAR AS doc_id, text || ' "quoted" ' || chr(9) || 'tab' || chr(10) || chr(10) || '"",x' AS text FROM documents""")
def read_quoted_tsv(t):
    import uuid

    from panelspark.sources.staging import shared_folder

    path = f"{shared_folder(t.spark)}/tsv-{uuid.uuid4().hex}"
    text = F.concat("text", F.lit(' "quoted" \ttab\n\n"",x'))
    t.documents.select("doc_id", text.alias("text")).write.csv(path, sep="\t", header=True, quoteAll=True, escape='"')
    return quoted.read(t.spark, path, "\t")


@query("""SELECT l_orderkey::DOUBLE AS orderkey, l_returnflag AS flag, round(l_quantity, 2) AS quantity, round(l_discount, 2) AS discount FROM lineitem""")
def fixed_width_decode(t):
    whole = lambda c: F.lpad(F.rint(F.col(c) * 100).cast("long").cast("string"), 8, " ")
    lines = t.lineitem.select(F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.rpad("l_returnflag", 3, " "), whole("l_quantity"), whole("l_discount")).alias("value"))
    got = readers.fixed_width(lines, {"orderkey": (1, 12, 0), "flag": (13, 3, None), "quantity": (16, 8, 2), "discount": (24, 8, 2)})
    return got.withColumns({"quantity": F.round("quantity", 2), "discount": F.round("discount", 2)})


@query("""SELECT o_orderkey AS k, year(o_orderdate)::INTEGER AS yr, CASE WHEN year(o_orderdate) < 1998 THEN o_totalprice END AS price, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderstatus END AS status FROM orders""")
def union_by_name_yearfiles(t):
    y = t.orders.withColumn("yr", F.year("o_orderdate"))
    old = y.filter("yr < 1998").select(F.col("o_orderkey").alias("k"), "yr", F.col("o_totalprice").alias("price"))
    return readers.united([old, y.filter("yr >= 1998").select("yr", F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))])


@query("""SELECT event_id, key, value::BIGINT AS item FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) e, LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)""")
def json_props_extract(t):
    return readers.exploded_map(t.events.select("event_id", "props"), "props", "map<string,bigint>").select("event_id", "key", "item")


@query("""SELECT o_orderkey::VARCHAR AS doc, o_totalprice::DOUBLE AS price, NULL::VARCHAR AS remark FROM orders""")
def select_roles_missing_optional(t):
    return readers.select_roles(t.orders, {"doc": (["docid", "oorderkey"], "string", True), "price": (["price", "totalprice"], "double", True), "remark": (["remark", "comment"], "string", False)})
