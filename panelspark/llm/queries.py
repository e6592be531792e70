"""The registered queries of this subpackage, with SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import alignment, chat, decontaminate, divergence, licenses, mixing, quality, secrets, sharding, simhash, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Host and path rules of the query, and globs for the urls that none of them fits.
URL_RULES = [urlfilter.Rule("net/", False), urlfilter.Rule("example.net/en/", True), urlfilter.Rule("example.com/de/", False), urlfilter.Rule("org/fr/", True)]
BLOCK_GLOBS = ["*casino* *", "*.ads.* *", "* */ads/*", "* *.exe"]
ALLOW_GLOBS = ["*.edu /*"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, block_globs=BLOCK_GLOBS, allow_globs=ALLOW_GLOBS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A conversation whose texts look like control strings.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(odd)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"])
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda p: p["label"]) for x in lists]))), ",")
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels("phrases").alias("base_labels"), labels("phrases", "matches").alias("labels"), "score")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_secrets, op3_decontamination, op4_quality, op5_url_filter, op6_toxicity, op7_mixing, op8_sharding, op9_chat_format, op10_simhash, op11_licenses, op12_cross_tokenizer, op13_divergence)}

_HOST = "CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_WS = r"[^\x20\x09-\x0D]"
_BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def _limits(name: str, by: str) -> str:
    """Weight and cutoff of each metric by groups of the sketch."""
    value = f"CASE WHEN bin = 0 THEN 0.0::DOUBLE ELSE 1e-6::DOUBLE * pow({quality.GAMMA}::DOUBLE, bin - 0.5) END"

    def part(p: str, where: str) -> str:
        rows = f"SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bin) AS below, sum(n) OVER (PARTITION BY {by}metric) AS size FROM (SELECT {by}metric, bin, sum(n) AS n FROM sk WHERE {where} GROUP BY {by}metric, bin)"
        q = ", ".join(f"min({value}) FILTER (WHERE below >= size * {q}::DOUBLE) AS {p}{c}" for c, q in (("10", 0.1), ("25", 0.25), ("75", 0.75)))
        return f"(SELECT {by}metric, max(size) AS {p}size, {q} FROM ({rows}) GROUP BY ALL) {p}"

    same = lambda p: " AND ".join(f"w.{c} IS NOT DISTINCT FROM {p}.{c}" for c in [*by.replace(" ", "").split(","), "metric"] if c)
    fence = f"{quality.FENCE}::DOUBLE"
    cut = f"CASE WHEN w75 > 0 THEN w75 + {fence} * (w75 - w25) WHEN t10 >= {quality.GAP} THEN s10 / 2 ELSE s75 + {fence} * greatest(s75 - s25, s25) END"
    whole = "".join(f"w.{c}, " for c in by.replace(" ", "").split(",") if c) + "w.metric"
    chosen = f"SELECT {whole}, CASE WHEN w75 > 0 OR t10 >= {quality.GAP} THEN wsize ELSE coalesce(ssize, 0) END AS size, coalesce({cut}, 0) AS cut FROM {part('w', 'NOT times')} LEFT JOIN {part('s', 'NOT times AND bin > 0')} ON {same('s')} LEFT JOIN {part('t', 'times')} ON {same('t')}"
    return f"{name} AS (SELECT *, size / (size + {quality.WEIGHT}::DOUBLE) AS part FROM ({chosen}))"


ORACLE_SQL = {
    "op4_quality": f"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WS}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))),
h AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS k FROM g WHERE c > 1) GROUP BY 1),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN h USING (rid)),
v AS ({" UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS metric, coalesce({x}::DOUBLE / nullif({y}, 0), 0.0) AS value, {x}::DOUBLE / {unit or 'NULL'} AS times, {_BASE_FAILED} AS failed FROM m WHERE n_words > 0" for k, (x, y, unit) in quality.METRICS.items())}),
b AS (SELECT lang, source, metric, value, false AS times FROM v WHERE NOT failed UNION ALL SELECT lang, source, metric, times, true FROM v WHERE NOT failed AND times > 0),
sk AS (SELECT lang, source, metric, times, CASE WHEN value <= 1e-6 THEN 0 ELSE ceil(ln(value / 1e-6::DOUBLE) / ln({quality.GAMMA}::DOUBLE)) END AS bin, count(*) AS n FROM b GROUP BY ALL),
{_limits("own", "lang, source, ")}, {_limits("lg", "lang, ")}, {_limits("cp", "")},
k AS (SELECT rid, bool_and(coalesce(value <= CASE WHEN cp.part > 0 THEN own.part * own.cut + (1 - own.part) * (lg.part * lg.cut + (1 - lg.part) * cp.cut) END, true)) AS fits FROM v
      JOIN own ON v.lang IS NOT DISTINCT FROM own.lang AND v.source IS NOT DISTINCT FROM own.source AND v.metric = own.metric JOIN lg ON v.lang IS NOT DISTINCT FROM lg.lang AND v.metric = lg.metric JOIN cp ON v.metric = cp.metric GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_FAILED} AS base_failed,
       NOT {_BASE_FAILED} AND coalesce(fits, true) AS kept FROM m LEFT JOIN k USING (rid)""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NOT NULL AS hr, text IS NOT NULL AS ht FROM c),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[|\\]', '', 'g')) + 10 AS chars FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, hr, role, ht, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, hr, role, ht, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY 1""",
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to FROM m""",
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_url_filter": f"""
WITH u AS (SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN ends_with('.' || host, '.edu') AND starts_with(path, '/') THEN 'allow'
  WHEN contains(host, 'casino') OR contains('.' || host, '.ads.') OR contains(path, '/ads/') OR ends_with(path, '.exe') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY 1),
g AS (SELECT o.lang, o.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(l.v, 0)::HUGEINT AS v, l.total AS all_total FROM (SELECT DISTINCT lang, source FROM d) o
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) t USING (lang, source) LEFT JOIN l ON l.lang = o.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (g.all_total + g.v) AS q
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source != h.source
        LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(r - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM w),
f AS (SELECT arg_min((total - below) / above, cap / weight) AS fill FROM l WHERE (total - below) / above <= cap / weight),
t AS (SELECT source, source_size, least(cap, fill * weight) AS target FROM w, f),
o AS (SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size) END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::BIGINT AS taken FROM o""",
}
