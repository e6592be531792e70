"""Quality rules with DataFrame functions only: cutoffs that follow the corpus, from mergeable quantile sketches.

Each text gets its metrics once (no text goes further). For each metric the values of a (language, source) are sketched as
counts in logarithmic bins (ratio GAMMA, so a quantile is within about 1 %): a sketch is a set of (bin, count) rows, adds by
summing counts, and is built by one map-side aggregation, so a source with a third of all rows costs no task more. The
sketches of a language are the sums of its sources', the corpus's the sums of those.

A cutoff follows the sketch of its group, and no metric has a constant one:
 * Where more than a quarter of the texts show the metric, it is `Q3 + fence * (Q3 - Q1)` of all texts.
 * Else the sketch without its zeros decides, as Q1 and Q3 are 0. Where the texts that show the metric begin far from zero, with
   GAP occurrences or more in nine of ten, they are a kind of their own and the cutoff is half of their first tenth, in the gap.
   Where they begin with single occurrences, clean texts have some too, and the cutoff is `Q3 + fence * max(Q3 - Q1, Q1)` of them, Q1 being their distance from zero.
Each cutoff is drawn to its language's as far as the group is small: a group with n texts (n that show the metric, for a fence
around those) has weight n / (n + weight) in it, a language in its own likewise against the corpus. The cutoffs are joined to
the metrics and texts above one are rejected. Texts that fail the base rule go anyway and are not in the sketches.

Defined results: a null text has no words and fails the base rule; null languages and sources are groups of their own; very
long texts are measured whole; repeated rows agree; a text with a metric equal to its cutoff is kept; an empty table has no
cutoffs, nor has a metric that no text shows. Other columns are not read, so clashing
names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import materialize
from panelspark.llm.secrets import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratio of bins, width of the fence, the number of texts at which a group weighs as much as the wider group, and occurrences that make a gap.
GAMMA, FENCE, WEIGHT, GAP = 1.02, 6.0, 10.0, 8.0
#: Metrics as (count, of how many), and how many counts one occurrence has (None: the metric is in every text).
METRICS = {"symbols_per_word": ("n_symbols", "n_words", 1), "chars_per_word": ("word_chars", "n_words", None), "dup_line_share": ("n_dup_lines", "n_lines", 1),
           "repeat_share": ("n_repeat_words", "n_words", 5)}


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more."""

    def by_hash(h: Column) -> Column:
        # sorted (window hash, place); a window repeats if a neighbour has its hash
        keyed = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda v, i: F.least(F.coalesce(F.get(p, i + 1) - v, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, v: s + v)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(keyed, places), covered))

    # each word is hashed once, a window is the hash of its words' hashes
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) > window, let(hashes, by_hash)).otherwise(F.lit(0).cast("long"))


def measure(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", window: int = 5) -> DataFrame:
    """A row per document with its counts; the text ends here."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, window).alias("n_repeat_words")))
    return rows.select(
        "doc_id", "lang", "source", counted.alias("c"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "n_lines")


def _values() -> dict[str, Column]:
    return {k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for k, (a, b, _) in METRICS.items()}


def _bin(value: Column) -> Column:
    """Bin 0 holds values up to 1e-6."""
    return F.when(value <= 1e-6, 0).otherwise(F.ceil(F.log(value / 1e-6) / F.log(F.lit(GAMMA)))).cast("int")


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, of, bin, n): `of` is `share` for the metric's values, `times` for occurrences where there are any."""
    values = _values()
    each = [F.struct(F.lit(k).alias("metric"), F.lit("share").alias("of"), v.alias("value")) for k, v in values.items()]
    each += [F.struct(F.lit(k).alias("metric"), F.lit("times").alias("of"), (F.col(a) / F.lit(float(unit))).alias("value")) for k, (a, _, unit) in METRICS.items() if unit]
    rows = measured.filter("n_words > 0").select("lang", "source", F.explode(F.array(*each)).alias("v")).filter("v.of = 'share' or v.value > 0")
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), F.col("v.of").alias("of"), _bin(F.col("v.value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "metric", "of", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], probabilities: dict[str, float]) -> DataFrame:
    """One row a group and metric: its size and the value at each probability."""
    group = Window.partitionBy(*by, "metric", "of")
    below = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = sketches.withColumns({"below": F.sum("n").over(below), "size": F.sum("n").over(group)})
    value = F.when(F.col("bin") == 0, 0.0).otherwise(1e-6 * F.pow(F.lit(GAMMA), F.col("bin") - 0.5))
    return rows.groupBy(*by, "metric", "of").agg(F.max("size").alias("size"), *[F.min(F.when(F.col("below") >= F.col("size") * p, value)).alias(c) for c, p in probabilities.items()])


def limits(sketches: DataFrame, by: list[str], fence: float) -> DataFrame:
    """(by, metric, size, cut) of groups; a metric that no text of a group shows has size 0 and no cutoff."""
    quarters = {"q10": 0.1, "q1": 0.25, "q3": 0.75}
    whole = quantiles(sketches.filter("of = 'share'"), by, quarters)
    shown = quantiles(sketches.filter("of = 'share' and bin > 0"), by, quarters)
    times = quantiles(sketches.filter("of = 'times'"), by, {"q10": 0.1})
    key = [*by, "metric"]
    named = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in key], F.col("size").alias(f"{name}_size"), *[F.col(q).alias(f"{name}_{q}") for q in quarters if q in df.columns])
    out = named(whole, "w")
    for df, name in ((shown, "s"), (times, "t")):
        same = F.lit(True)
        for c in key:
            same = same & F.col(f"w_{c}").eqNullSafe(F.col(f"{name}_{c}"))
        out = out.join(named(df, name), same, "left")
    spread = lambda x: F.col(f"{x}_q3") - F.col(f"{x}_q1")
    common = F.col("w_q3") > 0
    cut = F.when(common, F.col("w_q3") + fence * spread("w")).when(F.col("t_q10") >= GAP, F.col("s_q10") / 2).otherwise(F.col("s_q3") + fence * F.greatest(spread("s"), F.col("s_q1")))
    size = F.when(common | (F.col("t_q10") >= GAP), F.col("w_size")).otherwise(F.coalesce("s_size", F.lit(0)))
    return out.select(*[F.col(f"w_{c}").alias(c) for c in key], size.alias("size"), F.coalesce(cut, F.lit(0.0)).alias("cut"))


def cutoffs(sketches: DataFrame, *, fence: float = FENCE, weight: float = WEIGHT) -> DataFrame:
    """(lang, source, and for each metric the highest value that is kept; null where no text of the corpus shows it)."""

    def level(by: list[str], name: str) -> DataFrame:
        q = limits(sketches if len(by) == 2 else merge(sketches, *by), by, fence)
        return q.select(*[F.col(c).alias(f"{name}_{c}") for c in [*by, "metric"]], F.col("cut").alias(name), (F.col("size") / (F.col("size") + weight)).alias(f"{name}_part"))

    own, language, corpus = level(["lang", "source"], "own"), level(["lang"], "language"), level([], "corpus")
    joined = (own.join(language, F.col("own_lang").eqNullSafe(F.col("language_lang")) & (F.col("own_metric") == F.col("language_metric")))
              .join(corpus, F.col("own_metric") == F.col("corpus_metric")))
    wider = F.col("language_part") * F.col("language") + (1 - F.col("language_part")) * F.col("corpus")
    limit = F.when(F.col("corpus_part") > 0, F.col("own_part") * F.col("own") + (1 - F.col("own_part")) * wider)
    return joined.groupBy(F.col("own_lang").alias("cut_lang"), F.col("own_source").alias("cut_source")).pivot("own_metric", list(METRICS)).agg(F.max(limit))


def judge(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE, weight: float = WEIGHT) -> DataFrame:
    """The counts of measure() with base_failed and kept."""
    measured = materialize(measure(documents, doc_id=doc_id, text=text, lang=lang, source=source), "quality")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = measured.join(cutoffs(sketch(measured.filter(~base)), fence=fence, weight=weight), F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left")
    fits = F.lit(True)
    for k, v in _values().items():
        fits = fits & (v <= F.coalesce(F.col(k), F.lit(float("inf"))))
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & fits).alias("kept"))
