"""Linking names and places: exact, by years, fuzzy within blocks, and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import names
from panelspark.operators import spread
from panelspark.sources.staging import staged


def exact(left: DataFrame, right: DataFrame, name: str, code: str) -> DataFrame:
    """left with the sorted codes that share its name, and whether there are several."""
    known = right.filter((F.col(name) != "") & F.col(code).isNotNull()).groupBy(name).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return left.join(known, name, "left").withColumn("ambiguous", F.coalesce(F.size("codes") > 1, F.lit(False)))


def _by_years(code: str, y0: str, y1: str, f0: str, f1: str) -> Column:
    """Rank of a candidate for a unit, the best one first."""
    end = F.when(F.col(y0).isNotNull() & F.col(y1).isNotNull() & F.col(f0).isNotNull() & F.col(f1).isNotNull(), F.least(y1, f1))
    overlap = end - F.greatest(y0, f0)
    kind = F.when(overlap >= 0, 0).when(end.isNull(), 1).otherwise(2)
    return F.struct(kind.alias("c"), F.when(kind == 0, -end).when(kind == 2, -overlap).otherwise(0).alias("e"), F.when(kind == 0, -overlap).otherwise(0).alias("o"), F.col(code).alias("k"))


def by_years(pairs: DataFrame, unit: str, code: str, y0: str, y1: str, f0: str, f1: str) -> DataFrame:
    """Of a unit's candidates: those whose years meet the unit's, by the later common end, then the longer overlap; then those of
    which a year is unknown; then those that never meet, by the smaller gap. Of equal ones the smaller code."""
    return pairs.groupBy(unit).agg(F.min_by(code, _by_years(code, y0, y1, f0, f1)).alias(code), F.count_distinct(code).alias("candidates"))


def name_by_years(left: DataFrame, right: DataFrame, name: str, unit: str, code: str, y0: str, y1: str, f0: str, f1: str) -> DataFrame:
    """by_years over all pairs of a unit and a code of its name, without the pairs: of codes with the same name and years the smallest
    decides, and units with the same name and years have the same holder. So only the distinct spans of a name meet, whose number
    the years bound, whatever the number of units and codes. Null names and codes meet nothing. A unit has one name; more are an
    error, as the codes of several names would have to be counted as one set."""
    known = staged(right.filter(F.col(name).isNotNull() & F.col(code).isNotNull()).select(name, code, f0, f1), "names-of-codes")
    spans = known.groupBy(name, f0, f1).agg(F.min(code).alias(code))
    candidates = known.groupBy(name).agg(F.count_distinct(code).alias("candidates"))
    units = staged(left.filter(F.col(name).isNotNull()).select(unit, name, y0, y1), "names-of-units")  # read three times, and names cost much
    best = units.select(name, y0, y1).distinct().join(spans, name).groupBy(name, y0, y1).agg(F.min(_by_years(code, y0, y1, f0, f1)).alias("__rank"))
    # as a struct the key is never null, though its years may be
    key = lambda df: df.withColumn("__key", F.struct(name, y0, y1)).drop(y0, y1)
    found = spread.spread_join(key(units), key(best.join(candidates, name)).drop(name), ["__key"], by=[unit])
    one_name = F.when(F.min(name) == F.max(name), F.max("candidates")).otherwise(F.raise_error("a unit has several names"))
    return found.groupBy(unit).agg(F.min("__rank")["k"].alias(code), one_name.alias("candidates"))


def fuzzy(left: DataFrame, right: DataFrame, name: str, code: str, cutoff: float = 95.0, least: int = 4, *, count: str | None = None, least_count: int = 5, top: int | None = None) -> DataFrame:
    """(name, match, code, score): for each distinct name the best other name with the same first word, by the ratio of sorted
    words; of equal ones the smaller name. With `count`, only names with that many documents or more (summed) are looked
    up; with `top`, so many matches a name, numbered by rank.

    Blocks are kept small by the length of names as well: at a ratio r the lengths can differ by a factor of (200 - r) / r
    at most, so names meet by length band of the block and its neighbours, an equi-join without pairs that can't match; a
    name's length of sorted words is its length with single blanks.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    first = lambda c: F.substring_index(flat(F.col(c)), " ", 1)
    band = lambda c: F.floor(F.log(F.length(flat(F.col(c))).cast("double")) / F.log(F.lit((200 - cutoff) / cutoff + 1e-9)))
    a = left.select(F.col(name).alias("name"), *([F.col(count).alias("__docs")] if count else [])).filter(F.length("name") >= least)
    a = a.groupBy("name").agg(F.sum("__docs").alias("__docs")).filter(F.col("__docs") >= least_count).select("name") if count else a.distinct()
    b = right.select(F.col(name).alias("match"), F.col(code).alias("code")).filter(F.length("match") >= least).groupBy("match").agg(F.min("code").alias("code"))
    a = a.withColumns({"__f": first("name"), "__b": F.explode(F.array(*[band("name") + d for d in (-1, 0, 1)]))})
    b = b.withColumns({"__f": first("match"), "__b": band("match")})
    scored = a.join(b, ["__f", "__b"]).withColumn("score", names.token_sort_ratio("name", "match")).filter(F.col("score") >= cutoff)
    order = F.struct((-F.round("score", 6)).alias("s"), F.col("match").alias("m"))
    if top is None:
        return scored.groupBy("name").agg(F.min_by(F.struct("match", "code", "score"), order).alias("b")).select("name", "b.match", "b.code", "b.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(order)))
    return ranked.filter(F.col("rank") <= top).select("name", "match", "code", "score", "rank")


def _alike(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Pairs with every (a, b) whose sorted words have an indel ratio of `cutoff` or more, and some others.

    A text of length n allows at most k = n * 2 (1 - r) / r insertions and deletions at a ratio r. So of its k + 1 parts one
    stands unharmed in the other text, moved by no more than their number: texts meet on (length, number of part, part).
    """
    r = cutoff / 100
    low, high = F.ceil(F.col("__m") * (r / (2 - r)) - 1e-9), F.floor(F.col("__m") * ((2 - r) / r) + 1e-9)
    words = lambda df, c: df.withColumn("__t", F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(c), r"\s+"))), " ")).filter("__t <> ''")
    count = F.floor(F.col("__n") * (2 * (1 - r) / r) + 1e-9).cast("int") + 1
    cuts = lambda df: df.withColumn("__k", count).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).withColumns({"__at": F.floor(F.col("__i") * F.col("__n") / F.col("__k")).cast("int"), "__to": F.floor((F.col("__i") + 1) * F.col("__n") / F.col("__k")).cast("int")})
    part = lambda at: F.substring(F.col("__t"), at + 1, F.col("__to") - F.col("__at"))
    x = cuts(words(left, a).withColumn("__n", F.length("__t"))).select(*left.columns, "__n", "__i", part(F.col("__at")).alias("__part"))
    y = words(right, b).withColumn("__m", F.length("__t")).withColumn("__n", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    moved = F.floor((F.col("__n") + F.col("__m")) * (1 - r) + 1e-9).cast("int")
    y = cuts(y).withColumns({"__p": F.greatest(F.lit(0), F.col("__at") - moved), "__q": F.least(F.col("__at") + moved, F.col("__m") - (F.col("__to") - F.col("__at")))}).filter("__p <= __q")
    y = y.withColumn("__p", F.explode(F.sequence("__p", "__q"))).select(*right.columns, "__n", "__i", part(F.col("__p")).alias("__part")).distinct()
    return x.join(y, ["__n", "__i", "__part"]).select(*left.columns, *right.columns).distinct()


def title_cascade(left: DataFrame, right: DataFrame, title: str, code: str, cutoff: float = 92.0) -> DataFrame:
    """(title, code, method): equal titles first, then the best dictionary title at a token-set ratio of `cutoff` or more: of
    those that share a word with it and, since without a shared word that is the indel ratio of the sorted words, of those alike."""
    a, b = left.select(title).distinct(), right.groupBy(title).agg(F.min(code).alias(code))
    same = a.join(b, title).withColumn("method", F.lit("exact"))
    rest = a.join(b, title, "left_anti")
    word = lambda df, new: df.select(F.col(title).alias(new), *([code] if code in df.columns else []), F.explode(F.array_distinct(F.split(title, " "))).alias("__w"))
    pairs = word(rest, "__l").join(word(b, "__r"), "__w").select("__l", "__r", code)
    pairs = pairs.unionByName(_alike(rest.select(F.col(title).alias("__l")), b.select(F.col(title).alias("__r"), code), "__l", "__r", cutoff)).distinct()
    scored = pairs.withColumn("__s", names.token_set_ratio("__l", "__r")).filter(F.col("__s") >= cutoff)
    best = scored.groupBy(F.col("__l").alias(title)).agg(F.min_by(code, F.struct((-F.col("__s")).alias("s"), F.col("__r").alias("r"))).alias(code)).withColumn("method", F.lit("fuzzy"))
    return same.unionByName(best)


def code_or_title(left: DataFrame, right: DataFrame, code: str, title: str, cutoff: float = 92.0) -> DataFrame:
    """left with link (a code of right) and method: `code` where its own code is one of right's, else by title_cascade over the
    titles in plain form, `exact` or `fuzzy`; null where nothing fits."""
    known = right.select(F.col(code).alias("__own")).filter(F.col("__own").isNotNull()).distinct()
    plain = lambda df: df.withColumn("__t", names.title(F.col(title))).filter("__t <> ''")
    hit = left.join(known, F.col(code) == F.col("__own"), "left")
    todo = plain(hit.filter(F.col("__own").isNull())).select("__t").distinct()
    found = title_cascade(todo, plain(right).select("__t", F.col(code).alias("__code")), "__t", "__code").select(F.col("__t").alias("__u"), "__code", F.col("method").alias("__how"))
    out = hit.withColumn("__t", names.title(F.col(title))).join(found, (F.col("__t") == F.col("__u")) & F.col("__own").isNull(), "left")
    return out.select(*left.columns, F.coalesce("__own", "__code").alias("link"), F.when(F.col("__own").isNotNull(), "code").otherwise(F.col("__how")).alias("method"))


def containment(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): distinct titles of which one, squashed, contains the other. A title without letters or digits meets none.

    Each title is cut into its substrings of the lengths that the other dictionary has, so whole titles meet by an equi-join;
    the lengths are one row.
    """
    x, y = (df.select(F.col(c).alias(n)).distinct().withColumn(f"__{n}", names.squash(F.col(n))).filter(f"__{n} <> ''") for df, c, n in ((left, a, "a"), (right, b, "b")))

    def inside(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        lengths = inner.agg(F.collect_set(F.length(i)).alias("__lengths"))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(o) - n + 1), lambda k: F.substring(o, k, n))
        parts = F.flatten(F.transform(F.filter("__lengths", lambda n: n <= F.length(o)), cut))
        return outer.select(o).distinct().join(F.broadcast(lengths), F.lit(True)).select(o, F.explode(F.array_distinct(parts)).alias(i)).join(inner.select(i).distinct(), i)  # one row

    pairs = inside(x, "__a", y, "__b").unionByName(inside(y, "__b", x, "__a")).distinct()
    return pairs.join(x, "__a").join(y, "__b").select(F.col("a").alias(a), F.col("b").alias(b))


def _runs(words: Column) -> Column:
    """Every run of whole words of a name; the name itself is one of them."""
    n = F.size(words)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.array_join(F.slice(words, i, m), " ")))))


def _within(a: Column, b: Column) -> Column:
    """a's words appear, as whole words, in b."""
    return (a != "") & (b != "") & F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))


def place_cascade(left: DataFrame, right: DataFrame, key: str, code: str, own: str | None = None, principal: DataFrame | None = None) -> DataFrame:
    """(key, code, score) of places with cities and states arrays (key and code are unique):

    4 the left row's `own` code is known and shares a city with it, as whole words of one within the other; 3 the same first
    city, in the left row's first state; 2 a shared city, there; 1 a city, in any of its states, is a principal city (`principal`:
    code, city, state) of exactly one code, equal ones before whole words within; 0 none. Of equal scores the smallest code.

    The right side is reduced to the smallest code of each (state, city) before the join, so no group of all pairs arises.
    """
    names_of = lambda df, k, states: df.select(k, F.col("cities")[0].alias("__first"), F.explode(states).alias("state"), "cities").select(k, "__first", "state", F.explode(F.array_distinct("cities")).alias("city"))
    is_first = F.col("city") == F.col("__first")
    known = names_of(right, code, "states").groupBy("state", "city").agg(F.min(code).alias("__any"), F.min(F.when(is_first, F.col(code))).alias("__head"))
    pairs = names_of(left, key, F.slice("states", 1, 1)).join(known, ["state", "city"])
    head = is_first & F.col("__head").isNotNull()
    found = pairs.select(key, F.when(head, 3).otherwise(2).alias("score"), F.when(head, F.col("__head")).otherwise(F.col("__any")).alias(code))
    if principal is not None:
        principal = principal.select(code, "city", "state").filter("city <> ''").join(right.select(code), code, "left_semi").distinct()
    if own is not None:
        places = right.select(code, F.explode("cities").alias("city"))
        places = (places if principal is None else places.unionByName(principal.select(code, "city"))).groupBy(code).agg(F.collect_set("city").alias("__known"))
        meets = F.exists("cities", lambda c: F.exists("__known", lambda k: _within(c, k) | _within(k, c)))
        same = left.select(key, "cities", F.col(own).alias(code)).join(places, code).filter(meets)
        found = found.unionByName(same.select(key, F.lit(4).alias("score"), code))
    if principal is not None:
        runs = principal.select("*", F.explode(_runs(F.split("city", " "))).alias("__run"))
        whole = F.when(F.col("__run") == F.col("city"), F.col(code))
        runs = runs.groupBy("state", "__run").agg(F.min(whole).alias("__w0"), F.max(whole).alias("__w1"), F.min(code).alias("__a0"), F.max(code).alias("__a1"))
        each = left.select(key, "states", F.posexplode("cities").alias("__c", "city")).filter("city <> ''").select(key, "__c", "city", F.posexplode("states").alias("__s", "state"))
        hits = each.select("*", F.explode(_runs(F.split("city", " "))).alias("__run")).join(runs, ["state", "__run"])
        all_of_it = F.col("__run") == F.col("city")
        pick = lambda f, w, a: f(F.when(all_of_it, F.col(a)).otherwise(F.col(w)))
        hits = hits.groupBy(key, "__c", "__s").agg(F.min(F.when(all_of_it, F.col("__w0"))).alias("__e0"), F.max(F.when(all_of_it, F.col("__w1"))).alias("__e1"), pick(F.min, "__w0", "__a0").alias("__h0"), pick(F.max, "__w1", "__a1").alias("__h1"))
        low, high = F.coalesce("__e0", "__h0"), F.coalesce("__e1", "__h1")
        found = found.unionByName(hits.filter(low == high).groupBy(key).agg(F.min_by(low, F.struct("__c", "__s")).alias(code)).select(key, F.lit(1).alias("score"), code))
    best = found.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(code).alias("c"))).alias("b"))
    return left.select(key).join(best, F.col(key) == F.col("__key"), "left").select(key, F.col("b.c").alias(code), F.coalesce(-F.col("b.s"), F.lit(0)).alias("score"))


def tier(method: Column, ratio: Column, score: Column) -> Column:
    near = ratio.between(0.5, 2.0)
    return F.when((method == "exact") & near, "high").when((method == "exact") | ((score >= 95) & near), "medium").otherwise("low")


def spells(df: DataFrame, keys: list[str], spans: list[tuple[str, str, str]], code: str = "code") -> DataFrame:
    """Wide (first year, years or last year, code) columns as rows: a count up to 1799 is a number of years, else a last year."""
    rows = F.array(*[F.struct(F.col(f).alias("__first"), F.col(n).alias("__n"), F.col(c).alias("__code")) for f, n, c in spans])
    long = df.select(*keys, F.explode(rows).alias("__s")).select(*keys, "__s.*").filter(F.col("__first").isNotNull() & F.col("__code").isNotNull())
    last = F.when(F.col("__n") >= 1800, F.col("__n")).when(F.col("__n") >= 1, F.col("__first") + F.col("__n") - 1)
    return long.select(*keys, F.col("__first").alias("first"), F.col("__code").alias(code), last.alias("last"))
