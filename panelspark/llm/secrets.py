"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery for strings of unknown form.

Base kinds are patterns (assign, access, hex); spans are code points, end exclusive, leftmost and without overlap per kind.

Battery: runs of 20 or more characters of `[A-Za-z0-9+/_-]` are taken as text encoded in hex, base32 or base64 (the narrowest
alphabet that holds them), if they mix letters with digits or upper with lower case, or are all upper-case. Three statistics
compare a string with uniformly random symbols of that alphabet: chi-squared of the symbol counts (its cube root, which is
near normal for short strings too), runs (changes between upper-case, lower-case and digit against the number that random
symbols give), and lag-1 serial correlation of the symbol codes, dealt out by a stride so that classes don't lie together
and the three are nearly independent. Their squared z-scores are added and give one p-value (chi-squared, 3 degrees of
freedom), uniform to about a tenth on random strings of 20 to 100 characters.

False-discovery control by length: strings are grouped by encoding, length octave and whether they have a digit (most strings
without one are words and paths, and would hide the few that are not). In each group p-values above LAMBDA tell how many random
strings there are (they are uniform on 0..1 under randomness, language piles up at 0); a string is reported if its p-value
is above the lowest cut at which the estimated share of other strings among those reported is at most `fdr`, an excess
over the random ones counting as far as it is beyond ERRORS standard errors of their number. Each group starts from PRIOR
strings, half of them random, half language, which many strings outweigh and few don't: the rule is the same at every size. The p-values go through a histogram of BINS bins per group (a bounded table however large the corpus;
counts are added map-side), so no group of strings meets in a task. Strings inside a base span are not reported again.

Defined results: null or empty texts have no spans; very long texts are read whole (places of n matches cost about n ** 1.5
steps); rows are judged one by one, so repeated rows agree; no column but id and text is read, so clashing names don't
matter; on an empty table nothing is estimated and nothing returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Tokens of one kind of characters are words, numbers or rulers; upper-case alone may be base32.
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]|^[A-Z]+=*$"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
STRIDES = {"hex": 7, "base32": 11, "base64": 27}


def _changes(alphabet: str) -> tuple[float, float]:
    """The chance that two random neighbours differ in class, and the covariance of that for two pairs with a common symbol."""
    kinds = [sum(f(c) for c in alphabet) / len(alphabet) for f in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())]
    change = 1 - sum(p * p for p in kinds)
    return change, sum(p * (1 - p) ** 2 for p in kinds) - change**2


LAMBDA, BINS, FDR = 0.5, 100, 0.05
#: Strings that each group starts from, half random, half language with these shares in the lowest bins.
PRIOR, LANGUAGE, ERRORS = 20.0, (0.8, 0.1, 0.05, 0.03, 0.02), 1.5
#: Matches of a text whose places are added up together.
CHUNK = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Sums of the values before each one, of an array of integers. An array that grows by concat costs its length each time, so
    sums run inside chunks, and over the totals of chunks."""

    def sums(v: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(v, start, lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))
    totals = lambda c: F.transform(c, lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.when(F.size(values) > 0, let(chunks, lambda c: F.flatten(F.zip_with(c, sums(totals(c), F.lit(0)), sums)))).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, found) of all matches; found is the text of the group."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # what stands before each match; the last piece of the split has no match after it
    before = F.transform(F.split(text, pattern, -1), F.length)

    def placed(rows: Column) -> Column:
        at = running(F.transform(rows, lambda r: r["before"] + r["size"]))
        return F.zip_with(rows, at, lambda r, a: F.struct((a + r["before"]).cast("int").alias("start"), (a + r["before"] + r["size"]).cast("int").alias("end"), r["found"].alias("found")))

    rows = F.zip_with(F.arrays_zip(size.alias("size"), found.alias("found")), before, lambda m, b: F.struct(b.alias("before"), m["size"].alias("size"), m["found"].alias("found")))
    return F.when(text.rlike(pattern), let(F.filter(rows, lambda x: x["size"].isNotNull()), placed)).otherwise(none)


def _phi(z: Column) -> Column:
    """Normal distribution function, by its logistic approximation (absolute error below 0.0002)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def battery(token: Column) -> Column:
    """(encoding, n, p) of a token."""
    bare = F.rtrim(token, F.lit("="))
    encoding = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")

    def judged(e: Column) -> Column:
        plain = F.when(e == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
        pick = lambda values: F.when(e == "hex", values["hex"]).when(e == "base32", values["base32"]).otherwise(values["base64"])
        alphabet = pick(ALPHABETS)
        chars = F.filter(F.split(plain, ""), lambda c: c != "")
        codes = F.transform(chars, lambda c: (F.instr(alphabet, c) * pick(STRIDES)) % F.length(alphabet))
        change, cov = (pick({k: _changes(v)[i] for k, v in ALPHABETS.items()}) for i in (0, 1))
        return let(codes, lambda x: let(F.length(alphabet).cast("double"), lambda k: _battery(x, chars, k, change, cov, e)))

    return let(encoding, judged)


def _battery(x: Column, chars: Column, k: Column, change: Column, cov: Column, e: Column) -> Column:
    n = F.size(x).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    squares = total(F.transform(F.array_distinct(x), lambda d: F.pow(F.size(F.filter(x, lambda v: v == d)).cast("double"), F.lit(2.0))))
    free, spare = k - 1, 2 / (9 * (k - 1))
    chi = (F.cbrt(F.greatest(F.lit(0.0), free + (k / n * squares - n - free) / F.sqrt((n - 1) / n)) / free) - (1 - spare)) / F.sqrt(spare)
    kind = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[a-z]"), 2).otherwise(3)
    classes = F.transform(chars, kind)
    changes = let(classes, lambda c: total(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: (a != b).cast("double"))))
    runs = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * cov)
    mean = total(x) / n
    spread = let(mean, lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))))
    lagged = let(mean, lambda m: total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - m) * (b - m))))
    serial = (F.coalesce(F.try_divide(lagged, spread), F.lit(1.0)) + 1 / n) * n * F.sqrt(n - 1) / (n - 2)
    digits = F.exists(classes, lambda c: c == 0)
    joint = (chi * chi + runs * runs + serial * serial) / 3
    z = (F.pow(joint, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5
    return F.struct(e.alias("encoding"), n.cast("int").alias("n"), digits.alias("digits"), (1 - _phi(F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0)))).alias("p"))


def find_candidates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, tokens): spans of the base kinds, and tokens with encoding, length and p-value."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = lambda found, kind: F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    assign = F.filter(spans(F.col("text"), ASSIGN, 2), lambda s: F.length(s["found"]) >= 6)
    base = F.concat(named(assign, 0), named(spans(F.col("text"), ACCESS), 1), named(spans(F.col("text"), HEX), 2))
    tokens = F.transform(F.filter(spans(F.col("text"), TOKEN), lambda s: s["found"].rlike(MIXED)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["found"]).alias("test")))
    found = rows.select("doc_id", F.array_sort(base).alias("base"), tokens.alias("tokens"))
    outside = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    # no further than here with the texts
    return found.select("doc_id", "base", outside.alias("tokens"))


def _group(test: Column) -> Column:
    return F.concat_ws("/", test["encoding"], F.floor(F.log2(test["n"].cast("double"))).cast("string"), test["digits"].cast("string"))


def cuts(candidates: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """For each encoding and length octave the p-value above which tokens are reported. At most 3 x 31 x 2 groups of BINS rows."""
    each = candidates.select(F.explode("tokens").alias("t")).select(_group(F.col("t.test")).alias("grp"), F.least(F.floor(F.col("t.test.p") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts: dict[str, list[float]] = {}
    for group, b, n in each.groupBy("grp", "bin").count().collect():
        counts.setdefault(group, [PRIOR / 2 * (1 / BINS + share) for share in (*LANGUAGE, *[0.0] * (BINS - len(LANGUAGE)))])[b] += n
    out = {}
    for group, histogram in counts.items():
        random = sum(histogram[int(LAMBDA * BINS) :]) / (1 - LAMBDA)
        for b in range(int(LAMBDA * BINS) + 1):
            above = sum(histogram[b:])
            expected = random * (1 - b / BINS)
            if above - expected - ERRORS * expected**0.5 <= fdr * above:
                out[group] = b / BINS
                break
    return out


def find_secrets(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, spans): all spans as an array of (start, kind, end), kind being the place in KINDS."""
    candidates = materialize(find_candidates(documents, doc_id=doc_id, text=text), "secrets")
    above = cuts(candidates, fdr)
    table = F.create_map(*[F.lit(v) for pair in above.items() for v in pair]) if above else F.lit(None).cast("map<string,double>")
    random = F.filter("tokens", lambda t: F.coalesce(t["test"]["p"] >= table[_group(t["test"])], F.lit(False)))
    added = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return candidates.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def spelled(found: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
