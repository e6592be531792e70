"""Names and titles as columns, and token similarity for the few distinct names that need it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that may end a company's name, and abbreviations; matching relies on just these.
LEGAL = ["inc", "incorporated", "corp", "corporation", "co", "company", "companies", "llc", "ltd", "limited", "plc", "lp", "llp", "holdings", "holding", "group", "the", "and"]
ABBREVIATIONS = {
    "international": "intl", "technologies": "tech", "technology": "tech", "systems": "sys", "services": "svcs", "communications": "comm", "manufacturing": "mfg",
    "pharmaceuticals": "pharma", "laboratories": "labs", "industries": "inds", "financial": "finl", "national": "natl", "american": "amer", "america": "amer",
    "corporation": "corp", "company": "co", "incorporated": "inc",
}


def company(x: Column, *, legal: list[str] = LEGAL, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """A company name in its plain form. Brackets, `/xx/` marks and share classes (`- Cl A`) go, `&` is spelled
    out, all but letters and digits are blanks, words are abbreviated, runs of single letters joined (`u s steel` -> `us
    steel`), leading `the` and trailing legal words removed."""
    s = F.regexp_replace(F.lower(x), r"\(.*?\)", " ")
    s = F.regexp_replace(s, "/[a-z]{2,4}/?", " ")
    s = F.regexp_replace(s, r"-\s*(cl|class)\s*[a-z]\b", " ")
    s = F.regexp_replace(F.regexp_replace(s, "&", " and "), "[^a-z0-9]+", " ")
    table = F.create_map(*[F.lit(v) for kv in abbreviations.items() for v in kv])
    s = F.array_join(F.transform(F.split(F.trim(s), " +"), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    s = F.regexp_replace(s, "(?<![a-z0-9])([a-z]) (?=[a-z](?: |$))", "$1")
    s = F.regexp_replace(s, "^(?:the(?: |$))+", "")
    return F.trim(F.regexp_replace(s, f"(?:(?:^| )(?:{'|'.join(legal)}))+$", ""))


def title(x: Column) -> Column:
    """An occupation title in its plain form: `&` spelled out, brackets, `all other` and what follows `except` dropped, letters
    and digits only."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "&", " and "), r"\(.*?\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", " "), r"\b(all other|except.*$)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def squash(x: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def place(x: Column) -> Column:
    """(cities, states) of a name like `Dallas-Fort Worth, TX-OK`."""
    split = lambda part: F.filter(F.transform(F.split(part, "[-/]"), lambda s: F.trim(s)), lambda s: s != "")
    cities = F.lower(F.regexp_extract(x, r"^([^,]*)", 1))
    states = F.regexp_extract(x, r",\s*([A-Z]{2}(?:-[A-Z]{2})*)", 1)
    return F.struct(split(cities).alias("cities"), split(states).alias("states"))


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts: bit-parallel, all pairs at a time, a place of b a step.

    The text a is cut in words of 63 bits, so that a carry out of a word is seen in its top bit.
    """
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    letters, codes = np.unique(np.frombuffer("".join([*a, *b, "\0"]).encode("utf-32-le"), np.uint32), return_inverse=True)
    la, lb = (np.fromiter(map(len, t), np.int64, n) for t in (a, b))
    off_a, off_b = np.r_[0, np.cumsum(la)][:-1], la.sum() + np.r_[0, np.cumsum(lb)][:-1]
    words = max(1, int(-(-la.max() // 63)))
    row, place = np.repeat(np.arange(n), la), np.arange(int(la.sum())) - np.repeat(off_a, la)
    order = np.argsort(-lb, kind="stable")  # at step j the first rows are those that have a letter j
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # where in a each letter stands: one key (row, letter) for each pair that occurs
    keys = row * len(letters) + codes[: len(row)]
    known, at = np.unique(keys, return_inverse=True)
    where = np.zeros((len(known) + 1, words), np.uint64)
    np.bitwise_or.at(where, (at, place // 63), np.uint64(1) << (place % 63).astype(np.uint64))
    full, one = np.uint64((1 << 63) - 1), np.uint64(1)
    state = np.full((n, words), full)
    sizes = lb[order]
    for j in range(int(lb.max())):
        m = int(np.searchsorted(-sizes, -j, "left"))
        rows = order[:m]
        key = rows * len(letters) + codes[off_b[rows] + j]
        hit = np.minimum(np.searchsorted(known, key), len(known) - 1) if len(known) else np.zeros(m, np.int64)
        mask = where[np.where((known[hit] == key) if len(known) else np.zeros(m, bool), hit, len(known))]
        v = state[rows]
        u, carry = v & mask, np.zeros(m, np.uint64)
        for w in range(words):
            total = v[:, w] + u[:, w] + carry
            carry = total >> np.uint64(63)
            v[:, w] = (total & full) | (v[:, w] & ~mask[:, w])
        state[rows] = v
    bits = np.minimum(np.maximum(la[:, None] - np.arange(words) * 63, 0), 63).astype(np.uint64)
    inside = (one << bits) - one
    return np.bitwise_count(~state & inside).sum(axis=1).astype(np.int64)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 times twice the common subsequence over both lengths, for each pair; 100 for two empty strings."""
    out = np.full(len(a), 100.0)
    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        total = np.fromiter((len(p) + len(q) for p, q in zip(x, y)), np.float64, len(x))
        out[lo : lo + 4096] = np.where(total > 0, 200.0 * _common(x, y) / np.maximum(total, 1), 100.0)
    return out


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return indel_ratios(*([" ".join(sorted(x.split())) for x in side] for side in (a, b)))


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """The best of shared words against each side's words, so that extra words cost little; 0 if a side has no words."""
    sets = [(set(x.split()), set(y.split())) for x, y in zip(a, b)]
    both, one, two = ([" ".join(sorted(f(x, y))) for x, y in sets] for f in (set.__and__, set.__sub__, lambda x, y: y - x))
    left, right = ([f"{s} {o}".strip() for s, o in zip(both, side)] for side in (one, two))
    best = indel_ratios(left, right)
    shared = np.fromiter((s != "" for s in both), bool, len(both))
    within = shared & np.fromiter((o == "" or t == "" for o, t in zip(one, two)), bool, len(both))
    for side in (left, right):  # a text against its beginning: the common subsequence is the beginning
        size = np.fromiter((len(s) + len(x) for s, x in zip(both, side)), np.float64, len(both))
        best = np.where(shared, np.maximum(best, 200.0 * np.fromiter(map(len, both), np.float64, len(both)) / np.maximum(size, 1)), best)
    empty = np.fromiter((not x or not y for x, y in sets), bool, len(sets))
    return np.where(empty, 0.0, np.where(within, 100.0, best))


def indel_ratio(a: str, b: str) -> float:
    return float(indel_ratios([a], [b])[0])


def token_sort(a: str, b: str) -> float:
    return float(token_sorts([a], [b])[0])


def token_set(a: str, b: str) -> float:
    return float(token_sets([a], [b])[0])


def _scored(score, a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = score(a[known].tolist(), b[known].tolist())
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scored(token_sorts, a, b)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scored(token_sets, a, b)
