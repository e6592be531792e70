"""Codes, dates and numbers as columns: everything here is a built-in expression and stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_number(x: Column) -> Column:
    """The first run of digits without leading zeros: `US0010B2` -> `10`."""
    return F.regexp_replace(F.regexp_extract(x, r"(\d+)", 1), "^0+", "")


def patent_number(x: Column) -> Column:
    """A float tail dropped; all digits: leading zeros stripped, else upper-case letters and digits; null if nothing is left."""
    bare = F.regexp_replace(F.upper(F.trim(x.cast("string"))), r"\.0+$", "")
    kept = F.when(bare.rlike(r"^\d+$"), F.regexp_replace(bare, "^0+", "")).otherwise(F.regexp_replace(bare, "[^A-Z0-9]", ""))
    return F.nullif(kept, F.lit(""))


def firm_key(x: Column) -> Column:
    """Digits padded to six, zeros alone are null."""
    digits = F.regexp_extract(x.cast("string"), r"(\d+)", 1)
    return F.nullif(F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0")), F.lit("000000"))


def float_text(x: Column) -> Column:
    """`10107.0` -> `10107`; empty is null."""
    return F.nullif(F.regexp_replace(F.trim(x.cast("string")), r"\.0+$", ""), F.lit(""))


def padded(x: Column, width: int) -> Column:
    text = float_text(x)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def county_code(state: Column, county: Column) -> Column:
    """State code and county of up to three digits, or a county that is whole already."""
    raw = float_text(county)
    return F.when(F.length(raw) <= 3, F.concat(padded(state, 2), F.lpad(raw, 3, "0"))).otherwise(padded(county, 5))


def mapped(x: Column, pairs: dict[str, str]) -> Column:
    """pairs[x], or null."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), x)


def class_parts(code: Column) -> Column:
    """(class, main group) of a code like `G06N 3/08`: upper-case without blanks, cut before the slash, four characters."""
    clean = F.upper(F.regexp_replace(code, r"\s", ""))
    return F.struct(F.nullif(F.substring(clean, 1, 4), F.lit("")).alias("subclass"), F.nullif(F.substring_index(clean, "/", 1), F.lit("")).alias("main_group"))


def any_prefix(code: Column, prefixes: list[str]) -> Column:
    """Whether code begins with one of prefixes; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes]), F.lit(False))


def mixed_date(text: Column) -> Column:
    """A date from `YYYY-MM-DD...` or `YYYYMMDD`."""
    eight = text.rlike(r"^\d{8}$")
    return F.when(eight, F.to_date(F.try_to_timestamp(F.when(eight, text), F.lit("yyyyMMdd")))).otherwise(F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def period_date(period: Column) -> Column:
    """The first day of biweekly period `YYYY-NN`."""
    return F.date_add(F.make_date(F.substring(period, 1, 4).cast("int"), F.lit(1), F.lit(1)), (F.substring(period, 6, 2).cast("int") - 1) * 14)


def binned(x: Column, bins: list[tuple[int, int, str]]) -> Column:
    """Label of the first range (inclusive) that holds x; null outside all."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bins):
        out = F.when(x.between(low, high), label).otherwise(out)
    return out


def clean_number(text: Column) -> Column:
    """Digits, points and a leading minus of a published figure (`$1,200`, `4%`, `-1`); `#` and empty are null."""
    sign = F.when(text.rlike(r"^[^0-9.]*-[^0-9]*[0-9.]"), F.lit("-")).otherwise(F.lit(""))
    return F.nullif(F.concat(sign, F.regexp_replace(text, "[^0-9.]", "")), F.lit("")).try_cast("double")


def unsuppressed(x: Column) -> Column:
    """Negative cells mark suppressed figures: null, never 0."""
    return F.when(x >= 0, x)


def member_codes(code: Column, title: Column) -> Column:
    """Codes of `digits` inside `(3251, 3252 only)`; else the first four characters of code."""
    inside = F.regexp_extract(title, r"\(([^)]*only)\)", 1)
    found = F.regexp_extract_all(inside, F.lit(r"(\d{4})"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(code, 1, 4)))


def first_match(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first rule (name, pattern) that x matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def significant(x: Column, digits: int) -> Column:
    """x rounded to a number of significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / scale) * scale)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * 2 * 6371.0


def balance(p: Column) -> Column:
    return 1 - F.abs(2 * p - 1)
