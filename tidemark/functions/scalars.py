"""Scalar parsers and formulas, as column expressions (never row-at-a-time Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
# Reserved keys of the aggregate tables.
MCC_GLOBAL, MCC_MISSING = -(2**63), -2
GLOBAL, MISSING = "__GLOBAL__", "__MISSING__"
MISSING_TZ, MISSING_CCY, MISSING_ET, MISSING_TZ_ALONE = "__MISSING_TZ__", "__MISSING_CCY__", "__MISSING_ET__", "__MISSING_TZ_ALONE__"


def clean_text(c: Column) -> Column:
    """Trimmed of spaces and tabs; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string"), F.lit(" \t")), F.lit(""))


def is_empty(c: Column) -> Column:
    return clean_text(c).isNull()


def non_empty_flag(c: Column) -> Column:
    return F.when(is_empty(c), 0.0).otherwise(1.0)


def parse_double(c: Column) -> Column:
    """Finite double, or null. Text may carry a numeric prefix."""
    prefix = F.regexp_extract(F.trim(c.cast("string"), F.lit(" \t")), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    x = prefix.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def parse_seconds(c: Column, kind: str) -> Column:
    """Seconds since the epoch (UTC), fractions dropped; null where it isn't a time."""
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_seconds(F.date_trunc("second", c.cast("timestamp")))
    return F.unix_seconds(F.try_to_timestamp(F.substring(F.trim(c, F.lit(" \t")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))


def mcc_key(c: Column) -> Column:
    """Whole-number merchant key; near-integers round; missing and reserved values become MCC_MISSING."""
    x = parse_double(c)
    near = F.when(F.abs(x - F.rint(x)) <= 1e-6 * (1 + F.abs(x)), F.rint(x).try_cast("bigint"))
    return F.when(near.isNull() | near.isin(MCC_GLOBAL, MCC_MISSING), F.lit(MCC_MISSING)).otherwise(near).cast("bigint")


def hour_of(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def weekday_of(seconds: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)).cast("int")


def safe_denominator(d: Column) -> Column:
    return F.when(F.abs(d) <= EPS, EPS).otherwise(d)


def neglog_smooth(num: Column, den: Column) -> Column:
    return -F.log((num + 0.5) / (den + 0.5))


def robust_z(x: Column, median: Column, q25: Column, q75: Column) -> Column:
    return (x - median) / F.greatest((q75 - q25) / 1.35, F.lit(EPS))


def clipped_position(x: Column, q25: Column, q75: Column) -> Column:
    at = (x - q25) / F.greatest(F.abs(q75 - q25), F.lit(EPS))
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)))


def developer_flag(c: Column) -> Column:
    text = clean_text(c)
    number = parse_double(text)
    off = F.lower(text).isin("false", "no", "off", "0")
    return F.when(text.isNull(), 0.0).when(number.isNotNull(), (number != 0).cast("double")).when(off, 0.0).otherwise(1.0)


def language_mismatch(a: Column, b: Column) -> Column:
    x, y = clean_text(a), clean_text(b)
    return F.when(x.isNotNull() & y.isNotNull() & (x != y), 1.0).otherwise(0.0)


def remap_weight(w: Column) -> Column:
    """1, 2, 5 become 1, 5, 10."""
    return F.when(F.abs(w - 5) <= 1e-5, 10.0).when(F.abs(w - 2) <= 1e-5, 5.0).otherwise(w)


def finalise_target(target: Column, weight: Column, demote: bool = False) -> tuple[Column, Column]:
    """Whole-number target (not a number: 0) and weight (not a number: 1); ``demote`` turns targets of weight 2 to 0."""
    bad = target.isNull() | F.isnan(target) | (F.abs(target) == float("inf"))
    whole = F.when(bad, 0).otherwise(F.rint(F.when(~bad, target))).cast("int")
    w = F.when(weight.isNull() | F.isnan(weight), 1.0).otherwise(weight)
    return (F.when((whole == 1) & (F.abs(w - 2) <= 1e-5), 0).otherwise(whole) if demote else whole), w


def logit(p: Column) -> Column:
    x = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return F.log(x / (1 - x))
