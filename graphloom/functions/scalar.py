"""Scalar functions with the null and error rules of the graph language, as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Division as doubles; division by zero is null."""
    return F.try_divide(a, b)


def int_divide(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def not_(x: Column) -> Column:
    """Two-valued negation: null counts as false, so its negation is true."""
    return ~F.coalesce(x, F.lit(False))


def all_of(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(x, F.lit(False))
    return out


def any_of(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.coalesce(x, F.lit(False))
    return out


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def strip(s: Column) -> Column:
    return F.trim(s)


def concat(*xs: Column) -> Column:
    """Joined strings; null if any part is."""
    return F.concat(*xs)


def join(xs: list[Column], separator: str) -> Column:
    return F.concat_ws(separator, *xs)


def string(x: Column) -> Column:
    return x.cast("string")


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def like(s: Column, pattern: str) -> Column:
    return s.like(pattern)


def startswith(s: Column, prefix: str) -> Column:
    return s.startswith(prefix)


def endswith(s: Column, suffix: str) -> Column:
    return s.endswith(suffix)


def contains(s: Column, part: str) -> Column:
    return s.contains(part)


def split_part(s: Column, delimiter: str, index: int) -> Column:
    """The part at a zero-based index; empty if there are fewer."""
    return F.split_part(s, F.lit(delimiter), F.lit(index + 1))


def integer(x: Column) -> Column:
    return x.try_cast("bigint")


def floating(x: Column) -> Column:
    return x.try_cast("double")


number = parse_number = floating


def clip(x: Column, low, high) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def floor(x: Column) -> Column:
    return F.floor(x)


def ceil(x: Column) -> Column:
    return F.ceil(x)


def epoch_millis(s: Column) -> Column:
    """Milliseconds since the epoch of a date or a timestamp with a space or a T, read as UTC; null if it is neither."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(s, "T", " ")))


def date_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_to_double(s: Column) -> Column:
    return epoch_millis(s) / 1000.0


def fallback(*xs: Column) -> Column:
    return F.coalesce(*xs)


def as_bool(x: Column) -> Column:
    return x.isNotNull()


def length(path_rels: Column) -> Column:
    """Number of relationships of a path."""
    return F.size(path_rels)
