"""Typed property predicates over node and relationship frames, with id-set filters, sorting and paging."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation names; each also has a NOT_ form below.
OPERATIONS = ["EQ", "NEQ", "GT", "GTE", "LT", "LTE", "IS_NULL", "STARTS_WITH", "CONTAINS", "ENDS_WITH"]
NEGATED = {"NOT_IS_NULL": "IS_NULL", "NOT_STARTS_WITH": "STARTS_WITH", "NOT_CONTAINS": "CONTAINS", "NOT_ENDS_WITH": "ENDS_WITH"}


def predicate(df: DataFrame, prop: str, op: str, value: Any = None) -> Column:
    """A condition on one property; null properties match neither an operation nor its NOT_ form, save for the null operations.

    On lists, EQ and NEQ compare elements, GT, GTE, LT and LTE compare sizes (GTE and LTE: or equal), STARTS_WITH and
    ENDS_WITH test a prefix or suffix, CONTAINS that all given elements occur.
    """
    if op in NEGATED:
        rule = ~predicate(df, prop, NEGATED[op], value)
        return rule if op == "NOT_IS_NULL" else F.col(prop).isNotNull() & rule
    c = F.col(prop)
    if op == "IS_NULL":
        return c.isNull()
    if isinstance(df.schema[prop].dataType, T.ArrayType):
        v = F.array(*[F.lit(x) for x in value]).cast(df.schema[prop].dataType)
        n, m = F.size(c), len(value)
        tail = F.when(n >= m, F.slice(c, F.greatest(n - m + 1, F.lit(1)), m) == v).otherwise(F.lit(False))
        rules = {"EQ": c == v, "NEQ": c != v, "GT": n > m, "GTE": n >= m, "LT": n < m, "LTE": n <= m, "STARTS_WITH": F.slice(c, 1, m) == v, "ENDS_WITH": tail, "CONTAINS": F.size(F.array_except(v, c)) == 0}
        return c.isNotNull() & rules[op]
    v = F.lit(value)
    rules = {"EQ": lambda: c == v, "NEQ": lambda: c != v, "GT": lambda: c > v, "GTE": lambda: c >= v, "LT": lambda: c < v, "LTE": lambda: c <= v, "STARTS_WITH": lambda: c.startswith(value), "ENDS_WITH": lambda: c.endswith(value), "CONTAINS": lambda: c.contains(value)}
    return rules[op]()


def find(frame: DataFrame, prop: str, op: str, value: Any = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of a node or relationship frame that meet a predicate, in id order if paged."""
    out = frame.where(predicate(frame, prop, op, value))
    if skip or limit is not None:
        out = out.orderBy("id").offset(skip)
        out = out if limit is None else out.limit(limit)
    return out


def find_ids(frame: DataFrame, prop: str, op: str, value: Any = None) -> DataFrame:
    return find(frame, prop, op, value).select("id")


def find_count(frame: DataFrame, prop: str, op: str, value: Any = None) -> DataFrame:
    return find(frame, prop, op, value).agg(F.count(F.lit(1)).alias("n"))


def filter_ids(frame: DataFrame, ids: DataFrame, prop: str, op: str, value: Any = None, sort: str | None = None, descending: bool = False, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows whose id is among `ids` (column id) and that meet a predicate, sorted by the property (then id) if asked."""
    out = find(frame.join(ids.select("id"), "id", "left_semi"), prop, op, value)
    if sort:
        out = out.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "id")
    elif skip or limit is not None:
        out = out.orderBy("id")
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)
