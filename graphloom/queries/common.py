"""Short forms used by the query modules."""

from __future__ import annotations

from graphloom.operators.match import Match
from graphloom.plans.graph import prop as p
from graphloom.sources.tables import ORACLE_CTES, table_graph


def match(spark, sf_dir) -> Match:
    return Match(table_graph(spark, sf_dir))


def with_ctes(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ORACLE_CTES.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql}"


def registry():
    """A dict and a decorator that puts a query with its SQL into it."""
    found: dict = {}

    def query(sql: str | None = None):
        def put(fn):
            found[fn.__name__] = (fn, sql)
            return fn

        return put

    return found, query


__all__ = ["Match", "match", "p", "registry", "table_graph", "with_ctes"]
