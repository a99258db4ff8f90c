"""Registered queries over the table graph: name -> (callable, DuckDB SQL or None)."""

from graphloom.queries import aggregates, algorithm, api, basic, joins, path, search_write, semantic

MODULES = [basic, joins, aggregates, path, api, algorithm, search_write, semantic]


def queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
