"""Sessions: a graph under an access mode. Reads need no right, data writes `rw`, schema changes `admin`."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from graphloom.plans.graph import Graph, GraphError

READ, WRITE, ADMIN = "ro", "rw", "admin"


def _same_schema(a: Graph, b: Graph) -> bool:
    if (set(a.nodes), set(a.rels), a.views, a.constraints, a.indexes, a.traits) != (set(b.nodes), set(b.rels), b.views, b.constraints, b.indexes, b.traits):
        return False
    # Frames that a change shares with the old graph need not be opened.
    touched = lambda x, y: [k for k in x if dict.get(x, k) is not dict.get(y, k)]
    return all(set(a.nodes[k].columns) == set(b.nodes[k].columns) for k in touched(a.nodes, b.nodes)) and all(
        set(a.rels[k].frame.columns) == set(b.rels[k].frame.columns) for k in touched(a.rels, b.rels)
    )


class Session:
    """The current version of a graph. A change is a function from graph to graph; a forbidden one, or one that violates
    a constraint, raises GraphError and leaves the version as it was."""

    def __init__(self, graph: Graph, mode: str = READ):
        if mode not in (READ, WRITE, ADMIN):
            raise GraphError(f"unknown mode {mode}")
        self.graph, self.mode = graph, mode

    def read(self, query: Callable[..., Any], *args, **kwargs) -> Any:
        """The result of a query, a function of the graph."""
        return query(self.graph, *args, **kwargs)

    def write(self, change: Callable[..., Graph], *args, **kwargs) -> Graph:
        """Insert, set or delete data; types, properties, views, constraints, traits and indexes must stay as they are."""
        if self.mode == READ:
            raise GraphError("a read-only session can't write")
        new = change(self.graph, *args, **kwargs)
        if self.mode == WRITE and not _same_schema(self.graph, new):
            raise GraphError("only an admin session can change the schema")
        self.graph = new.check()
        return self.graph

    def administer(self, change: Callable[..., Graph], *args, **kwargs) -> Graph:
        """Any change, of the schema too."""
        if self.mode != ADMIN:
            raise GraphError("only an admin session can change the schema")
        self.graph = change(self.graph, *args, **kwargs).check()
        return self.graph
