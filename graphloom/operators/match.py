"""Pattern matching as joins: a Match binds variables to column groups and grows by expansion.

A bound node variable `a` is the columns a__id, a__type, a__key and a__<property>; a bound relationship `e` is e__id,
e__type and e__<property>. Every step is a declarative join or filter, so Catalyst orders joins, prunes columns and
pushes filters to the scans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph, GraphError

OUT, IN, ANY = "out", "in", "any"
_anonymous = count()


def prefixed(df: DataFrame, var: str, drop: Iterable[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{var}__{c}") for c in df.columns if c not in set(drop)])


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Relationships as (from, to, id, ...) seen from a node; undirected lists a loop once."""
    forth = edges.withColumnsRenamed({"src": "_from", "dst": "_to"})
    back = edges.withColumnsRenamed({"dst": "_from", "src": "_to"})
    if direction == OUT:
        return forth
    if direction == IN:
        return back
    return forth.unionByName(back.where("_from <> _to"))


@dataclass(frozen=True)
class Match:
    graph: Graph
    rows: DataFrame | None = None
    nodes: tuple[str, ...] = ()
    #: Relationship variables of the pattern with their types, for the different-edges rule.
    edges: tuple[tuple[str, frozenset[str]], ...] = ()
    repeatable: bool = False

    def node(self, var: str, labels: str | Iterable[str] | None = None, where: Column | None = None, exclude: Iterable[str] = (), **props) -> Match:
        """Bind a node variable by a scan; an already bound pattern is combined as a product (use join for shared names)."""
        frame = self.graph.node_frame(labels, exclude)
        frame = _only(frame, where, props)
        new = prefixed(frame, var)
        rows = new if self.rows is None else self.rows.crossJoin(new)
        return replace(self, rows=rows, nodes=(*self.nodes, var))

    def expand(self, src: str, rels: str | Iterable[str] | None, dst: str, labels: str | Iterable[str] | None = None, direction: str = OUT, edge: str | None = None, where: Column | None = None, edge_where: Column | None = None, **props) -> Match:
        """One hop from a bound node. A bound target makes it a join on both ends; labels and filters apply before the join."""
        if src not in self.nodes:
            raise GraphError(f"{src} is not bound")
        edge = edge or f"_e{next(_anonymous)}"  # no two patterns share an anonymous relationship
        frame = self.graph.rel_frame(rels)
        types = frozenset(self.graph.rels if rels is None else [rels] if isinstance(rels, str) else rels)
        frame = frame if edge_where is None else frame.where(edge_where)
        hop = oriented(frame, direction)
        hop = hop.select(*[F.col(c).alias(f"{edge}__{c}") if c not in ("_from", "_to") else F.col(c) for c in hop.columns])
        rows = self.rows.join(hop, F.col(f"{src}__id") == F.col("_from"))
        if dst in self.nodes:
            rows = rows.where(F.col("_to") == F.col(f"{dst}__id"))
            nodes = self.nodes
        else:
            target = prefixed(_only(self.graph.node_frame(labels), where, props), dst)
            rows = rows.join(target, F.col("_to") == F.col(f"{dst}__id"))
            nodes = (*self.nodes, dst)
        out = replace(self, rows=rows.drop("_from", "_to"), nodes=nodes, edges=(*self.edges, (edge, types)))
        return out if self.repeatable else out._different(edge, types)

    def relationship(self, edge: str, rels: str | Iterable[str] | None, src: str, dst: str, where: Column | None = None, src_labels=None, dst_labels=None) -> Match:
        """Start at relationships that meet a condition on their own properties, and bind the nodes at their ends: the
        filter reaches the relationships' scan, and only then are nodes looked up."""
        if self.rows is not None:
            raise GraphError("a pattern that starts at a relationship is a new Match; join it")
        found = _only(self.graph.rel_frame(rels), where, {})
        types = frozenset(self.graph.rels if rels is None else [rels] if isinstance(rels, str) else rels)
        rows = found.select(*[F.col(c).alias(f"{edge}__{c}") if c not in ("src", "dst") else F.col(c).alias(f"_{c}") for c in found.columns])
        rows = rows.join(prefixed(self.graph.node_frame(src_labels), src), F.col("_src") == F.col(f"{src}__id"))
        if src == dst:
            rows = rows.where("_src = _dst")
        else:
            rows = rows.join(prefixed(self.graph.node_frame(dst_labels), dst), F.col("_dst") == F.col(f"{dst}__id"))
        return replace(self, rows=rows.drop("_src", "_dst"), nodes=tuple(dict.fromkeys((src, dst))), edges=((edge, types),))

    def path(self, src: str, rels: str | Iterable[str] | DataFrame | None, dst: str, low: int = 1, high: int | None = None, labels=None, direction: str = OUT, mode: str = "trail", name: str | None = None, where: Column | None = None, edge_where: Column | None = None, inner: DataFrame | None = None, shortest: str | None = None, k: int = 1) -> Match:
        """A variable-length step from a bound node, which binds the target and, as `name`, the path: name__depth,
        name__rels and name__nodes (ids in order; for a group of hops, the ids of all its hops).

        `edge_where` holds for every relationship of the path, `inner` lists the ids that its inner nodes may have,
        `labels` and `where` hold for the target. `rels` may be a frame of hops (id, src, dst), also a group of several
        relationships as `group` makes it. `shortest` keeps the shortest trails per pair of ends: 'any', 'all', 'k',
        'groups'. Paths start from the distinct bound nodes, however often each is bound. A bound target restricts the
        ends. The path's own relationships differ among themselves as the mode says, not from those of other steps.
        """
        from graphloom.operators import paths as P

        if src not in self.nodes:
            raise GraphError(f"{src} is not bound")
        frame = rels if isinstance(rels, DataFrame) else self.graph.rel_frame(rels)
        frame = frame if edge_where is None else frame.where(edge_where)
        starts = self.rows.select(F.col(f"{src}__id").alias("start")).distinct()
        target = None if dst in self.nodes else prefixed(_only(self.graph.node_frame(labels), where, {}), dst)
        if shortest is None:
            found = P.var_length(frame, starts, low, high, mode, direction, inner=inner)
        else:
            high = P.SHORTEST_HOPS if high is None else high
            if target is None:
                pairs = self.rows.select(F.col(f"{src}__id").alias("start"), F.col(f"{dst}__id").alias("end")).distinct()
            else:  # targets that can be reached
                reached = P.k_hop(frame, starts, 1, high, direction).select("start", F.col("node").alias("end"))
                pairs = reached.join(target.select(F.col(f"{dst}__id").alias("end")), "end", "left_semi")
            found = P.shortest(frame, pairs, shortest, k, low, high, direction).withColumnRenamed("length", "depth")
        p = name or f"_p{next(_anonymous)}"
        found = found.select(F.col("start").alias("_start"), F.col("end").alias("_end"), *[F.col(c).alias(f"{p}__{c}") for c in ("depth", "rels", "nodes")])
        rows = self.rows.join(found, F.col(f"{src}__id") == F.col("_start"))
        if target is None:
            return replace(self, rows=rows.where(F.col("_end") == F.col(f"{dst}__id")).drop("_start", "_end"))
        return replace(self, rows=rows.join(target, F.col("_end") == F.col(f"{dst}__id")).drop("_start", "_end"), nodes=(*self.nodes, dst))

    def group(self, src: str, dst: str) -> DataFrame:
        """This pattern as one hop from src to dst, for repetition by path(): (id: ids of its relationships, src, dst)."""
        return self.rows.select(F.array(*[F.col(f"{e}__id") for e, _ in self.edges]).alias("id"), F.col(f"{src}__id").alias("src"), F.col(f"{dst}__id").alias("dst"))

    def _different(self, edge: str, types: frozenset[str]) -> Match:
        """Different edges: a relationship occurs once per match; only variables with a type in common can clash."""
        cond = [F.col(f"{edge}__id") != F.col(f"{other}__id") for other, kinds in self.edges if other != edge and kinds & types]
        rows = self.rows
        for c in cond:
            rows = rows.where(c)
        return replace(self, rows=rows)

    def repeat_elements(self) -> Match:
        """From here on, relationships may repeat within a match."""
        return replace(self, repeatable=True)

    def where(self, condition: Column | str) -> Match:
        """Keep matches for which the condition is true; null counts as false."""
        return replace(self, rows=self.rows.where(condition))

    def let(self, **columns: Column) -> Match:
        return replace(self, rows=self.rows.withColumns(columns))

    def _shared(self, other: Match) -> list[str]:
        """The node and relationship variables that both sides bind."""
        names = [e for e, _ in other.edges]
        return [v for v in self.nodes if v in other.nodes] + [e for e, _ in self.edges if e in names]

    def _minus(self, other: Match, keep: list[str]) -> DataFrame:
        """The other side's rows without columns this side binds too, save the ids joined on."""
        known = set(self.rows.columns)
        return other.rows.select(*[c for c in other.rows.columns if c not in known or c in keep])

    def join(self, other: Match) -> Match:
        """Natural join on shared node and relationship variables, or a product if there are none; the different-edges
        rule spans both sides, anonymous relationships included."""
        on = [f"{v}__id" for v in self._shared(other)]
        right = self._minus(other, on)
        rows = self.rows.join(right, on) if on else self.rows.crossJoin(right)
        out = replace(self, rows=rows, nodes=tuple(dict.fromkeys([*self.nodes, *other.nodes])), edges=tuple(dict.fromkeys([*self.edges, *other.edges])))
        if self.repeatable:
            return out
        for (e, a), (f, b) in combinations(out.edges, 2):
            within = any((e, a) in m.edges and (f, b) in m.edges for m in (self, other))  # obeys the rule already
            if e != f and a & b and not within:
                out = replace(out, rows=out.rows.where(F.col(f"{e}__id") != F.col(f"{f}__id")))
        return out

    def optional(self, other: Match) -> Match:
        """All of the other pattern or nulls: a left join on the shared variables. A group of patterns is one Match."""
        on = [f"{v}__id" for v in self._shared(other)]
        if not on:
            raise GraphError("an optional pattern must share a variable")
        rows = self.rows.join(self._minus(other, on), on, "left")
        return replace(self, rows=rows, nodes=tuple(dict.fromkeys([*self.nodes, *other.nodes])))

    def exists(self, other: Match) -> Match:
        """Matches that the other pattern continues, each kept once: a semi join."""
        on = [f"{v}__id" for v in self._shared(other)]
        return replace(self, rows=self.rows.join(other.rows.select(*on), on, "left_semi"))

    def not_exists(self, other: Match) -> Match:
        on = [f"{v}__id" for v in self._shared(other)]
        return replace(self, rows=self.rows.join(other.rows.select(*on), on, "left_anti"))

    def flag(self, name: str, other: Match) -> Match:
        """A boolean column telling whether the other pattern continues the match, for use under OR or in output."""
        on = [f"{v}__id" for v in self._shared(other)]
        marks = other.rows.select(*on).distinct().withColumn(name, F.lit(True))
        return replace(self, rows=self.rows.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False))))

    def count(self, name: str, other: Match) -> Match:
        """A column with the number of ways in which the other pattern continues the match (0 for none)."""
        on = [f"{v}__id" for v in self._shared(other)]
        counts = other.rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
        return replace(self, rows=self.rows.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0))))

    def counts(self, name: str, *branches: Match) -> Match:
        """The matches that every branch continues, with the number of ways in which they do so together: each branch is
        counted for itself and the counts are multiplied, so that no combination of branches is listed. Branches may
        share the variables of this pattern, but none of their own and no relationship type that must differ."""
        for a, b in combinations(branches, 2):
            if set(a._shared(b)) - set(self.nodes) - {e for e, _ in self.edges}:
                raise GraphError("branches share a variable that this pattern does not bind")
        for a, b in combinations((self, *branches), 2):
            if not self.repeatable and any(e != f and kinds & others for e, kinds in a.edges for f, others in b.edges):
                raise GraphError("branches with a relationship type in common must be joined, since their relationships differ")
        out, parts = self, [f"_n{next(_anonymous)}" for _ in branches]
        for part, branch in zip(parts, branches, strict=True):
            out = out.count(part, branch)
            out = out.where(F.col(part) > 0)
        total = reduce(lambda x, y: x * y, [F.col(part) for part in parts], F.lit(1).cast("long"))
        return replace(out, rows=out.rows.withColumn(name, total).drop(*parts))

    def select(self, *columns: Column | str) -> DataFrame:
        return self.rows.select(*columns)


def _only(frame: DataFrame, where: Column | None, props: dict) -> DataFrame:
    for name, value in props.items():
        frame = frame.where(F.col(name) == F.lit(value))
    return frame if where is None else frame.where(where)
