"""A concept layer: concepts are node types or unions of subtypes, properties are columns, facts are inserts.

    m = Model(graph)
    person = m.concept("Person", identify_by={"id": "integer"})
    m.select(person.name).where(person.age > 30).per(person.city)

A fragment holds expressions over concepts and compiles to joins of the concepts' frames; it never builds query text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators.write import insert_nodes
from graphloom.plans.durable import durable
from graphloom.plans.graph import TRAITS, Graph, GraphError

# Primitive names of readings and the property types that they map to.
PRIMITIVES = {"String": "string", "Integer": "integer", "Int64": "integer", "Int128": "integer", "Float": "double", "Number": "double", "Decimal": "double", "Bool": "boolean", "Boolean": "boolean", "Date": "date", "DateTime": "date"}


@dataclass(frozen=True)
class Concept:
    model: Model = field(repr=False, compare=False)
    name: str
    identify_by: tuple[str, ...] = ()
    extends: tuple[str, ...] = ()
    var: str = ""

    def ref(self, var: str) -> Concept:
        """The same concept under another variable, for self-joins."""
        return replace(self, var=var)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(f"{self.var or self.name}__{name}")

    def bound(self) -> DataFrame:
        """The frame with the columns under which expressions name this concept's properties."""
        frame = self.frame()
        return frame.select(*[F.col(c).alias(f"{self.var or self.name}__{c}") for c in frame.columns])

    def require(self, name: str, condition: Column) -> None:
        """A requirement on every node of the concept: the condition must be true; null counts as false."""
        self.model.require(name, lambda g: self.bound().where(~F.coalesce(condition, F.lit(False))))

    def frame(self) -> DataFrame:
        """Nodes of this concept and of all concepts that extend it, with the union of their properties."""
        return self.model.graph.node_frame(self.model.subtypes(self.name))


@dataclass
class Model:
    graph: Graph
    concepts: dict[str, Concept] = field(default_factory=dict)
    requirements: dict[str, object] = field(default_factory=dict)

    def concept(self, name: str, identify_by: dict[str, str] | None = None, extends: tuple[str, ...] = ()) -> Concept:
        if name not in self.graph.nodes:
            self.graph = self.graph.create_node_type(name, identify_by or {})
        self.concepts[name] = Concept(self, name, tuple(identify_by or ()), extends)
        if identify_by:
            keys = list(identify_by)
            self.require(f"{name} is identified by {', '.join(keys)}", lambda g: g.node_frame(name).groupBy(*keys).count().where("count > 1"))
        return self.concepts[name]

    def subtypes(self, name: str) -> list[str]:
        found = [name]
        for c in self.concepts.values():
            if name in c.extends:
                found += [x for x in self.subtypes(c.name) if x not in found]
        return found

    def property(self, reading: str) -> str:
        """Declare by a reading such as '{Person} has name {String:name}' or '{Person} works at {Company:employer}'."""
        parts = re.findall(r"\{(\w+)(?::(\w+))?\}", reading)
        if len(parts) != 2:
            raise GraphError(f"a reading names two concepts: {reading}")
        (owner, _), (kind, role) = parts
        verb = re.sub(r"\{[^}]*\}", "", reading).strip()
        name = role or re.sub(r"\W+", "_", verb)
        if kind in PRIMITIVES:
            self.graph = self.graph.add_property(owner, name, PRIMITIVES[kind])
        else:
            self.graph = self.graph.create_relationship_type(name, src=owner, dst=kind)
        return name

    def define(self, concept: Concept, facts: DataFrame) -> None:
        """Add facts: rows of the concept's properties; the key is made of the identifying ones."""
        keys = concept.identify_by or tuple(facts.columns)
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        rows = facts.withColumn("key", key).withColumn("id", F.xxhash64(F.lit(concept.name), "key").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
        self.graph = insert_nodes(self.graph, concept.name, rows)

    def define_rule(self, name: str, rule) -> Concept:
        """A derived concept: a function from the graph to the nodes that belong to it."""
        self.graph = self.graph.create_view(name, rule)
        self.concepts[name] = Concept(self, name)
        return self.concepts[name]

    def data(self, rows: DataFrame | list[dict], name: str = "Data") -> Concept:
        """Rows given in place, as a concept of its own; equal rows are one node. Nothing is stored in the graph."""
        frame = rows if isinstance(rows, DataFrame) else self.graph.spark.createDataFrame(rows)
        columns = frame.columns
        number = F.xxhash64(F.lit(name), *columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
        nodes = frame.distinct().select(number.alias("id"), number.cast("string").alias("key"), *columns)
        return self.define_rule(name, lambda g: nodes)

    def require(self, name: str, violations) -> None:
        """A requirement is a function from the graph to the rows that break it; it is checked before every read."""
        self.requirements[name] = violations

    def check(self) -> None:
        for name, violations in self.requirements.items():
            if violations(self.graph).take(1):
                raise GraphError(f"requirement broken: {name}")

    def traits(self, rel: str, *names: str) -> None:
        self.graph = self.graph.set_traits(rel, *names)

    def select(self, *columns: Column) -> Fragment:
        return Fragment(self, columns)


@dataclass(frozen=True)
class Fragment:
    model: Model
    columns: tuple[Column, ...]
    sources: tuple[tuple[Concept, str | None, str | None], ...] = ()
    conditions: tuple[Column, ...] = ()
    keys: tuple[Column, ...] = ()
    unique: bool = False
    order: tuple[Column, ...] = ()
    n: int | None = None
    required: tuple[tuple[str, Column], ...] = ()

    def require(self, name: str, condition: Column) -> Fragment:
        """A requirement on this fragment's rows, checked when it is read."""
        return replace(self, required=(*self.required, (name, condition)))

    def over(self, concept: Concept, rel: str | None = None, of: Concept | None = None) -> Fragment:
        """Bind a concept: the first by a scan, further ones along a relationship from a bound one."""
        return replace(self, sources=(*self.sources, (concept, rel, of.var or of.name if of else None)))

    def where(self, *conditions: Column) -> Fragment:
        return replace(self, conditions=(*self.conditions, *conditions))

    def per(self, *keys: Column) -> Fragment:
        """Group: the selected columns are aggregates and the keys are real output columns."""
        return replace(self, keys=keys)

    def distinct(self) -> Fragment:
        return replace(self, unique=True)

    def order_by(self, *columns: Column) -> Fragment:
        return replace(self, order=columns)

    def limit(self, n: int) -> Fragment:
        return replace(self, n=n)

    def df(self) -> DataFrame:
        self.model.check()
        rows = None
        for concept, rel, of in self.sources:
            var = concept.var or concept.name
            frame = concept.bound()
            if rows is None:
                rows = frame
            else:
                hop = self.model.graph.rel_frame(rel).select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
                rows = rows.join(hop, F.col(f"{of}__id") == F.col("_s")).join(frame, F.col("_d") == F.col(f"{var}__id")).drop("_s", "_d")
        for c in self.conditions:
            rows = rows.where(c)
        for name, condition in self.required:
            if rows.where(~F.coalesce(condition, F.lit(False))).take(1):
                raise GraphError(f"requirement broken: {name}")
        out = rows.groupBy(*self.keys).agg(*self.columns) if self.keys else rows.select(*self.columns)
        out = out.distinct() if self.unique else out
        out = out.orderBy(*self.order) if self.order else out
        return out if self.n is None else out.limit(self.n)

    def __or__(self, other: Fragment) -> DataFrame:
        return self.df().union(other.df()).distinct()

    def __and__(self, other: Fragment) -> DataFrame:
        return self.df().intersect(other.df())

    def ranked(self, keys: list[str], per: list[str] = (), descending: bool = False) -> DataFrame:
        return A.ranks(self.df(), keys, list(per), descending)

    def top(self, n: int, keys: list[str], per: list[str] = ()) -> DataFrame:
        return A.top(self.df(), n, keys, list(per))

    def bottom(self, n: int, keys: list[str], per: list[str] = ()) -> DataFrame:
        return A.top(self.df(), n, keys, list(per), descending=False)


def close(edges: DataFrame, traits: frozenset[str] | set[str], vertices: DataFrame | None = None) -> DataFrame:
    """The pairs (src, dst) that a relationship with these traits implies. A reflexive one holds for all `vertices`
    (column id); without them, for the nodes that have a relationship."""
    if unknown := set(traits) - TRAITS:
        raise GraphError(f"unknown traits {sorted(unknown)}")
    out = durable(edges.select("src", "dst").distinct(), "pairs")  # read by every step below
    if "symmetric" in traits:
        out = A.both_ways(out).distinct()
    ends = out.selectExpr("explode(array(src, dst)) AS id").distinct()
    if "transitive" in traits:
        if "symmetric" in traits:  # an equivalence: members of one component, not closure by steps
            c = A.components(out)
            out = c.select(F.col("id").alias("src"), "component").join(c.select(F.col("id").alias("dst"), "component"), "component").select("src", "dst")
        else:
            cycles = A.all_distances(out, ends).select("src", "dst")
            back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(cycles, ["src", "dst"], "left_semi").select("src", F.col("src").alias("dst"))
            out = cycles.union(back).union(out).distinct()
    if "reflexive" in traits:
        ends = ends if vertices is None else ends.union(vertices.select("id")).distinct()
        out = out.union(ends.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    if "irreflexive" in traits:
        out = out.where("src <> dst")
    return out


def trait_violations(edges: DataFrame, traits: frozenset[str] | set[str]) -> DataFrame:
    """(src, dst, trait) of stored pairs that contradict irreflexive or antisymmetric traits."""
    e = durable(edges.select("src", "dst").distinct(), "pairs")
    none = e.where(F.lit(False)).withColumn("trait", F.lit(""))
    if "irreflexive" in traits:
        none = none.union(e.where("src = dst").withColumn("trait", F.lit("irreflexive")))
    if "antisymmetric" in traits:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        none = none.union(e.where("src < dst").join(back, ["src", "dst"], "left_semi").withColumn("trait", F.lit("antisymmetric")))
    return none
