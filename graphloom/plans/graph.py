"""A property graph as DataFrames: one frame per node type and per relationship type, plus a schema and rules.

Node frames have columns id, key and the properties; relationship frames id, src, dst and the properties. A Graph is
immutable: every change returns a new one that shares the untouched frames, so a failed constraint check simply leaves
the old graph in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.durable import durable

# Property types by their schema names.
PROPERTY_TYPES = {
    "boolean": T.BooleanType(),
    "integer": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.TimestampType(),
    "boolean_list": T.ArrayType(T.BooleanType()),
    "integer_list": T.ArrayType(T.LongType()),
    "double_list": T.ArrayType(T.DoubleType()),
    "string_list": T.ArrayType(T.StringType()),
    "date_list": T.ArrayType(T.TimestampType()),
}
TRAITS = {"symmetric", "transitive", "reflexive", "irreflexive", "antisymmetric"}


class GraphError(ValueError):
    """A name that is unknown or taken, a type that does not fit, a violated constraint or a forbidden write."""


class Lazy(dict):
    """A dict whose values may be functions without arguments, called when first asked for, so that a query opens the
    tables it reads and no others."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if callable(value):
            value = value()
            self[key] = value
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]

    def __or__(self, other: dict) -> Lazy:
        return Lazy([*dict.items(self), *dict.items(other)])

    def without(self, key: str) -> Lazy:
        return Lazy([(k, v) for k, v in dict.items(self) if k != key])


@dataclass(frozen=True)
class Relationship:
    """A relationship type: its frame and the node types at its ends (None: any)."""

    frame: DataFrame
    src: str | None = None
    dst: str | None = None


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: Lazy = field(default_factory=Lazy)
    rels: Lazy = field(default_factory=Lazy)
    views: dict[str, Callable[[Graph], DataFrame]] = field(default_factory=dict)
    constraints: dict[str, Callable[[Graph], DataFrame]] = field(default_factory=dict)
    traits: dict[str, frozenset[str]] = field(default_factory=dict)
    indexes: frozenset[tuple[str, str, str]] = frozenset()
    #: Kept term tables of full-text indexes by (type, properties).
    texts: dict[tuple[str, tuple[str, ...]], DataFrame] = field(default_factory=dict)

    # --- frames -----------------------------------------------------------------------------------------------

    def __post_init__(self):
        for name in ("nodes", "rels"):
            if not isinstance(getattr(self, name), Lazy):
                object.__setattr__(self, name, Lazy(getattr(self, name)))

    def labels(self, labels: str | Iterable[str] | None = None, exclude: Iterable[str] = ()) -> list[str]:
        """Resolve a label expression: None or '%' is any type, a list is a union, exclude negates."""
        wanted = list(self.nodes) if labels in (None, "%") else [labels] if isinstance(labels, str) else list(labels)
        for name in [*wanted, *exclude]:
            if name not in self.nodes and name not in self.views:
                raise GraphError(f"unknown node type {name}")
        return [x for x in wanted if x not in set(exclude)]

    def node_frame(self, labels: str | Iterable[str] | None = None, exclude: Iterable[str] = (), also: Iterable[str] = ()) -> DataFrame:
        """All nodes of some types with id, type, key and the union of their properties (null where a type lacks one).

        `also` is a conjunction: a node must belong to each of these types or views as well. Excluded views are taken
        away node by node, since their nodes have another type of their own.
        """
        frames = []
        for name in self.labels(labels, exclude):
            frame = self.views[name](self) if name in self.views else self.nodes[name]
            frames.append(frame.withColumn("type", F.lit(name)))
        if not frames:
            return self.spark.createDataFrame([], "id long, key string, type string")
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        for name in also:
            out = out.join(self.node_frame(name).select("id"), "id", "left_semi")
        for name in exclude:
            if name in self.views:
                out = out.join(self.node_frame(name).select("id"), "id", "left_anti")
        return out

    def rel_frame(self, types: str | Iterable[str] | None = None) -> DataFrame:
        """All relationships of some types with id, src, dst, type and the union of their properties."""
        wanted = list(self.rels) if types is None else [types] if isinstance(types, str) else list(types)
        frames = []
        for name in wanted:
            if name not in self.rels:
                raise GraphError(f"unknown relationship type {name}")
            frames.append(self.rels[name].frame.withColumn("type", F.lit(name)))
        if not frames:
            return self.spark.createDataFrame([], "id long, src long, dst long, type string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    # --- schema -----------------------------------------------------------------------------------------------

    @staticmethod
    def _struct(base: str, properties: dict[str, str]) -> T.StructType:
        schema = T.StructType.fromDDL(base)
        for name, kind in properties.items():
            if name in ("id", "key", "type", "src", "dst"):
                raise GraphError(f"property name {name} is reserved")
            if kind not in PROPERTY_TYPES:
                raise GraphError(f"unknown property type {kind}")
            schema = schema.add(name, PROPERTY_TYPES[kind])
        return schema

    def create_node_type(self, name: str, properties: dict[str, str] | None = None) -> Graph:
        if name in self.nodes:
            raise GraphError(f"node type {name} exists")
        frame = self.spark.createDataFrame([], self._struct("id long, key string", properties or {}))
        return replace(self, nodes=self.nodes | {name: frame})

    def create_relationship_type(self, name: str, properties: dict[str, str] | None = None, src: str | None = None, dst: str | None = None) -> Graph:
        if name in self.rels:
            raise GraphError(f"relationship type {name} exists")
        frame = self.spark.createDataFrame([], self._struct("id long, src long, dst long", properties or {}))
        return replace(self, rels=self.rels | {name: Relationship(frame, src, dst)})

    def drop_node_type(self, name: str) -> Graph:
        """Drop a type, its nodes, and all relationships at them."""
        gone = self.node_frame(name).select("id")
        rels = {k: replace(r, frame=r.frame.join(gone, r.frame["src"] == gone["id"], "left_anti").join(gone, F.col("dst") == gone["id"], "left_anti")) for k, r in self.rels.items()}
        return replace(self, nodes=self.nodes.without(name), rels=Lazy(rels))

    def drop_relationship_type(self, name: str) -> Graph:
        self.rel_frame(name)
        return replace(self, rels=self.rels.without(name))

    def _altered(self, owner: str, change: Callable[[DataFrame], DataFrame]) -> Graph:
        if owner in self.nodes:
            return replace(self, nodes=self.nodes | {owner: change(self.nodes[owner])})
        if owner in self.rels:
            return replace(self, rels=self.rels | {owner: replace(self.rels[owner], frame=change(self.rels[owner].frame))})
        raise GraphError(f"unknown type {owner}")

    def add_property(self, owner: str, name: str, kind: str) -> Graph:
        field_type = self._struct("id long", {name: kind})[name].dataType

        def change(df: DataFrame) -> DataFrame:
            if name in df.columns:
                raise GraphError(f"property {owner}.{name} exists")
            return df.withColumn(name, F.lit(None).cast(field_type))

        return self._altered(owner, change)

    def drop_property(self, owner: str, name: str) -> Graph:
        def change(df: DataFrame) -> DataFrame:
            if name not in df.columns or name in ("id", "key", "src", "dst"):
                raise GraphError(f"no property {owner}.{name}")
            return df.drop(name)

        return self._altered(owner, change)

    def property_types(self, owner: str) -> dict[str, str]:
        frame = self.nodes[owner] if owner in self.nodes else self.rel_frame(owner).drop("type")
        names = {v: k for k, v in PROPERTY_TYPES.items()}
        return {f.name: names.get(f.dataType, f.dataType.simpleString()) for f in frame.schema if f.name not in ("id", "key", "src", "dst")}

    # --- indexes, views, constraints, traits ------------------------------------------------------------------

    def create_index(self, owner: str, prop: str, kind: str = "property") -> Graph:
        """Record an index. Reads use Parquet statistics and pushed filters; for full text see create_text_index."""
        if owner not in self.nodes and owner not in self.rels:
            raise GraphError(f"unknown type {owner}")
        return replace(self, indexes=self.indexes | {(owner, prop, kind)})

    def create_text_index(self, owner: str, *properties: str) -> Graph:
        """Build and keep the term table of some string properties; later searches read it instead of the texts."""
        from graphloom.operators.search import terms

        table = durable(terms(self.node_frame(owner), *properties), "terms")
        out = replace(self, texts=self.texts | {(owner, properties): table})
        for p in properties:
            out = out.create_index(owner, p, "fulltext")
        return out

    def text_terms(self, owner: str, *properties: str) -> DataFrame:
        """The kept term table of an index, or one built for this use."""
        from graphloom.operators.search import terms

        kept = self.texts.get((owner, properties))
        return terms(self.node_frame(owner), *properties) if kept is None else kept

    def drop_index(self, owner: str, prop: str) -> Graph:
        return replace(self, indexes=frozenset(x for x in self.indexes if x[:2] != (owner, prop)))

    def show_indexes(self, owner: str | None = None) -> DataFrame:
        rows = sorted(x for x in self.indexes if owner in (None, x[0]))
        return self.spark.createDataFrame(rows, "type string, property string, kind string")

    def create_view(self, name: str, body: Callable[[Graph], DataFrame]) -> Graph:
        """A named set of nodes: body gives a frame with id, key and properties, and the name works like a label."""
        if name in self.nodes or name in self.views:
            raise GraphError(f"name {name} is taken")
        return replace(self, views=self.views | {name: body})

    def drop_view(self, name: str) -> Graph:
        return replace(self, views={k: v for k, v in self.views.items() if k != name})

    def create_constraint(self, name: str, violations: Callable[[Graph], DataFrame]) -> Graph:
        """A constraint gives the rows that violate it; after each write there must be none."""
        return replace(self, constraints=self.constraints | {name: violations})

    def drop_constraint(self, name: str) -> Graph:
        return replace(self, constraints={k: v for k, v in self.constraints.items() if k != name})

    def check(self) -> Graph:
        """This graph, or GraphError if a constraint is violated; one row per constraint is looked for."""
        for name, violations in self.constraints.items():
            if violations(self).take(1):
                raise GraphError(f"constraint {name} is violated")
        return self

    def set_traits(self, rel: str, *traits: str) -> Graph:
        if unknown := set(traits) - TRAITS:
            raise GraphError(f"unknown traits {sorted(unknown)}")
        return replace(self, traits=self.traits | {rel: self.traits.get(rel, frozenset()) | set(traits)})

    # --- scans and point reads --------------------------------------------------------------------------------

    def all_nodes(self, label: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        return _paged(self.node_frame(label), skip, limit)

    def all_relationships(self, rel: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        return _paged(self.rel_frame(rel), skip, limit)

    def node_counts(self) -> DataFrame:
        """(type, n), types without nodes included; counts are computed per frame, before any union."""
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("type"), "n") for k, df in self.nodes.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "type string, n long")

    def relationship_counts(self) -> DataFrame:
        parts = [r.frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("type"), "n") for k, r in self.rels.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "type string, n long")

    def node(self, label: str | None, key: str | list[str] | None = None, id: int | list[int] | None = None) -> DataFrame:
        """Nodes by one key or id, or by a list of them; unknown ones give no row."""
        wanted, name = (key, "key") if id is None else (id, "id")
        return self.node_frame(label).where(F.col(name).isin(wanted if isinstance(wanted, list) else [wanted]))

    def relationship(self, rel: str | None, id: int | list[int]) -> DataFrame:
        return self.rel_frame(rel).where(F.col("id").isin(id if isinstance(id, list) else [id]))


def _paged(df: DataFrame, skip: int, limit: int | None) -> DataFrame:
    if not skip and limit is None:
        return df
    df = df.orderBy("id").offset(skip)
    return df if limit is None else df.limit(limit)


def prop(var: str, name: str) -> Column:
    """The column of a bound variable's property."""
    return F.col(f"{var}__{name}")
