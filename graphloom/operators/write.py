"""Writes: every function returns a new Graph, checked against its constraints; on a violation the old one stands."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph, GraphError


def _fitted(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows with the columns and types of a frame; missing properties are null, integers widen to double."""
    unknown = set(rows.columns) - set(like.columns)
    if unknown:
        raise GraphError(f"unknown properties {sorted(unknown)}")
    out = []
    for f in like.schema:
        if f.name not in rows.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        given = rows.schema[f.name].dataType.typeName()
        want = f.dataType.typeName()
        whole = {"byte", "short", "integer", "long"}
        if given not in (want, "void") and not (given in whole and want in {"long", "double"}):
            raise GraphError(f"{f.name} takes {want}, not {given}")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def insert_nodes(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Add nodes; rows need id and key, which must be new and unique within the type."""
    frame = graph.node_frame(label).drop("type")
    new = _fitted(rows, frame)
    clash = new.join(frame.select("key"), "key", "left_semi").take(1) or new.groupBy("key").count().where("count > 1").take(1)
    if clash:
        raise GraphError(f"a key of {label} is taken")
    return replace(graph, nodes=graph.nodes | {label: frame.unionByName(new)}).check()


def insert_relationships(graph: Graph, rel: str, rows: DataFrame) -> Graph:
    """Add relationships; rows need id, src and dst."""
    old = graph.rels[rel]
    return replace(graph, rels=graph.rels | {rel: replace(old, frame=old.frame.unionByName(_fitted(rows, old.frame)))}).check()


def set_properties(graph: Graph, owner: str, updates: DataFrame, merge: bool = True) -> Graph:
    """Set properties of nodes or relationships by id from a frame (id, properties...).

    Properties that the updates lack stay; with merge=False (reset) they become null for the rows named. The key
    cannot be set. Several updates of one row must agree; the last by column order of a tie is not defined, so they
    are refused.
    """
    frame = graph.nodes[owner] if owner in graph.nodes else graph.rels[owner].frame
    if {"key", "src", "dst"} & set(updates.columns):
        raise GraphError("key, src and dst are read-only")
    new = _fitted(updates, frame.drop("key", "src", "dst"))
    if new.distinct().groupBy("id").count().where("count > 1").take(1):
        raise GraphError("contradicting updates of one row")
    new = new.distinct().select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != "id"], F.lit(True).alias("_hit"))
    joined = frame.join(new, "id", "left")
    given = set(updates.columns)
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in given or not merge else F.col(c)
    fixed = {"id", "key", "src", "dst"}
    out = joined.select(*[F.col(c) if c in fixed else pick(c).alias(c) for c in frame.columns])
    return _swapped(graph, owner, out).check()


def set_result(graph: Graph, label: str, result: DataFrame, value: str, name: str | None = None, kind: str = "double") -> Graph:
    """Keep an algorithm's result (id, value) as a property of a node type, added if it has none of that name."""
    name = name or value
    if name not in graph.nodes[label].columns:
        graph = graph.add_property(label, name, kind)
    return set_properties(graph, label, result.select("id", F.col(value).cast(graph.nodes[label].schema[name].dataType).alias(name)))


def insert_result(graph: Graph, rel: str, pairs: DataFrame, src: str, dst: str, properties: dict[str, str] | None = None) -> Graph:
    """Keep an algorithm's pairs as relationships of a type, made if it is unknown; the pair names the relationship."""
    if rel not in graph.rels:
        graph = graph.create_relationship_type(rel, properties or {})
    number = F.xxhash64(F.lit(rel), src, dst).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    return insert_relationships(graph, rel, pairs.select(number.alias("id"), F.col(src).alias("src"), F.col(dst).alias("dst"), *(properties or {})))


def remove_properties(graph: Graph, owner: str, ids: DataFrame, *properties: str) -> Graph:
    frame = graph.nodes[owner] if owner in graph.nodes else graph.rels[owner].frame
    marked = frame.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return _swapped(graph, owner, marked.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in properties else F.col(c) for c in frame.columns])).check()


def update_where(graph: Graph, owner: str, condition: Column, **values: Column) -> Graph:
    """SET by a condition on the owner's own columns, without a join."""
    frame = graph.nodes[owner] if owner in graph.nodes else graph.rels[owner].frame
    if {"id", "key", "src", "dst"} & set(values):
        raise GraphError("id, key, src and dst are read-only")
    hit = F.coalesce(condition, F.lit(False))
    return _swapped(graph, owner, frame.withColumns({k: F.when(hit, v.cast(frame.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})).check()


def delete_nodes(graph: Graph, label: str, ids: DataFrame) -> Graph:
    """Delete nodes and every relationship at them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    nodes = graph.nodes | {label: graph.nodes[label].join(gone, F.col("id") == F.col("_gone"), "left_anti")}
    rels = {}
    for name, r in graph.rels.items():
        left = r.frame.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
        rels[name] = replace(r, frame=left) if label in (r.src, r.dst) or None in (r.src, r.dst) else r
    return replace(graph, nodes=nodes, rels=rels).check()


def delete_relationships(graph: Graph, rel: str, ids: DataFrame) -> Graph:
    frame = graph.rels[rel].frame.join(ids.select("id").distinct(), "id", "left_anti")
    return _swapped(graph, rel, frame).check()


def _swapped(graph: Graph, owner: str, frame: DataFrame) -> Graph:
    if owner in graph.nodes:
        return replace(graph, nodes=graph.nodes | {owner: frame})
    return replace(graph, rels=graph.rels | {owner: replace(graph.rels[owner], frame=frame)})


