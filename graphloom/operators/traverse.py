"""Traversal from sets of nodes, and algebra on id sets. Id sets are frames with one column, id."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.match import ANY, oriented
from graphloom.plans.graph import Graph


def links(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    """(id, rel, type, node): relationships at the given nodes and the node at the other end."""
    hops = oriented(graph.rel_frame(rels).select("id", "src", "dst", "type"), direction).withColumnRenamed("id", "rel")
    return ids.select("id").join(hops, F.col("id") == F.col("_from")).select("id", "rel", "type", F.col("_to").alias("node"))


def relationships(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    return graph.rel_frame(rels).join(links(graph, ids, direction, rels).select(F.col("rel").alias("id")).distinct(), "id", "left_semi")


def neighbors(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None, labels: str | Iterable[str] | None = None) -> DataFrame:
    """(from, id, type, key, properties): the node at the other end of each relationship."""
    found = links(graph, ids, direction, rels).select(F.col("id").alias("from"), F.col("node").alias("id"))
    return found.join(graph.node_frame(labels), "id")


def neighbor_ids(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    """(id, neighbors): each node's neighbour ids as a sorted list."""
    return links(graph, ids, direction, rels).groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("neighbors"))


def unique_neighbor_ids(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    return links(graph, ids, direction, rels).select(F.col("node").alias("id")).distinct()


def degree(graph: Graph, ids: DataFrame, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    """(id, degree): number of relationships, 0 for nodes without any."""
    n = links(graph, ids, direction, rels).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ids.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def connected(graph: Graph, a: int, b: int, direction: str = ANY, rels: str | Iterable[str] | None = None) -> DataFrame:
    """Relationships between two nodes."""
    e = graph.rel_frame(rels)
    forth, back = (F.col("src") == a) & (F.col("dst") == b), (F.col("src") == b) & (F.col("dst") == a)
    return e.where({"out": forth, "in": back, ANY: forth | back}[direction])


def intersect_ids(*sets: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.select("id").intersect(y.select("id")), sets)


def difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def union_ids(*sets: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.select("id").union(y.select("id")), sets).distinct()


def symmetric_difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference_ids(a, b).union(difference_ids(b, a))


def invert(df: DataFrame, key: str, value: str) -> DataFrame:
    """Turn a map given as rows (key, value) around: each value with the sorted list of its keys."""
    return df.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("keys"))
