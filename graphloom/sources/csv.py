"""CSV sources of nodes and relationships, and JSON-lines sinks.

Node files have a header; a column `key` (or `name:key`) holds keys, `name:IGNORE` is left out, and without a key
column the row's position in its file is the key. Relationship files have `start_key:TYPE` and `end_key:TYPE` columns.
Lines that begin with # are comments.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.write import insert_nodes, insert_relationships
from graphloom.plans.graph import Graph, GraphError


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", separator).option("comment", "#").option("mode", "FAILFAST").csv(path)


def node_id(label: str, key: Column) -> Column:
    """Ids of loaded nodes: a 63-bit hash of type and key, the same in every load."""
    return F.xxhash64(F.lit(label), key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def load_nodes(graph: Graph, label: str, path: str, separator: str = ",") -> Graph:
    """Add a file's rows to an existing node type; values are cast to the declared property types."""
    raw = read_csv(graph.spark, path, separator)
    frame = graph.nodes[label]
    key, columns = None, {}
    for name in raw.columns:
        base, _, mark = name.partition(":")
        if mark == "IGNORE":
            continue
        if base == "key" or mark == "key":
            key = name
            if base == "key":
                continue
        columns[base] = name
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    if key is None:  # number the rows in file order: rows before a partition (one sum each), then inside it
        part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = rows.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
        past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
        rows = rows.withColumn("_part", part).join(before, "_part").withColumn("_key", (F.col("_before") + inside + 1).cast("string"))
    else:
        rows = rows.withColumn("_key", F.col(f"`{key}`"))
    known = {f.name: f.dataType for f in frame.schema}
    picked = [F.col(f"`{c}`").cast(known[p]).alias(p) for p, c in columns.items() if p in known]
    return insert_nodes(graph, label, rows.select(node_id(label, F.col("_key")).alias("id"), F.col("_key").alias("key"), *picked))


def load_relationships(graph: Graph, rel: str, path: str, separator: str = ",") -> Graph:
    """Add a file's relationships; both ends must exist, others are refused."""
    raw = read_csv(graph.spark, path, separator)
    ends = {}
    for name in raw.columns:
        base, _, label = name.partition(":")
        if base in ("start_key", "end_key"):
            ends[base] = (name, label)
    if len(ends) != 2:
        raise GraphError("a relationship file needs start_key:TYPE and end_key:TYPE")
    frame = graph.rels[rel].frame
    rows = raw
    for side, column in (("start_key", "src"), ("end_key", "dst")):
        name, label = ends[side]
        nodes = graph.nodes[label].select(F.col("id").alias(column), F.col("key").alias(f"_{column}"))
        rows = rows.join(nodes, F.col(f"`{name}`") == F.col(f"_{column}"), "left").drop(f"_{column}")
    if rows.where("src IS NULL OR dst IS NULL").take(1):
        raise GraphError("a relationship names a node that is not there")
    known = {f.name: f.dataType for f in frame.schema}
    given = [c for c in raw.columns if c.partition(":")[0] in known]
    picked = [F.col(f"`{c}`").cast(known[c.partition(":")[0]]).alias(c.partition(":")[0]) for c in given]
    new = rows.select((F.xxhash64(F.lit(rel), "src", "dst", F.monotonically_increasing_id())).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("id"), "src", "dst", *picked)
    return insert_relationships(graph, rel, new)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, the wire form of a result."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def save_graph(graph: Graph, path: str) -> None:
    """Write all frames as Parquet below a folder."""
    for name, frame in graph.nodes.items():
        frame.write.mode("overwrite").parquet(f"{path}/nodes/{name}")
    for name, r in graph.rels.items():
        r.frame.write.mode("overwrite").parquet(f"{path}/rels/{name}")


def restore_graph(graph: Graph, path: str) -> Graph:
    """A graph with this schema and the saved frames."""
    read = graph.spark.read
    nodes = {k: read.schema(f.schema).parquet(f"{path}/nodes/{k}") for k, f in graph.nodes.items()}
    rels = {k: replace(r, frame=read.schema(r.frame.schema).parquet(f"{path}/rels/{k}")) for k, r in graph.rels.items()}
    return replace(graph, nodes=nodes, rels=rels)
