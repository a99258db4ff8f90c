"""The property graph over the relational test tables, and the same edges as SQL for oracles.

Ids are ordinal * 2**40 + primary key, so that they are unique across types and reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.durable import durable
from graphloom.plans.graph import Graph, Lazy, Relationship

SHIFT = 1 << 40
# Node types with their table, key column and ordinal.
NODE_TABLES = {
    "Region": ("region", "r_regionkey", 1),
    "Nation": ("nation", "n_nationkey", 2),
    "Customer": ("customer", "c_custkey", 3),
    "Supplier": ("supplier", "s_suppkey", 4),
    "Part": ("part", "p_partkey", 5),
    "Orders": ("orders", "o_orderkey", 6),
    "Event": ("events", "event_id", 7),
    "Document": ("documents", "doc_id", 8),
}


def node_id(label: str, key: str | Column) -> Column:
    return F.lit(NODE_TABLES[label][2] * SHIFT) + F.col(key) if isinstance(key, str) else F.lit(NODE_TABLES[label][2] * SHIFT) + key


def _nodes(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    table, key, _ = NODE_TABLES[label]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(node_id(label, key).alias("id"), F.col(key).cast("string").alias("key"), *[F.col(c) for c in df.columns])


def _foreign(nodes: DataFrame, ordinal: int, src: Column, dst: Column) -> DataFrame:
    return nodes.select((F.lit(ordinal * SHIFT) + F.col("id") % SHIFT).alias("id"), src.alias("src"), dst.alias("dst"))


def table_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; a type's frame is made when it is first asked for."""
    nodes = Lazy({label: lambda label=label: _nodes(spark, sf_dir, label) for label in NODE_TABLES})

    def lines(*columns: str) -> DataFrame:
        line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        # Rows that are equal in every column are interchangeable and share an id.
        return line.withColumn("id", F.xxhash64(*line.columns)) if not columns else line.select(*columns)

    def foreign(label: str, ordinal: int, src: Column, dst: Column, ends: tuple[str, str]):
        return lambda: Relationship(_foreign(nodes[label], ordinal, src, dst), *ends)

    order, part, supplier = node_id("Orders", "l_orderkey"), node_id("Part", "l_partkey"), node_id("Supplier", "l_suppkey")
    rels = Lazy({
        "IN_REGION": foreign("Nation", 101, F.col("id"), node_id("Region", "n_regionkey"), ("Nation", "Region")),
        "LIVES_IN": foreign("Customer", 102, F.col("id"), node_id("Nation", "c_nationkey"), ("Customer", "Nation")),
        "BASED_IN": foreign("Supplier", 103, F.col("id"), node_id("Nation", "s_nationkey"), ("Supplier", "Nation")),
        "PLACED": foreign("Orders", 104, node_id("Customer", "o_custkey"), F.col("id"), ("Customer", "Orders")),
        "DID": foreign("Event", 105, node_id("Customer", "user_id"), F.col("id"), ("Customer", "Event")),
        "CONTAINS": lambda: Relationship(lines().select("id", order.alias("src"), part.alias("dst"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"), "Orders", "Part"),
        "SHIPPED": lambda: Relationship(lines().select("id", supplier.alias("src"), order.alias("dst"), "l_quantity", "l_shipdate"), "Supplier", "Orders"),
        "SUPPLIES": lambda: Relationship(supplies(lines("l_suppkey", "l_partkey", "l_quantity")), "Supplier", "Part"),
        "NEXT": lambda: Relationship(next_events(nodes["Event"]), "Event", "Event"),
        "PARTNER": lambda: Relationship(durable(partners(spark, sf_dir), "partner"), "Nation", "Nation"),  # few rows from four large tables, read by every hop
    })
    return Graph(spark, nodes, rels)


def supplies(line: DataFrame) -> DataFrame:
    """Supplier to part, once per pair, with the number of lines and the quantity."""
    pairs = line.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    src, dst = node_id("Supplier", "l_suppkey"), node_id("Part", "l_partkey")
    return pairs.select(F.xxhash64("l_suppkey", "l_partkey").alias("id"), src.alias("src"), dst.alias("dst"), "n", "qty")


def next_events(events: DataFrame) -> DataFrame:
    """Each event to the same user's next one, with the gap in seconds and the next event's value as weight."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = events.select("id", "ts", F.lead("id").over(w).alias("dst"), F.lead("ts").over(w).alias("ts2"), F.lead("value").over(w).alias("weight"))
    return after.where("dst IS NOT NULL").select((F.lit(106 * SHIFT) + F.col("id") % SHIFT).alias("id"), F.col("id").alias("src"), "dst", (F.timestamp_diff("MICROSECOND", "ts", "ts2") / 1_000_000.0).alias("gap_s"), "weight")


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer nation to the three other supplier nations with most order lines between them, ties by key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # Nations are attached to orders and to lines first, so that lines are shuffled by their order only.
    placed = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sold = read("lineitem").select("l_orderkey", "l_suppkey").join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    per = sold.select("l_orderkey", "s_nationkey").join(placed.select("l_orderkey", "c_nationkey"), "l_orderkey")
    n = per.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey")
    best = n.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return best.select((F.lit(107 * SHIFT) + F.col("c_nationkey") * 1000 + F.col("s_nationkey")).alias("id"), node_id("Nation", "c_nationkey").alias("src"), node_id("Nation", "s_nationkey").alias("dst"), "n")


#: The derived relationship types as SQL, shared by all oracles.
ORACLE_CTES = """
next_e AS (
  SELECT * FROM (
    SELECT event_id AS a, user_id, ts, lead(event_id) OVER w AS b, lead(ts) OVER w AS ts2, lead(value) OVER w AS weight
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS NOT NULL),
partner AS (
  SELECT a, b, n FROM (
    SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) WHERE r <= 3),
supplies AS (
  SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
"""
