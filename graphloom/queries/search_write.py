"""Full-text search, writes, schema changes, views, constraints."""

from pyspark.sql import functions as F

from graphloom.operators import search as S
from graphloom.operators import write as W
from graphloom.operators.match import Match
from graphloom.queries.common import match, p, registry, table_graph
from graphloom.sources.tables import SHIFT, node_id

QUERIES, query = registry()
TERMS = "WITH t AS (SELECT id, term, count(*) AS tf FROM (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '[^\\p{L}\\p{N}]+')) AS term FROM part) WHERE term <> '' GROUP BY 1, 2), s AS (SELECT id, sum(tf) AS dl FROM t GROUP BY 1), h AS (SELECT * FROM t WHERE WHERE_), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1) SELECT id, round(sum(ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM s)))), 6) AS score FROM h JOIN df USING (term) JOIN s USING (id) GROUP BY 1"


def _search(spark, d, text, fuzzy):
    part = table_graph(spark, d).nodes["Part"].withColumn("id", F.col("id") % SHIFT)
    return S.search(S.terms(part, "p_name", "p_type"), part, text, fuzzy, limit=None).select("id", F.round("score", 6).alias("score"))


@query(TERMS.replace("WHERE_", "term IN ('economy', '7', 'steel', 'brass')"))
def fts_exact(spark, d):
    return _search(spark, d, "ECONOMY 7 steel, brass", False)


@query(TERMS.replace("WHERE_", "levenshtein(term, 'stel') <= 2"))
def fts_fuzzy(spark, d):
    return _search(spark, d, "stel", True)


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9900")
def view_expansion(spark, d):
    g = table_graph(spark, d).create_view("Wealthy", lambda g: g.nodes["Customer"].where("c_acctbal > 9900"))
    return Match(g).node("w", "Wealthy").expand("w", "PLACED", "o", "Orders").select(p("w", "c_custkey").alias("c_custkey"), p("o", "o_orderkey").alias("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < -900")
def constraint_violations(spark, d):
    g = table_graph(spark, d).create_constraint("solvent", lambda g: g.nodes["Customer"].where("c_acctbal < -900"))
    return g.constraints["solvent"](g).select("c_custkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey >= 5 UNION ALL SELECT 900000, 'New', 500.0")
def insert_delete_nodes(spark, d):
    g = table_graph(spark, d)
    new = spark.range(1).select(node_id("Supplier", F.lit(900000)).alias("id"), F.lit("900000").alias("key"), F.lit(900000).cast("long").alias("s_suppkey"), F.lit("New").alias("s_name"), F.lit(500).alias("s_acctbal"))
    g = W.insert_nodes(g, "Supplier", new)
    g = W.delete_nodes(g, "Supplier", g.nodes["Supplier"].where("s_suppkey < 5").select("id"))
    return g.nodes["Supplier"].select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT count(*) AS n FROM lineitem WHERE l_suppkey >= 5")
def delete_detaches(spark, d):
    g = table_graph(spark, d)
    g = W.delete_nodes(g, "Supplier", g.nodes["Supplier"].where("s_suppkey < 5").select("id"))
    return g.rel_frame("SHIPPED").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def set_remove_properties(spark, d):
    g = W.update_where(table_graph(spark, d), "Customer", F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))
    g = W.remove_properties(g, "Customer", g.nodes["Customer"].where("c_custkey % 2 = 0").select("id"), "c_mktsegment")
    return g.nodes["Customer"].select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'N' || n_nationkey::VARCHAR ELSE n_name END AS n_name FROM nation")
def set_by_join(spark, d):
    g = table_graph(spark, d)
    updates = g.nodes["Nation"].where("n_regionkey = 1").select("id", F.concat(F.lit("N"), "key").alias("n_name"))
    return W.set_properties(g, "Nation", updates).nodes["Nation"].select("n_nationkey", "n_name")


@query("SELECT 'Customer' AS type, 'c_name' AS property, 'fulltext' AS kind UNION ALL SELECT 'Orders', 'o_totalprice', 'property'")
def show_indexes(spark, d):
    g = table_graph(spark, d).create_index("Customer", "c_name", "fulltext").create_index("Orders", "o_totalprice").create_index("Part", "p_size").drop_index("Part", "p_size")
    return g.show_indexes()


@query("SELECT r_regionkey, NULL::BIGINT AS score FROM region")
def alter_type(spark, d):
    g = table_graph(spark, d).add_property("Region", "score", "integer").drop_property("Region", "r_name")
    return g.nodes["Region"].select("r_regionkey", "score")


@query("SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND c_acctbal < 4000")
def contradiction(spark, d):
    """Contradictory ranges: Catalyst proves little here, so the scan's row-group statistics decide; the answer is empty."""
    m = match(spark, d).node("c", "Customer", where=(F.col("c_acctbal") > 5000) & (F.col("c_acctbal") < 4000)).expand("c", "LIVES_IN", "n", "Nation")
    return m.rows.agg(F.count(F.lit(1)).alias("n"))
