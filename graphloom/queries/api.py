"""The find, filter and traversal interface."""

from pyspark.sql import functions as F

from graphloom.operators import find as Find
from graphloom.operators import traverse as T
from graphloom.queries.common import registry, table_graph, with_ctes
from graphloom.sources.tables import NODE_TABLES, SHIFT

QUERIES, query = registry()


def _find(name, owner, prop, op, value, sql):
    def run(spark, d):
        g = table_graph(spark, d)
        frame = g.nodes[owner] if owner in g.nodes else g.rel_frame(owner)
        return Find.find_count(frame, prop, op, value)

    QUERIES[name] = (run, sql)


_find("find_eq", "Orders", "o_orderstatus", "EQ", "F", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_find("find_neq", "Orders", "o_orderstatus", "NEQ", "F", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
_find("find_gt", "Customer", "c_acctbal", "GT", 5000.0, "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
_find("find_gte", "Part", "p_size", "GTE", 25, "SELECT count(*) AS n FROM part WHERE p_size >= 25")
_find("find_lt", "CONTAINS", "l_quantity", "LT", 10.0, "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10")
_find("find_lte", "CONTAINS", "l_discount", "LTE", 0.05, "SELECT count(*) AS n FROM lineitem WHERE l_discount <= 0.05")
_find("find_is_null", "Document", "lang", "IS_NULL", None, "SELECT count(*) AS n FROM documents WHERE lang IS NULL")
_find("find_not_is_null", "Document", "source", "NOT_IS_NULL", None, "SELECT count(*) AS n FROM documents WHERE source IS NOT NULL")
_find("find_starts_with", "Part", "p_type", "STARTS_WITH", "P", "SELECT count(*) AS n FROM part WHERE starts_with(p_type, 'P')")
_find("find_not_starts_with", "Part", "p_type", "NOT_STARTS_WITH", "P", "SELECT count(*) AS n FROM part WHERE NOT starts_with(p_type, 'P')")
_find("find_contains", "Part", "p_name", "CONTAINS", "1", "SELECT count(*) AS n FROM part WHERE contains(p_name, '1')")
_find("find_ends_with", "Supplier", "s_name", "ENDS_WITH", "7", "SELECT count(*) AS n FROM supplier WHERE ends_with(s_name, '7')")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 5")
def filter_ids_sorted(spark, d):
    g = table_graph(spark, d)
    ids = g.nodes["Orders"].where("o_orderstatus = 'O'").select("id")
    return Find.filter_ids(g.nodes["Orders"], ids, "o_totalprice", "GT", 100000.0, sort="o_totalprice", descending=True, skip=5, limit=30).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) FILTER (len(xs) > 2) AS gt, count(*) FILTER (len(xs) >= 3) AS gte, count(*) FILTER (xs[1:2] = [1, 2]) AS starts, count(*) FILTER (xs[-2:] = [2, 3]) AS ends, count(*) FILTER (list_has_all(xs, [3, 1])) AS has FROM (SELECT range(1, 1 + p_size % 6) AS xs FROM part)")
def list_predicates(spark, d):
    part = table_graph(spark, d).nodes["Part"]
    size = F.col("p_size").cast("long") % 6
    df = part.select("id", F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(size, F.lit(1)))).alias("xs"))
    rules = {"gt": ("GT", [1, 2]), "gte": ("GTE", [1, 2, 3]), "starts": ("STARTS_WITH", [1, 2]), "ends": ("ENDS_WITH", [2, 3]), "has": ("CONTAINS", [3, 1])}
    return df.agg(*[F.count_if(Find.predicate(df, "xs", op, v)).alias(k) for k, (op, v) in rules.items()])


def _ids(g, label, where):
    return g.nodes[label].where(where).select("id")


@query("SELECT c_custkey AS a, o_orderkey AS b FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0")
def neighbors(spark, d):
    g = table_graph(spark, d)
    return T.neighbors(g, _ids(g, "Customer", "c_acctbal > 0"), "out", "PLACED", "Orders").select((F.col("from") % SHIFT).alias("a"), (F.col("id") % SHIFT).alias("b"))


@query("SELECT DISTINCT c_nationkey::BIGINT AS id FROM customer WHERE c_acctbal > 0")
def unique_neighbor_ids(spark, d):
    g = table_graph(spark, d)
    return T.unique_neighbor_ids(g, _ids(g, "Customer", "c_acctbal > 0"), "out", "LIVES_IN").select((F.col("id") % SHIFT).alias("id"))


@query("SELECT c_custkey AS id, list_sort(list(o_orderkey)) AS neighbors FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def neighbor_ids(spark, d):
    g = table_graph(spark, d)
    out = T.neighbor_ids(g, _ids(g, "Customer", "c_acctbal > 0"), "out", "PLACED")
    return out.select((F.col("id") % SHIFT).alias("id"), F.transform("neighbors", lambda x: x % SHIFT).alias("neighbors"))


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + 1 + (SELECT count(*) FROM events WHERE user_id = c_custkey) AS degree FROM customer")
def degree(spark, d):
    g = table_graph(spark, d)
    return T.degree(g, _ids(g, "Customer", "true")).select((F.col("id") % SHIFT).alias("id"), "degree")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def connected(spark, d):
    g = table_graph(spark, d)
    least = g.nodes["Orders"].where("o_custkey = 7").agg(F.min("id")).first()[0]
    found = T.connected(g, NODE_TABLES["Customer"][2] * SHIFT + 7, least, "any", "PLACED")
    return found.select((F.col("dst") % SHIFT).alias("o_orderkey"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey < 12")
def ids_intersect(spark, d):
    g = table_graph(spark, d)
    return T.intersect_ids(_ids(g, "Customer", "c_acctbal > 0"), _ids(g, "Customer", "c_mktsegment = 'BUILDING'"), _ids(g, "Customer", "c_nationkey < 12")).select((F.col("id") % SHIFT).alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_nationkey >= 12")
def ids_difference(spark, d):
    g = table_graph(spark, d)
    return T.difference_ids(_ids(g, "Customer", "c_acctbal > 0"), _ids(g, "Customer", "c_nationkey < 12")).select((F.col("id") % SHIFT).alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE (c_acctbal > 0) <> (c_nationkey < 12)")
def ids_symmetric_difference(spark, d):
    g = table_graph(spark, d)
    return T.symmetric_difference_ids(_ids(g, "Customer", "c_acctbal > 0"), _ids(g, "Customer", "c_nationkey < 12")).select((F.col("id") % SHIFT).alias("id"))


@query("SELECT n_regionkey AS value, list_sort(list(n_nationkey)) AS keys FROM nation GROUP BY 1")
def invert(spark, d):
    g = table_graph(spark, d)
    return T.invert(g.nodes["Nation"].select("n_nationkey", F.col("n_regionkey").alias("value")), "n_nationkey", "value")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def paging_skip_limit(spark, d):
    return table_graph(spark, d).all_nodes("Customer", 50, 25).select("c_custkey")


@query("SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Orders', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents")
def node_counts(spark, d):
    return table_graph(spark, d).node_counts()


@query(with_ctes("SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'DID', count(*) FROM events UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM supplies UNION ALL SELECT 'NEXT', count(*) FROM next_e UNION ALL SELECT 'PARTNER', count(*) FROM partner"))
def relationship_counts(spark, d):
    return table_graph(spark, d).relationship_counts()


@query("SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey = 3")
def node_by_key(spark, d):
    return table_graph(spark, d).node("Supplier", key="3").select("s_name", "s_acctbal")
