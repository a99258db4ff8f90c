"""Patterns as joins."""

from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators.match import Match
from graphloom.queries.common import match, p, registry, with_ctes

QUERIES, query = registry()


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_out(spark, d):
    return match(spark, d).node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation").select(p("c", "c_name").alias("c_name"), p("n", "n_name").alias("n_name"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def expand_in(spark, d):
    m = match(spark, d).node("n", "Nation").expand("n", "BASED_IN", "s", "Supplier", direction="in")
    return m.rows.groupBy(p("n", "n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes("SELECT a, count(*) AS n FROM (SELECT a, b FROM partner UNION ALL SELECT b, a FROM partner WHERE a <> b) GROUP BY 1"))
def expand_any(spark, d):
    m = match(spark, d).node("a", "Nation").expand("a", "PARTNER", "b", "Nation", direction="any")
    return m.rows.groupBy(p("a", "n_nationkey").alias("a")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, l_partkey, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 9000 AND l_quantity > 45")
def two_hop(spark, d):
    m = match(spark, d).node("c", "Customer", where=F.col("c_acctbal") > 9000).expand("c", "PLACED", "o", "Orders").expand("o", "CONTAINS", "p", "Part", edge="e", edge_where=F.col("l_quantity") > 45)
    return m.select(p("c", "c_custkey").alias("c_custkey"), p("p", "p_partkey").alias("l_partkey"), p("e", "l_quantity").alias("l_quantity"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > s_acctbal GROUP BY 1")
def multi_match_join(spark, d):
    """Two patterns that meet in a nation and a comparison: pairs are counted from the order of balances, not listed."""
    g = match(spark, d)
    name = p("n", "n_name").alias("g")
    a = g.node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation").select(p("n", "id").alias("id"), name, p("c", "c_acctbal").alias("v"))
    b = g.node("s", "Supplier").expand("s", "BASED_IN", "n", "Nation").select(p("n", "id").alias("id"), name, p("s", "s_acctbal").alias("v"))
    return A.pairs_above(a, b, ["id", "g"]).groupBy(F.col("g").alias("n_name")).agg(F.sum("n").alias("n"))


@query("SELECT a.r_name AS x, b.n_name AS y FROM region a, nation b")
def cartesian(spark, d):
    return match(spark, d).node("a", "Region").node("b", "Nation").select(p("a", "r_name").alias("x"), p("b", "n_name").alias("y"))


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
def theta_join(spark, d):
    m = match(spark, d).node("a", "Nation").node("b", "Nation").where((p("a", "n_nationkey") < p("b", "n_nationkey")) & (p("a", "n_regionkey") > p("b", "n_regionkey")))
    return m.select(p("a", "n_name").alias("x"), p("b", "n_name").alias("y"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey")
def optional_match(spark, d):
    g = match(spark, d)
    big = g.node("c", "Customer").expand("c", "PLACED", "o", "Orders", where=F.col("o_totalprice") > 400000)
    return g.node("c", "Customer").optional(big).select(p("c", "c_custkey").alias("c_custkey"), p("o", "o_orderkey").alias("o_orderkey"))


@query("SELECT n_name, g.c_name, g.s_name FROM nation LEFT JOIN (SELECT c_nationkey, c_name, s_name FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal > 9500 AND s_acctbal > 8000) g ON g.c_nationkey = n_nationkey")
def optional_group(spark, d):
    g = match(spark, d)
    rich = g.node("n", "Nation").expand("n", "LIVES_IN", "c", "Customer", direction="in", where=F.col("c_acctbal") > 9500).join(g.node("n", "Nation").expand("n", "BASED_IN", "s", "Supplier", direction="in", where=F.col("s_acctbal") > 8000))
    return g.node("n", "Nation").optional(rich).select(p("n", "n_name").alias("n_name"), p("c", "c_name").alias("c_name"), p("s", "s_name").alias("s_name"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def optional_is_null(spark, d):
    g = match(spark, d)
    big = g.node("c", "Customer").expand("c", "PLACED", "o", "Orders", where=F.col("o_totalprice") > 400000)
    return g.node("c", "Customer").optional(big).where(p("o", "id").isNull()).select(p("c", "c_custkey").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark, d):
    g = match(spark, d)
    sub = g.node("c", "Customer").expand("c", "PLACED", "o", "Orders", o_orderpriority="1-URGENT")
    return g.node("c", "Customer").exists(sub).select(p("c", "c_custkey").alias("c_custkey"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def not_exists_anti(spark, d):
    g = match(spark, d)
    sub = g.node("p", "Part").expand("p", "CONTAINS", "o", "Orders", direction="in", edge_where=F.col("l_quantity") > 49)
    return g.node("p", "Part").not_exists(sub).select(p("p", "p_partkey").alias("p_partkey"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer WHERE c_acctbal > 9800 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists_in_or(spark, d):
    g = match(spark, d)
    sub = g.node("c", "Customer").expand("c", "PLACED", "o", "Orders", where=F.col("o_totalprice") > 400000)
    return g.node("c", "Customer").flag("big", sub).where((p("c", "c_acctbal") > 9800) | F.col("big")).select(p("c", "c_custkey").alias("c_custkey"), "big")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def count_subquery(spark, d):
    g = match(spark, d)
    sub = g.node("c", "Customer").expand("c", "PLACED", "o", "Orders", o_orderstatus="F")
    return g.node("c", "Customer").count("n", sub).select(p("c", "c_custkey").alias("c_custkey"), "n")


@query("SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS degree FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 2")
def size_degree(spark, d):
    g = match(spark, d)
    sub = g.node("n", "Nation").expand("n", "BASED_IN", "s", "Supplier", direction="in")
    return g.node("n", "Nation").count("degree", sub).where("degree > 2").select(p("n", "n_name").alias("n_name"), "degree")


@query("SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def star_join(spark, d):
    """A nation's customers and suppliers are counted apart, since their combinations grow with the square of the tables."""
    g = match(spark, d)
    lives = g.node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation")
    based = g.node("s", "Supplier").expand("s", "BASED_IN", "n", "Nation")
    m = g.node("n", "Nation").expand("n", "IN_REGION", "r", "Region").counts("ways", lives, based)
    return m.rows.groupBy(p("n", "n_name").alias("n_name"), p("r", "r_name").alias("r_name")).agg(F.sum("ways").alias("n"))


@query(with_ctes("SELECT count(*) AS n FROM partner x JOIN partner y ON x.b = y.b WHERE x.a <> y.a"))
def different_edges(spark, d):
    m = match(spark, d).node("a", "Nation").expand("a", "PARTNER", "b", "Nation").expand("b", "PARTNER", "c", "Nation", direction="in")
    return m.rows.agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes("SELECT count(*) AS n FROM partner x JOIN partner y ON x.b = y.b"))
def repeatable_elements(spark, d):
    m = match(spark, d).repeat_elements().node("a", "Nation").expand("a", "PARTNER", "b", "Nation").expand("b", "PARTNER", "c", "Nation", direction="in")
    return m.rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 0) ON s_nationkey = n_nationkey")
def questioned_path(spark, d):
    g = match(spark, d)
    maybe = g.node("s", "Supplier").expand("s", "BASED_IN", "n", "Nation", n_regionkey=0)
    return g.node("s", "Supplier").optional(maybe).select(p("s", "s_suppkey").alias("s_suppkey"), p("n", "n_name").alias("n_name"))


@query(with_ctes("SELECT x.a AS a, y.a AS b, z.a AS c FROM partner x JOIN partner y ON x.b = y.a JOIN partner z ON y.b = z.a AND z.b = x.a"))
def cyclic_triangle(spark, d):
    m: Match = match(spark, d).node("a", "Nation").expand("a", "PARTNER", "b", "Nation").expand("b", "PARTNER", "c", "Nation").expand("c", "PARTNER", "a")
    return m.select(*[p(v, "n_nationkey").alias(v) for v in "abc"])


@query(with_ctes("SELECT s, count(*) AS pairs FROM (SELECT x.s AS s, y.s AS t FROM supplies x JOIN supplies y ON x.p = y.p AND x.s <> y.s) GROUP BY 1"))
def co_suppliers(spark, d):
    m = match(spark, d).node("s", "Supplier").expand("s", "SUPPLIES", "p", "Part", edge="x").expand("p", "SUPPLIES", "t", "Supplier", direction="in", edge="y")
    return m.rows.groupBy(p("s", "s_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("pairs"))
