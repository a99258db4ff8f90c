"""Aggregation, pipelines of segments, set operations."""

from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.queries.common import match, p, registry

QUERIES, query = registry()


@query("SELECT count(*) AS n, count(c_mktsegment) AS m, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 4) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def agg_global(spark, d):
    b = p("c", "c_acctbal")
    return match(spark, d).node("c", "Customer").rows.agg(F.count(F.lit(1)).alias("n"), F.count(p("c", "c_mktsegment")).alias("m"), F.round(F.sum(b), 2).alias("s"), F.round(F.avg(b), 4).alias("a"), F.min(b).alias("lo"), F.max(b).alias("hi"))


@query("SELECT o_orderpriority AS pr, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1")
def agg_group(spark, d):
    return match(spark, d).node("o", "Orders").rows.groupBy(p("o", "o_orderpriority").alias("pr")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p("o", "o_totalprice")), 4).alias("a"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo FROM orders WHERE o_totalprice < -1")
def agg_empty(spark, d):
    return match(spark, d).node("o", "Orders").where(p("o", "o_totalprice") < -1).rows.agg(F.count(F.lit(1)).alias("n"), F.sum(p("o", "o_totalprice")).alias("s"), F.min(p("o", "o_orderkey")).alias("lo"))


@query("SELECT count(DISTINCT o_custkey) AS customers, sum(DISTINCT o_custkey)::BIGINT AS total, o_orderstatus AS st FROM orders GROUP BY 3")
def agg_distinct(spark, d):
    k = p("o", "o_custkey")
    return match(spark, d).node("o", "Orders").rows.groupBy(p("o", "o_orderstatus").alias("st")).agg(F.count_distinct(k).alias("customers"), F.sum_distinct(k).alias("total"))


@query("SELECT r_name, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_collect(spark, d):
    m = match(spark, d).node("n", "Nation").expand("n", "IN_REGION", "r", "Region")
    return m.rows.groupBy(p("r", "r_name").alias("r_name")).agg(F.sort_array(F.collect_list(p("n", "n_name"))).alias("nations"))


@query("SELECT c_mktsegment AS seg, round(sum(c_acctbal) / count(*), 4) AS mean, CASE WHEN count(*) > 300 THEN 'many' ELSE 'few' END AS size FROM customer GROUP BY 1")
def agg_expr(spark, d):
    n = F.count(F.lit(1))
    return match(spark, d).node("c", "Customer").rows.groupBy(p("c", "c_mktsegment").alias("seg")).agg(F.round(F.sum(p("c", "c_acctbal")) / n, 4).alias("mean"), F.when(n > 300, "many").otherwise("few").alias("size"))


@query("SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 7")
def order_by_agg(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation")
    return m.rows.groupBy(p("n", "n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n_name").limit(7).select("n_name")


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40) GROUP BY 1")
def next_pipeline(spark, d):
    rich = match(spark, d).node("c", "Customer").rows.orderBy(p("c", "c_acctbal").desc(), p("c", "c_custkey")).limit(40)
    m = match(spark, d)
    after = replace(m, rows=rich, nodes=("c",)).expand("c", "LIVES_IN", "n", "Nation").expand("c", "PLACED", "o", "Orders")
    return after.rows.groupBy(p("n", "n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def next_having(spark, d):
    return match(spark, d).node("o", "Orders").rows.groupBy(p("o", "o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("SELECT avg(v) AS a FROM (SELECT o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def standalone_sort_segment(spark, d):
    best = match(spark, d).node("o", "Orders").rows.orderBy(p("o", "o_totalprice").desc(), p("o", "o_orderkey")).limit(10)
    return best.agg(F.avg(p("o", "o_totalprice")).alias("a"))


def _keys(spark, d):
    g = match(spark, d)
    c = g.node("c", "Customer").select(p("c", "c_nationkey").alias("k"))
    s = g.node("s", "Supplier", where=F.col("s_acctbal") > 0).select(p("s", "s_nationkey").alias("k"))
    return c, s


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def union(spark, d):
    c, s = _keys(spark, d)
    return c.union(s).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def union_all(spark, d):
    c, s = _keys(spark, d)
    return c.union(s)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect(spark, d):
    c, s = _keys(spark, d)
    return c.intersect(s)


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_all(spark, d):
    c, s = _keys(spark, d)
    return c.intersectAll(s)


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k DESC LIMIT 5")
def setop_order_limit(spark, d):
    g = match(spark, d)
    both = g.node("c", "Customer").select(p("c", "c_nationkey").alias("k")).union(g.node("s", "Supplier").select(p("s", "s_nationkey").alias("k"))).distinct()
    return both.orderBy(F.desc("k")).limit(5)


@query("SELECT c_mktsegment AS seg, count(*) FILTER (c_acctbal > 0) AS positive, round(sum(c_acctbal) FILTER (c_acctbal > 0), 2) AS s FROM customer GROUP BY 1")
def filtered_aggregate(spark, d):
    ok = p("c", "c_acctbal") > 0
    return match(spark, d).node("c", "Customer").rows.groupBy(p("c", "c_mktsegment").alias("seg")).agg(F.count_if(ok).alias("positive"), F.round(F.sum(F.when(ok, p("c", "c_acctbal"))), 2).alias("s"))


@query("SELECT c_custkey AS k, c_nationkey AS g, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS LAST) AS rank FROM customer")
def rank_per_group(spark, d):
    rows = match(spark, d).node("c", "Customer").select(p("c", "c_custkey").alias("k"), p("c", "c_nationkey").alias("g"), p("c", "c_mktsegment").alias("seg"))
    return A.ranks(rows, ["seg"], ["g"]).drop("seg")


@query("SELECT g, k FROM (SELECT c_nationkey AS g, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r <= 3")
def top_per_group(spark, d):
    rows = match(spark, d).node("c", "Customer").select(p("c", "c_nationkey").alias("g"), p("c", "c_custkey").alias("k"), p("c", "c_acctbal").alias("b"))
    return A.top(rows, 3, ["b", "k"], ["g"]).drop("b")
