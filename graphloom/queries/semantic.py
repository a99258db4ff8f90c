"""The concept layer and relationship traits."""

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.plans.concepts import Model, close, trait_violations
from graphloom.queries.common import registry, table_graph, with_ctes
from graphloom.sources.tables import SHIFT

QUERIES, query = registry()


def _model(spark, d):
    m = Model(table_graph(spark, d))
    return m, {x: m.concept(x) for x in ("Customer", "Nation", "Supplier", "Orders")}


@query("SELECT c_nationkey AS g, c_custkey AS k, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS rank FROM customer WHERE c_acctbal > 5000")
def sem_rank(spark, d):
    m, c = _model(spark, d)
    who = c["Customer"]
    found = m.select(who.c_nationkey.alias("g"), who.c_custkey.alias("k"), who.c_acctbal.alias("b")).over(who).where(who.c_acctbal > 5000)
    return found.ranked(["b"], ["g"], descending=True).drop("b")


@query("SELECT g, k FROM (SELECT c_nationkey AS g, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r <= 2")
def sem_bottom_per_group(spark, d):
    m, c = _model(spark, d)
    who = c["Customer"]
    return m.select(who.c_nationkey.alias("g"), who.c_custkey.alias("k"), who.c_acctbal.alias("b")).over(who).bottom(2, ["b", "k"], ["g"]).drop("b")


@query("SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def sem_per(spark, d):
    m, c = _model(spark, d)
    who, n = c["Customer"], c["Nation"]
    return m.select(F.count(F.lit(1)).alias("n"), F.round(F.sum(who.c_acctbal), 2).alias("total")).over(who).over(n, "LIVES_IN", who).where(who.c_acctbal > 0).per(n.n_name.alias("nation")).df()


@query("SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal > 9000 THEN 'gold' END, CASE WHEN c_acctbal > 5000 THEN 'silver' END, c_mktsegment) AS tier FROM customer")
def sem_fallback(spark, d):
    m, c = _model(spark, d)
    who = c["Customer"]
    tier = S.fallback(F.when(who.c_acctbal > 9000, "gold"), F.when(who.c_acctbal > 5000, "silver"), who.c_mktsegment)
    return m.select(who.c_custkey.alias("k"), tier.alias("tier")).over(who).df()


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9990 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def sem_union(spark, d):
    m, c = _model(spark, d)
    a = m.select(c["Customer"].c_nationkey.alias("k")).over(c["Customer"]).where(c["Customer"].c_acctbal > 9990)
    b = m.select(c["Supplier"].s_nationkey.alias("k")).over(c["Supplier"]).where(c["Supplier"].s_acctbal > 9000)
    return a | b


@query("SELECT c_custkey AS id FROM customer GROUP BY 1 HAVING count(*) > 1")
def sem_require(spark, d):
    """The rows that break an identity requirement: none."""
    m, _ = _model(spark, d)
    m.require("customers have one key", lambda g: g.node_frame("Customer").groupBy("c_custkey").count().where("count > 1"))
    m.check()
    return m.requirements["customers have one key"](m.graph).select(F.col("c_custkey").alias("id"))


@query(with_ctes(", e AS (SELECT a, b FROM partner WHERE a < b), w AS (SELECT a AS src, b AS dst FROM e UNION SELECT src, b FROM w JOIN e ON dst = a) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM w", True))
def trait_transitive(spark, d):
    e = table_graph(spark, d).rel_frame("PARTNER").where("src < dst")
    return close(e, {"transitive"}).select((F.col("src") % SHIFT).alias("src"), (F.col("dst") % SHIFT).alias("dst"))


@query(with_ctes(", e AS (SELECT a, b FROM partner WHERE n % 3 = 0), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS src, b AS dst FROM both_ways UNION SELECT src, b FROM w JOIN both_ways ON dst = a) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM w", True))
def trait_equivalence(spark, d):
    e = table_graph(spark, d).rel_frame("PARTNER").where("n % 3 = 0")
    return close(e, {"symmetric", "transitive", "reflexive"}).select((F.col("src") % SHIFT).alias("src"), (F.col("dst") % SHIFT).alias("dst"))


@query(with_ctes("SELECT x.a::BIGINT AS src, x.b::BIGINT AS dst, 'antisymmetric' AS trait FROM partner x JOIN partner y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"))
def trait_violation(spark, d):
    e = table_graph(spark, d).rel_frame("PARTNER")
    return trait_violations(e, {"irreflexive", "antisymmetric"}).select((F.col("src") % SHIFT).alias("src"), (F.col("dst") % SHIFT).alias("dst"), "trait")
