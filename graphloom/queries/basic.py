"""Scans, filters, projections, sorting."""

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.queries.common import match, p, registry

QUERIES, query = registry()


@query("SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1 LIMIT 10")
def flagship(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation").expand("n", "IN_REGION", "r", "Region")
    rows = m.where(p("c", "c_acctbal") > 0).rows
    return rows.groupBy(p("r", "r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(p("c", "c_acctbal")), 2).alias("total")).orderBy("region").limit(10)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_label(spark, d):
    return match(spark, d).node("c", "Customer").select(p("c", "c_custkey").alias("c_custkey"), p("c", "c_name").alias("c_name"), p("c", "c_acctbal").alias("c_acctbal"))


@query("SELECT 'Customer' AS type, c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR FROM supplier")
def scan_label_or(spark, d):
    return match(spark, d).node("x", ["Customer", "Supplier"]).select(p("x", "type").alias("type"), p("x", "key").alias("key"))


@query("SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Orders', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents")
def scan_label_not(spark, d):
    return match(spark, d).node("x", "%", exclude=["Customer"]).rows.groupBy(p("x", "type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS n")
def scan_wildcard(spark, d):
    return match(spark, d).node("x", "%").rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 300000 AND o_orderstatus <> 'F'")
def filter_cmp(spark, d):
    m = match(spark, d).node("o", "Orders").where((p("o", "o_totalprice") >= 200000) & (p("o", "o_totalprice") < 300000) & (p("o", "o_orderstatus") != "F"))
    return m.select(p("o", "o_orderkey").alias("o_orderkey"), p("o", "o_totalprice").alias("o_totalprice"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_type, 'E') OR ends_with(p_brand, '3') OR contains(p_name, 'a1')")
def filter_string_ops(spark, d):
    m = match(spark, d).node("p", "Part").where(S.startswith(p("p", "p_type"), "E") | S.endswith(p("p", "p_brand"), "3") | S.contains(p("p", "p_name"), "a1"))
    return m.select(p("p", "p_partkey").alias("p_partkey"))


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in_list(spark, d):
    return match(spark, d).node("n", "Nation").where(p("n", "n_regionkey").isin(1, 3)).select(p("n", "n_name").alias("n_name"))


@query("SELECT count(*) AS all_rows, count(*) FILTER (c_mktsegment IS NULL) AS missing, count(*) FILTER (c_mktsegment IS NOT NULL) AS present FROM customer")
def filter_is_null(spark, d):
    seg = p("c", "c_mktsegment")
    return match(spark, d).node("c", "Customer").rows.agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(seg.isNull()).alias("missing"), F.count_if(seg.isNotNull()).alias("present"))


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -500 AND n_regionkey = 2")
def inline_where(spark, d):
    m = match(spark, d).node("c", "Customer", where=F.col("c_acctbal") < -500).expand("c", "LIVES_IN", "n", "Nation", where=F.col("n_regionkey") == 2)
    return m.select(p("c", "c_name").alias("c_name"), p("n", "n_name").alias("n_name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def inline_props(spark, d):
    return match(spark, d).node("o", "Orders", o_orderstatus="O", o_orderpriority="1-URGENT").select(p("o", "o_orderkey").alias("o_orderkey"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, count(*) AS n FROM customer GROUP BY 1")
def case_when(spark, d):
    bal = p("c", "c_acctbal")
    kind = F.when(bal < 0, "debt").when(bal < 5000, "low").otherwise("high")
    return match(spark, d).node("c", "Customer").rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey // (p_size % 5) END AS q, CASE WHEN p_size = 10 THEN NULL ELSE round(p_retailprice / (p_size - 10), 4) END AS r FROM part")
def arith_null_div(spark, d):
    size = p("p", "p_size").cast("long")
    return match(spark, d).node("p", "Part").select(p("p", "p_partkey").alias("p_partkey"), S.int_divide(p("p", "p_partkey"), size % 5).alias("q"), F.round(S.divide(p("p", "p_retailprice"), size - 10), 4).alias("r"))


@query("SELECT s_name || '/' || s_nationkey::VARCHAR AS tag FROM supplier")
def concat(spark, d):
    return match(spark, d).node("s", "Supplier").select(S.concat(p("s", "s_name"), F.lit("/"), S.string(p("s", "s_nationkey"))).alias("tag"))


@query("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 GROUP BY 1")
def let_binding(spark, d):
    m = match(spark, d).node("o", "Orders").expand("o", "CONTAINS", "p", "Part", edge="e")
    m = m.let(net=p("e", "l_extendedprice") * (1 - p("e", "l_discount"))).where(F.col("net") > 50000)
    return m.rows.groupBy(p("o", "o_orderkey").alias("l_orderkey")).agg(F.round(F.sum("net"), 4).alias("net"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_ms(date_trunc('day', ts)) AS day_ms FROM events")
def date_fn(spark, d):
    ts = p("e", "ts").cast("string")
    return match(spark, d).node("e", "Event").select(p("e", "event_id").alias("event_id"), S.epoch_millis(ts).alias("ms"), S.epoch_millis(F.substring(ts, 1, 10)).alias("day_ms"))


@query("SELECT DISTINCT c_mktsegment AS segment, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct(spark, d):
    return match(spark, d).node("c", "Customer").expand("c", "LIVES_IN", "n", "Nation").select(p("c", "c_mktsegment").alias("segment"), p("n", "n_regionkey").alias("region")).distinct()


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15")
def order_limit(spark, d):
    return match(spark, d).node("c", "Customer").rows.orderBy(p("c", "c_acctbal"), p("c", "c_custkey")).limit(15).select(p("c", "c_name").alias("c_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_desc(spark, d):
    return match(spark, d).node("o", "Orders").rows.orderBy(p("o", "o_totalprice").desc(), p("o", "o_orderkey")).limit(20).select(p("o", "o_orderkey").alias("o_orderkey"), p("o", "o_totalprice").alias("o_totalprice"))


@query("SELECT count(*) FILTER (NOT coalesce(c_acctbal > 0, false)) AS n FROM customer")
def two_valued_not(spark, d):
    return match(spark, d).node("c", "Customer").where(S.not_(p("c", "c_acctbal") > 0)).rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(c_name) AS lo, upper(c_mktsegment) AS up, replace(c_name, 'Customer', 'C') AS rep, c_name LIKE '%1' AS l, split_part(c_name, '#', 2) AS part, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS num, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 1000 THEN 1000.0 ELSE c_acctbal END AS clipped, floor(c_acctbal)::BIGINT AS fl, ceil(c_acctbal)::BIGINT AS ce, round(c_acctbal, 1) AS ro, trim(' ' || c_name || ' ') AS tr FROM customer")
def scalar_functions(spark, d):
    name, bal = p("c", "c_name"), p("c", "c_acctbal")
    number = S.split_part(name, "#", 1)
    return match(spark, d).node("c", "Customer").select(S.lower(name).alias("lo"), S.upper(p("c", "c_mktsegment")).alias("up"), S.replace(name, "Customer", "C").alias("rep"), S.like(name, "%1").alias("l"), number.alias("part"), S.integer(number).alias("num"), S.clip(bal, 0.0, 1000.0).alias("clipped"), S.floor(bal).alias("fl"), S.ceil(bal).alias("ce"), S.round_(bal, 1).alias("ro"), S.strip(F.concat(F.lit(" "), name, F.lit(" "))).alias("tr"))
