"""Variable-length, k-hop, shortest and cheapest paths over NEXT chains and the PARTNER graph."""

from pyspark.sql import functions as F

from graphloom.operators import paths as P
from graphloom.queries.common import registry, table_graph, with_ctes
from graphloom.sources.tables import SHIFT

QUERIES, query = registry()
TRAILS = """, w AS (
  SELECT a AS s, b AS e, 1 AS depth, [a * 1000 + b] AS rels, [a, b] AS nodes FROM partner
  UNION ALL
  SELECT s, b, depth + 1, list_append(rels, a * 1000 + b), list_append(nodes, b) FROM w JOIN partner ON e = a WHERE depth < 3 AND {rule}) """


def _partner(spark, d):
    g = table_graph(spark, d)
    starts = g.nodes["Nation"].select(F.col("id").alias("start"))
    return g.rel_frame("PARTNER"), starts


def _key(c):
    return (F.col(c) % SHIFT).alias(c)


def _chains(spark, d):
    g = table_graph(spark, d)
    return g.rel_frame("NEXT"), g.nodes["Event"].select(F.col("id").alias("start"))


@query(with_ctes(", w AS (SELECT a AS s, b AS e, 1 AS depth FROM next_e UNION ALL SELECT s, b, depth + 1 FROM w JOIN next_e ON e = a WHERE depth < 3) SELECT s AS start, e AS \"end\", depth FROM w", True))
def varlen_range(spark, d):
    rels, starts = _chains(spark, d)
    return P.var_length(rels, starts, 1, 3).select(_key("start"), _key("end"), "depth")


@query(with_ctes(", w AS (SELECT event_id AS s, event_id AS e, 0 AS depth FROM events UNION ALL SELECT s, b, depth + 1 FROM w JOIN next_e ON e = a WHERE depth < 2) SELECT s AS start, e AS \"end\", depth FROM w", True))
def varlen_zero(spark, d):
    rels, starts = _chains(spark, d)
    return P.var_length(rels, starts, 0, 2).select(_key("start"), _key("end"), "depth")


@query(with_ctes("SELECT user_id, count(*) AS n, max(rn - 1) AS longest FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 1 GROUP BY 1"))
def varlen_plus(spark, d):
    """All paths of any length from each user's first event: one per later event."""
    g = table_graph(spark, d)
    rels = g.rel_frame("NEXT")
    events = g.nodes["Event"]
    first = events.join(rels.select(F.col("dst").alias("id")), "id", "left_anti").select(F.col("id").alias("start"))
    found = P.path_ends(rels, first).groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    owner = events.select(F.col("id").alias("start"), "user_id")
    return found.join(owner, "start").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("depth").cast("long").alias("longest"))


@query(with_ctes("SELECT count(*) AS n FROM next_e x JOIN next_e y ON x.b = y.a JOIN next_e z ON y.b = z.a JOIN next_e u ON z.b = u.a"))
def group_repeat(spark, d):
    """((a)-[:NEXT]->(b)-[:NEXT]->(c)){2}: a group of two hops, twice."""
    rels, starts = _chains(spark, d)
    return P.var_length(rels, starts, 4, 4).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(TRAILS.format(rule="NOT list_contains(rels, a * 1000 + b)") + "SELECT depth, count(*) AS n FROM w GROUP BY 1", True))
def mode_trail(spark, d):
    return _by_depth(spark, d, P.TRAIL)


@query(with_ctes(TRAILS.format(rule="NOT list_contains(nodes, b)") + "SELECT depth, count(*) AS n FROM w GROUP BY 1", True))
def mode_acyclic(spark, d):
    return _by_depth(spark, d, P.ACYCLIC)


@query(with_ctes(TRAILS.format(rule="e <> s AND NOT list_contains(nodes[2:], b)") + "SELECT depth, count(*) AS n FROM w GROUP BY 1", True))
def mode_simple(spark, d):
    return _by_depth(spark, d, P.SIMPLE)


@query(with_ctes(TRAILS.format(rule="true") + "SELECT depth, count(*) AS n FROM w GROUP BY 1", True))
def mode_walk(spark, d):
    return _by_depth(spark, d, P.WALK)


def _by_depth(spark, d, mode):
    rels, starts = _partner(spark, d)
    return P.var_length(rels, starts, 1, 3, mode).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(TRAILS.format(rule="NOT list_contains(rels, a * 1000 + b)") + "SELECT s AS start, e AS \"end\", len(rels)::INTEGER AS length, list_transform(nodes, lambda x: x::BIGINT) AS nodes FROM w WHERE depth = 2", True))
def path_length(spark, d):
    rels, starts = _partner(spark, d)
    found = P.var_length(rels, starts, 2, 2)
    return found.select(_key("start").cast("int"), _key("end").cast("int"), F.size("rels").alias("length"), F.transform("nodes", lambda x: x % SHIFT).alias("nodes"))


KHOP = ", w AS (SELECT n_nationkey AS s, n_nationkey AS e, 0 AS depth FROM nation UNION SELECT s, b, depth + 1 FROM w JOIN partner ON e = a WHERE depth < {high}), m AS (SELECT s, e, min(depth) AS depth FROM w GROUP BY 1, 2) "


@query(with_ctes(KHOP.format(high=2) + "SELECT s::BIGINT AS start, e::BIGINT AS node, depth FROM m WHERE depth >= 1", True))
def khop(spark, d):
    rels, starts = _partner(spark, d)
    return P.k_hop(rels, starts, 1, 2).select(_key("start"), _key("node"), "depth")


@query(with_ctes(KHOP.format(high=3) + "SELECT s::BIGINT AS start, count(*) AS n FROM m WHERE depth BETWEEN 2 AND 3 GROUP BY 1", True))
def khop_count(spark, d):
    rels, starts = _partner(spark, d)
    return P.k_hop(rels, starts, 2, 3).groupBy(_key("start")).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(KHOP.format(high=4) + "SELECT depth, count(*) AS n FROM m WHERE depth >= 1 GROUP BY 1", True))
def khop_counts_by_level(spark, d):
    rels, starts = _partner(spark, d)
    return P.k_hop_counts(rels, starts, 4)


def _pairs(spark, d):
    rels, starts = _partner(spark, d)
    ends = table_graph(spark, d).nodes["Nation"].select(F.col("id").alias("end"))
    return rels, starts.crossJoin(ends).where("start <> end")  # all pairs of nations are asked for


@query(with_ctes(KHOP.format(high=15) + "SELECT s::BIGINT AS start, e::BIGINT AS \"end\", depth AS length FROM m WHERE s <> e", True))
def shortest_any(spark, d):
    return P.shortest(*_pairs(spark, d), "any").select(_key("start"), _key("end"), "length")


#: Numbers of shortest paths level by level, to the operator's bound.
BFS_COUNT = ", edge AS MATERIALIZED (SELECT a, b FROM partner), l0 AS MATERIALIZED (SELECT n_nationkey AS s, n_nationkey AS e, 1::BIGINT AS n, 0 AS depth FROM nation)" + "".join(
    f", l{i} AS MATERIALIZED (SELECT s, b AS e, sum(n)::BIGINT AS n, {i} AS depth FROM l{i - 1} JOIN edge ON e = a WHERE (s, b) NOT IN ({' UNION ALL '.join(f'SELECT (s, e) FROM l{j}' for j in range(i))}) GROUP BY 1, 2)" for i in range(1, P.SHORTEST_HOPS + 1)
)
#: Trails to a length at which every pair of nations has more than is asked for.
BFS_ALL = ", w AS (SELECT a AS s, b AS e, 1 AS depth, [a * 1000 + b] AS rels FROM partner UNION ALL SELECT s, b, depth + 1, list_append(rels, a * 1000 + b) FROM w JOIN partner ON e = a WHERE depth < 8 AND NOT list_contains(rels, a * 1000 + b)), m AS (SELECT *, dense_rank() OVER (PARTITION BY s, e ORDER BY depth) AS dr, row_number() OVER (PARTITION BY s, e ORDER BY depth, rels) AS rn FROM w WHERE s <> e) "


@query(with_ctes(BFS_COUNT + " ".join(["", *(f"{'UNION ALL' if i > 1 else ''} SELECT s::BIGINT AS start, e::BIGINT AS \"end\", depth AS length, n FROM l{i}" for i in range(1, P.SHORTEST_HOPS + 1))])))
def shortest_all(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.shortest(rels, pairs, "all").groupBy(_key("start"), _key("end"), "length").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(BFS_ALL + "SELECT s::BIGINT AS start, e::BIGINT AS \"end\", depth AS length, count(*) AS n FROM m WHERE dr <= 2 GROUP BY 1, 2, 3", True))
def shortest_k_group(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.shortest(rels, pairs, "groups", 2).groupBy(_key("start"), _key("end"), "length").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(BFS_ALL + "SELECT s::BIGINT AS start, e::BIGINT AS \"end\", depth AS length FROM m WHERE rn <= 3", True))
def shortest_k(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.shortest(rels, pairs, "k", 3).select(_key("start"), _key("end"), "length")


COST = ", w AS (SELECT a AS s, b AS e, 1.0::DOUBLE / n AS cost, [a, b] AS nodes, 1 AS depth FROM partner UNION ALL SELECT s, b, cost + 1.0::DOUBLE / n, list_append(nodes, b), depth + 1 FROM w JOIN partner ON e = a WHERE NOT list_contains(nodes, b) AND depth < {high}) "


@query(with_ctes(COST.format(high=7) + "SELECT s::BIGINT AS start, e::BIGINT AS \"end\", round(min(cost), 6) AS cost FROM w GROUP BY 1, 2", True))
def cheapest_any(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.cheapest_paths(rels, pairs, "any", cost=1.0 / F.col("n")).select(_key("start"), _key("end"), F.round("cost", 6).alias("cost"))


@query(with_ctes(COST.format(high=7) + ", b AS (SELECT s, e, min(cost) AS best FROM w GROUP BY 1, 2) SELECT s::BIGINT AS start, e::BIGINT AS \"end\", round(best, 6) AS cost, (SELECT count(*) FROM w WHERE w.s = b.s AND w.e = b.e AND abs(w.cost - best) < 1e-9) AS n FROM b", True))
def cheapest_all(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.cheapest_paths(rels, pairs, "all", cost=1.0 / F.col("n")).groupBy(_key("start"), _key("end"), F.round("cost", 6).alias("cost")).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(COST.format(high=7) + "SELECT start, \"end\", cost FROM (SELECT s::BIGINT AS start, e::BIGINT AS \"end\", round(cost, 6) AS cost, row_number() OVER (PARTITION BY s, e ORDER BY round(cost, 9)) AS r FROM w) WHERE r <= 2", True))
def cheapest_k(spark, d):
    rels, pairs = _pairs(spark, d)
    return P.cheapest_paths(rels, pairs, "k", 2, cost=1.0 / F.col("n")).select(_key("start"), _key("end"), F.round("cost", 6).alias("cost"))


@query(with_ctes("SELECT x.a AS start, count(*) AS n FROM partner x JOIN partner y ON x.b = y.a JOIN partner z ON y.b = z.a GROUP BY 1"))
def walk_count(spark, d):
    """Counts of walks by propagation; no walk is listed."""
    rels, starts = _partner(spark, d)
    return P.walk_counts(rels, starts, 3).select(_key("start").cast("int"), "n")


@query(with_ctes(", w AS (SELECT a AS s, b AS e, weight AS cost FROM next_e UNION ALL SELECT s, b, cost + weight FROM w JOIN next_e ON e = a) SELECT s AS start, count(*) AS n, round(max(cost), 3) AS far FROM w GROUP BY 1", True))
def cheapest_chain(spark, d):
    """Cheapest paths from events along their user's chain, weights being values; no path is listed."""
    rels, starts = _chains(spark, d)
    return P.farthest(rels, starts, F.col("weight")).select(_key("start"), "n", F.round("far", 3).alias("far"))
