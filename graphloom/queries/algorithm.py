"""Graph algorithms over nations (PARTNER), parts and suppliers (SUPPLIES)."""

from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.queries.common import registry, table_graph, with_ctes
from graphloom.sources.tables import SHIFT

QUERIES, query = registry()
NEAR = ", near AS (SELECT DISTINCT u, v FROM (SELECT a AS u, b AS v FROM partner UNION ALL SELECT b, a FROM partner) WHERE u <> v), deg AS (SELECT u, count(*) AS deg FROM near GROUP BY 1) "


def _nations(spark, d):
    g = table_graph(spark, d)
    edges = A.edge_list(g.rel_frame("PARTNER"), "n").select((F.col("src") % SHIFT).alias("src"), (F.col("dst") % SHIFT).alias("dst"), "weight")
    return edges, g.nodes["Nation"].select((F.col("id") % SHIFT).alias("id"))


@query(with_ctes("SELECT n_nationkey::BIGINT AS id, round((SELECT count(*) FROM (SELECT a AS k FROM partner UNION ALL SELECT b FROM partner) WHERE k = n_nationkey) / 24.0, 6) AS score FROM nation"))
def degree_centrality(spark, d):
    return A.degree_centrality(*_nations(spark, d)).select("id", F.round("score", 6).alias("score"))


def _iterated(first: str, step: str, moved: str, rounds: int = 20, tolerance: str = "1e-6") -> str:
    """Rounds r0, r1, ... unrolled, and the row set of the first round that moved less than the tolerance, or the last."""
    parts = [f"r0 AS MATERIALIZED ({first})"]
    for i in range(1, rounds + 1):
        parts += [f"r{i} AS MATERIALIZED ({step.format(old=f'r{i - 1}')})", f"d{i} AS MATERIALIZED (SELECT {i} AS i, {moved} AS d FROM r{i - 1} x JOIN r{i} y USING (id))"]
    ends = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(1, rounds + 1))
    rows = " UNION ALL ".join(f"SELECT {i} AS i, id, r FROM r{i}" for i in range(1, rounds + 1))
    return ", ".join(parts) + f", stop AS (SELECT coalesce(min(i) FILTER (d < {tolerance}), {rounds}) AS i FROM ({ends})), last AS (SELECT id, r FROM ({rows}) JOIN stop USING (i)) "


@query(with_ctes(", e AS MATERIALIZED (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM partner), " + _iterated("SELECT n_nationkey AS id, 0.04::DOUBLE AS r FROM nation", "SELECT n_nationkey AS id, 0.15 / 25 + 0.85 * coalesce((SELECT sum(r * p) FROM e JOIN {old} o ON e.a = o.id WHERE e.b = n_nationkey), 0) + 0.85 / 25 * coalesce((SELECT sum(r) FROM {old} WHERE id NOT IN (SELECT a FROM partner)), 0) AS r FROM nation", "sum(abs(x.r - y.r))") + "SELECT id::BIGINT AS id, round(r, 6) AS rank FROM last"))
def pagerank(spark, d):
    return A.pagerank(*_nations(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@query(with_ctes(", e AS MATERIALIZED (SELECT a, b, n FROM partner), " + _iterated("SELECT n_nationkey AS id, 1.0::DOUBLE AS r FROM nation", "SELECT id, r / sqrt(sum(r * r) OVER ()) AS r FROM (SELECT n_nationkey AS id, coalesce((SELECT sum(n * r) FROM e JOIN {old} o ON e.b = o.id WHERE e.a = n_nationkey), 0)::DOUBLE AS r FROM nation)", "sum(abs(x.r - y.r))") + "SELECT id::BIGINT AS id, round(r, 6) AS score FROM last"))
def eigenvector(spark, d):
    return A.eigenvector(*_nations(spark, d)).select("id", F.round("score", 6).alias("score"))


@query()
def betweenness(spark, d):
    return A.betweenness(*_nations(spark, d)).select("id", F.round("score", 6).alias("score"))


def _similarity(expr):
    return with_ctes(NEAR + f"SELECT x.v::BIGINT AS u, y.v::BIGINT AS v, round({expr}, 6) AS score FROM near x JOIN near y ON x.u = y.u AND x.v < y.v JOIN deg p ON p.u = x.v JOIN deg q ON q.u = y.v JOIN deg m ON m.u = x.u GROUP BY x.v, y.v, p.deg, q.deg")


@query(_similarity("count(*) / (p.deg + q.deg - count(*))"))
def jaccard(spark, d):
    return A.jaccard(_nations(spark, d)[0]).select("u", "v", F.round("score", 6).alias("score"))


@query(_similarity("count(*) / sqrt(p.deg * q.deg)"))
def cosine(spark, d):
    return A.cosine(_nations(spark, d)[0]).select("u", "v", F.round("score", 6).alias("score"))


@query(_similarity("sum(1 / ln(m.deg))").replace("m.u = x.u", "m.u = x.u AND m.deg > 1"))
def adamic_adar(spark, d):
    return A.adamic_adar(_nations(spark, d)[0]).select("u", "v", F.round("score", 6).alias("score"))


@query(with_ctes(NEAR + "SELECT p.u::BIGINT AS u, q.u::BIGINT AS v, p.deg * q.deg AS score FROM deg p JOIN deg q ON p.u < q.u"))
def pref_attachment(spark, d):
    return A.preferential_attachment(*_nations(spark, d))


TRI = NEAR + ", tri AS (SELECT x.u AS u, x.v AS v, y.v AS w FROM near x JOIN near y ON x.v = y.u JOIN near z ON z.u = x.u AND z.v = y.v WHERE {rule}) "


@query(with_ctes(TRI.format(rule="true") + "SELECT u::BIGINT AS u, v::BIGINT AS v, w::BIGINT AS w FROM tri"))
def triangles(spark, d):
    return A.triangles(_nations(spark, d)[0])


@query(with_ctes(TRI.format(rule="x.u < x.v AND x.v < y.v") + "SELECT u::BIGINT AS u, v::BIGINT AS v, w::BIGINT AS w FROM tri"))
def unique_triangles(spark, d):
    return A.unique_triangles(_nations(spark, d)[0])


@query(with_ctes("SELECT count(*) AS n FROM partner x JOIN partner y ON x.b = y.a JOIN partner z ON y.b = z.a AND z.b = x.a"))
def triangle_count_directed(spark, d):
    return A.directed_triangle_count(_nations(spark, d)[0])


LCC = TRI.format(rule="true") + ", lcc AS (SELECT n_nationkey AS id, CASE WHEN coalesce(deg, 0) < 2 THEN 0.0 ELSE (SELECT count(*) FROM tri WHERE tri.u = n_nationkey)::DOUBLE / (deg * (deg - 1)) END AS score FROM nation LEFT JOIN deg ON deg.u = n_nationkey) "


@query(with_ctes(LCC + "SELECT id::BIGINT AS id, round(score, 6) AS score FROM lcc"))
def lcc(spark, d):
    return A.local_clustering(*_nations(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(with_ctes(LCC + "SELECT round(avg(score), 6) AS score FROM lcc"))
def avg_cc(spark, d):
    return A.average_clustering(*_nations(spark, d)).select(F.round("score", 6).alias("score"))


REACH = ", w AS (SELECT n_nationkey AS s, n_nationkey AS e, 0 AS depth FROM nation UNION SELECT s, b, depth + 1 FROM w JOIN {edges} ON e = a WHERE depth < 12), m AS (SELECT s, e, min(depth) AS depth FROM w GROUP BY 1, 2) "


@query(with_ctes(", both_ways AS (SELECT a, b FROM partner UNION SELECT b, a FROM partner)" + REACH.format(edges="both_ways") + "SELECT s::BIGINT AS id, min(e)::BIGINT AS component FROM m GROUP BY 1", True))
def wcc(spark, d):
    return A.weakly_connected(*_nations(spark, d))


@query(with_ctes(", both_ways AS (SELECT a, b FROM partner UNION SELECT b, a FROM partner)" + REACH.format(edges="both_ways") + "SELECT count(DISTINCT c) <= 1 AS connected FROM (SELECT s, min(e) AS c FROM m GROUP BY 1)", True))
def is_connected(spark, d):
    return A.is_connected(*_nations(spark, d))


@query(with_ctes(REACH.format(edges="partner") + "SELECT s::BIGINT AS src, e::BIGINT AS dst FROM m WHERE s <> e", True))
def reachable(spark, d):
    return A.reachable(*_nations(spark, d))


@query(with_ctes(REACH.format(edges="partner") + "SELECT s::BIGINT AS src, e::BIGINT AS dst, depth AS hops FROM m WHERE s <> e", True))
def distance(spark, d):
    return A.all_distances(*_nations(spark, d))


@query(with_ctes(REACH.format(edges="partner") + "SELECT max(depth) AS low, max(depth) AS high FROM m WHERE s <> e", True))
def diameter(spark, d):
    return A.diameter(*_nations(spark, d))


@query()
def label_propagation(spark, d):
    return A.label_propagation(*_nations(spark, d))


@query()
def louvain(spark, d):
    return A.louvain(*_nations(spark, d))


@query(with_ctes(", near AS (SELECT p AS u, s AS v FROM supplies) SELECT count(*) AS n FROM (SELECT x.v, y.v FROM near x JOIN near y ON x.u = y.u AND x.v < y.v GROUP BY 1, 2)"))
def supplier_similarity_pairs(spark, d):
    """Supplier pairs with a common part: a bipartite graph at table scale."""
    g = table_graph(spark, d)
    rel = g.rel_frame("SUPPLIES")
    sim = A.jaccard(A.edge_list(rel), least=0.0, ends=lambda c: (c >= 4 * SHIFT) & (c < 5 * SHIFT))
    return sim.agg(F.count(F.lit(1)).alias("n"))
