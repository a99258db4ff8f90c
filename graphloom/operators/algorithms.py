"""Graph algorithms as iterated DataFrames. Edges are (src, dst[, weight]); vertices a frame with column id.

Undirected neighbour sets ignore loops and parallel edges where the definition says sets. Loops write a table per
round to the shared folder, so that lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.operators.paths import k_hop
from graphloom.plans.durable import durable

#: Neighbours of one vertex in a block of a wedge join.
BLOCK = 1_024
#: Edges, or pairs of neighbours, that one task of a similarity join takes, about; pairs that differ are held in memory.
SHARE = 1_000_000
#: Tasks of a similarity join at most; shares grow beyond that.
TASKS = 20_000
#: Cells into which the range of a compared value is dealt.
CELLS = 1_000


def edge_list(rels: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return rels.select("src", "dst", w.alias("weight"))


def edges_through(first: DataFrame, second: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """Edges of an intermediate node type: its first source neighbour to its first target neighbour.

    `first` and `second` are relationships from the intermediate node (src) to the ends (dst); `weight` may give
    (id, weight) of the intermediate nodes.
    """
    a = first.groupBy(F.col("src").alias("mid")).agg(F.min_by("dst", "id").alias("src"))
    b = second.groupBy(F.col("src").alias("mid")).agg(F.min_by("dst", "id").alias("dst"))
    both = a.join(b, "mid")
    if weight is None:
        return both.select("src", "dst", F.lit(1.0).alias("weight"))
    return both.join(weight.withColumnRenamed("id", "mid"), "mid", "left").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours (src, dst) without loops."""
    return both_ways(edges.select("src", "dst")).where("src <> dst").distinct()


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): ranks sum to 1; sinks spread evenly; parallel edges count; stops when ranks move less than the tolerance."""
    n = vertices.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = durable(edges.join(out, "src").where("out > 0").groupBy("src", "dst").agg((F.sum("weight") / F.first("out")).alias("p")), "share")
    sinks = vertices.join(share.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("sink", F.lit(True))
    base = durable(vertices.join(sinks, "id", "left").select("id", F.coalesce("sink", F.lit(False)).alias("sink")), "vertices")
    ranks = base.select("id", "sink", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        lost = ranks.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        gain = ranks.join(share, ranks["id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("gain"))
        new = ranks.join(gain, ranks["id"] == gain["dst"], "left").select("id", "sink", F.col("rank").alias("old"), ((1 - damping) / n + damping * lost / n + damping * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        new = durable(new, "rank")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = new.drop("old")
        if moved < tolerance:
            break
    return ranks.select("id", "rank")


def eigenvector(edges: DataFrame, vertices: DataFrame, iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): x' = sum of weight * x over out-neighbours, scaled to length 1."""
    edges = durable(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    x = durable(vertices.select("id", F.lit(1.0).alias("x")), "x")
    for _ in range(iterations):
        gain = edges.join(x, edges["dst"] == x["id"]).groupBy("src").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        y = durable(x.join(gain, x["id"] == gain["src"], "left").select("id", "x", F.coalesce("y", F.lit(0.0)).alias("y")), "y")
        norm = (y.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0) ** 0.5
        if norm == 0:
            return y.select("id", F.col("y").alias("score"))
        moved = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = y.select("id", (F.col("y") / norm).alias("x"))
        if moved < tolerance:
            break
    return x.select("id", F.col("x").alias("score"))


def betweenness(edges: DataFrame, vertices: DataFrame, directed: bool = True) -> DataFrame:
    """(id, score): Brandes' counts over all sources at once, level by level; halved if undirected, not normalised."""
    hops = edges.select("src", "dst") if directed else both_ways(edges.select("src", "dst"))
    hops = durable(hops.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m")), "hops")
    levels = [durable(vertices.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")), "level")]
    seen = levels[0].select("s", "v")
    while True:
        step = levels[-1].join(hops, levels[-1]["v"] == hops["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        step = durable(step.join(seen, ["s", "v"], "left_anti"), "level")
        if step.isEmpty():
            break
        levels.append(step)
        seen = seen.unionByName(step.select("s", "v"))
    total = None
    delta = levels[-1].select("s", "v", F.lit(0.0).alias("delta"), "sigma")
    for level in reversed(levels[:-1]):
        below = delta.select("s", F.col("v").alias("w"), F.col("delta").alias("dw"), F.col("sigma").alias("sw"))
        reach = level.join(hops, level["v"] == hops["src"]).join(below, (level["s"] == below["s"]) & (F.col("dst") == F.col("w"))).groupBy(level["s"], "v").agg(F.sum(F.col("sigma") * F.col("m") / F.col("sw") * (1 + F.col("dw"))).alias("delta"))
        total = delta if total is None else total.unionByName(delta)
        delta = durable(level.join(reach, ["s", "v"], "left").select("s", "v", F.coalesce("delta", F.lit(0.0)).alias("delta"), "sigma"), "delta")
    if total is None:
        return vertices.select("id", F.lit(0.0).alias("score"))
    score = total.where("s <> v").groupBy("v").agg(F.sum("delta").alias("score"))
    return vertices.join(score, vertices["id"] == score["v"], "left").select("id", (F.coalesce("score", F.lit(0.0)) / (1 if directed else 2)).alias("score"))


def degree_centrality(edges: DataFrame, vertices: DataFrame, direction: str = "both") -> DataFrame:
    """(id, score): degree over n - 1; `both` counts an edge at both ends."""
    n = vertices.count()
    ends = {"out": edges.select(F.col("src").alias("id")), "in": edges.select(F.col("dst").alias("id"))}
    all_ends = ends["out"].unionByName(ends["in"]) if direction == "both" else ends[direction]
    deg = all_ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return vertices.join(deg, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / F.lit(float(max(n - 1, 1)))).alias("score"))


def _common(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, u, v) for every pair u < v of neighbours of w, and (id, deg)."""
    near = durable(neighbour_sets(edges), "near")
    deg = near.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    hubs = durable(near.groupBy("src").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK), "hubs")
    # Vertices of near numbers go to one task, which adds up the pairs that they have in common before any is sent.
    lists = near.join(hubs, "src", "left_anti").repartitionByRange("src").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("l"))
    first = lists.select(F.col("src").alias("w"), "l", F.posexplode("l").alias("i", "u"))
    few = first.select("w", "u", F.explode(F.slice("l", F.col("i") + 2, F.size("l") - F.col("i") - 1)).alias("v"))
    # A hub's neighbours meet block by block, so that no task pairs more than BLOCK * BLOCK of one vertex.
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    dealt = near.join(hubs, "src").select(F.col("src").alias("w"), "dst", F.pmod(F.xxhash64("dst"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    a = dealt.select("w", F.col("dst").alias("u"), F.col("own").alias("p"), F.col("other").alias("q"))
    b = dealt.select("w", F.col("dst").alias("v"), F.col("other").alias("p"), F.col("own").alias("q"))
    return few.unionByName(a.join(b, ["w", "p", "q"]).where("u < v").select("w", "u", "v")), deg


def _shared(edges: DataFrame, ends: Callable[[Column], Column] | None = None) -> DataFrame:
    """(u, v, n, du, dv) for every pair u < v with n > 0 common neighbours, and the degrees of both. `ends` is a
    condition on u and v; the other vertices are in no pair, and have no degree here.

    All pairs of a u are counted in one task and never sent. A task has a range of u with a bounded number of pairs, and
    is sent the neighbours of each vertex that has some in its range, once, from the first of these on.
    """
    near = both_ways(edges.select("src", "dst")).where("src <> dst")
    near = durable(near if ends is None else near.where(ends(F.col("dst"))), "near")
    slices = near.count() // SHARE + 1  # given, since adaptive execution deals tasks by bytes sent, and these unfold
    lists = durable(near.repartition(slices, "src").groupBy("src").agg(F.collect_set("dst").alias("l")), "lists")
    loads = lists.select(F.explode("l").alias("u"), (F.size("l") - 1).cast("long").alias("load")).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.sum("load").alias("load"))
    loads = durable(loads.repartitionByRange("u").withColumn("part", F.spark_partition_id()), "loads")
    sums = loads.groupBy("part").agg(F.sum("load").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))  # a row per partition
    total = loads.agg(F.sum("load")).first()[0] or 0
    share = max(2 * SHARE, total // TASKS)  # a pair is in the loads of both its ends
    place = F.col("before") + F.sum("load").over(Window.partitionBy("part").orderBy("u")) - F.col("load")
    dealt = durable(loads.join(F.broadcast(before), "part").select("u", "deg", F.floor(place / share).cast("int").alias("block")), "dealt")
    members = lists.where(F.size("l") > 1).select("src", F.explode("l").alias("u")).join(dealt.select("u", "block"), "u")
    ordered = members.repartition(slices, "src").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("u", "block"))).alias("m")).select(F.col("m.u").alias("l"), F.col("m.block").alias("b"))
    # Blocks rise along a list: a block's members are a run of it, from its first place to its last.
    runs = ordered.select("l", F.reverse("b").alias("back"), "b", F.posexplode("b").alias("i", "block")).where(~F.get("b", F.col("i") - 1).eqNullSafe(F.col("block")) & (F.col("i") < F.size("b") - 1))
    own = F.size("back") - F.array_position("back", F.col("block")).cast("int") + 1 - F.col("i")
    sent = runs.select("block", own.alias("own"), F.slice("l", F.col("i") + 1, F.size("l") - F.col("i")).alias("l")).repartitionById(total // share + 1, F.col("block"))
    first = sent.select("block", "l", F.posexplode(F.slice("l", F.lit(1), F.col("own"))).alias("j", "u"))
    pairs = first.select("block", "u", F.explode(F.slice("l", F.col("j") + 2, F.size("l") - F.col("j") - 1)).alias("v"))
    n = pairs.groupBy("block", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.join(dealt.select("u", F.col("deg").alias("du")), "u").join(dealt.select(F.col("u").alias("v"), F.col("deg").alias("dv")), "v").select("u", "v", "n", "du", "dv")


def jaccard(edges: DataFrame, least: float = 1e-4, ends: Callable[[Column], Column] | None = None) -> DataFrame:
    """(u, v, score) for u < v by undirected neighbour sets; `ends` is a condition on u and v."""
    n = _shared(edges, ends)
    return n.select("u", "v", (F.col("n") / (F.col("du") + F.col("dv") - F.col("n"))).alias("score")).where(F.col("score") > least)


def cosine(edges: DataFrame, least: float = 1e-4, ends: Callable[[Column], Column] | None = None) -> DataFrame:
    n = _shared(edges, ends)
    return n.select("u", "v", (F.col("n") / F.sqrt((F.col("du") * F.col("dv")).cast("double"))).alias("score")).where(F.col("score") > least)


def adamic_adar(edges: DataFrame, least: float = 1e-4) -> DataFrame:
    """(u, v, score): sum of 1 / ln(degree) over common neighbours of degree above 1."""
    wedge, deg = _common(edges)
    w = deg.where("deg > 1").select(F.col("id").alias("w"), (1 / F.log(F.col("deg").cast("double"))).alias("x"))
    return wedge.join(w, "w").groupBy("u", "v").agg(F.sum("x").alias("score")).where(F.col("score") > least)


def preferential_attachment(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(u, v, score) for all pairs u < v of vertices with neighbours: the product of their degrees. All pairs is the feature."""
    near = neighbour_sets(edges)
    deg = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")).join(vertices.select("id"), "id")
    u, v = deg.select(F.col("id").alias("u"), F.col("deg").alias("du")), deg.select(F.col("id").alias("v"), F.col("deg").alias("dv"))
    return u.join(v, F.col("u") < F.col("v")).select("u", "v", (F.col("du") * F.col("dv")).alias("score"))


def unique_triangles(edges: DataFrame) -> DataFrame:
    """(u, v, w) with u < v < w, all three mutual neighbours.

    Edges point from the vertex of lower degree to the higher, so that a hub opens few wedges; the closing edge is
    a semi join.
    """
    near = durable(neighbour_sets(edges), "near")
    deg = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    ranked = near.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = durable(ranked.where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst"), "up")
    wedge = up.select("src", F.col("dst").alias("x")).join(up.select("src", F.col("dst").alias("y")), "src").where("x < y")
    closed = wedge.join(near.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_semi")
    ordered = closed.select(F.array_sort(F.array("src", "x", "y")).alias("t"))
    return ordered.select(*[F.col("t")[i].alias(c) for i, c in enumerate("uvw")])


def triangles(edges: DataFrame) -> DataFrame:
    """(u, v, w): every ordered triple of mutual neighbours."""
    t = unique_triangles(edges)
    orders = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.col(c).alias("w")) for a, b, c in ("uvw", "uwv", "vuw", "vwu", "wuv", "wvu")])
    return t.select(F.explode(orders).alias("t")).select("t.*")


def directed_triangle_count(edges: DataFrame) -> DataFrame:
    """(n): directed cycles a -> b -> c -> a over neighbour sets, each counted once per starting vertex; a loop is a
    cycle of its own only with itself three times, and with a pair of opposite edges.

    Vertices are ranked by degree and every pair of neighbours is listed once, from the lower to the higher, with the
    directions that exist, so that a hub opens few wedges.
    """
    e = durable(edges.select("src", "dst").distinct(), "edges")
    proper = e.where("src <> dst")
    near = both_ways(proper).distinct()
    deg = durable(near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "degrees")
    d = lambda c: deg.select(F.col("id").alias(c), F.col("deg").alias(f"d_{c}"))
    ranked = proper.join(d("src"), "src").join(d("dst"), "dst")
    up = F.struct("d_src", "src") < F.struct("d_dst", "dst")
    pair = ranked.groupBy(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y")).agg(F.max(up).alias("forth"), F.max(~up).alias("back"))
    pair = durable(pair, "ranked")
    xy, xz = pair.toDF("x", "y", "xy", "yx"), pair.toDF("x", "z", "xz", "zx")
    yz = pair.toDF("y", "z", "yz", "zy")
    t = xy.join(xz, "x").join(yz, ["y", "z"])
    n = t.agg(F.sum((F.col("xy") & F.col("yz") & F.col("zx")).cast("long") + (F.col("xz") & F.col("zy") & F.col("yx")).cast("long")).alias("n"))
    # With loops: x -> x -> y -> x for every pair of opposite edges at a loop, and x -> x -> x.
    loop = e.where("src = dst").select(F.col("src").alias("l"))
    both = pair.where("forth AND back").select(F.explode(F.array("x", "y")).alias("l")).join(loop, "l").agg(F.count(F.lit(1)).alias("m"))
    alone = loop.agg(F.count(F.lit(1)).alias("k"))
    return n.crossJoin(both).crossJoin(alone).select((3 * F.coalesce("n", F.lit(0)) + 3 * F.col("m") + F.col("k")).cast("long").alias("n"))


def local_clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, score): linked pairs among a vertex's neighbours; 0 with fewer than two neighbours."""
    deg = neighbour_sets(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    tri = unique_triangles(edges).select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    joined = vertices.select("id").join(deg, "id", "left").join(tri, "id", "left")
    score = F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return joined.select("id", score.alias("score"))


def average_clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return local_clustering(edges, vertices).agg(F.avg("score").alias("score"))


def weakly_connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each vertex's component; a vertex without edges is its own."""
    found = components(edges)
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return weakly_connected(edges, vertices).agg((F.count_distinct("component") <= 1).alias("connected"))


def reachable(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst): pairs of different vertices with a path of at least one hop."""
    return all_distances(edges, vertices).select("src", "dst")


def all_distances(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, hops) for every ordered pair of different vertices that is connected."""
    return k_hop(edges.select("src", "dst"), vertices.select(F.col("id").alias("start"))).select(F.col("start").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("hops"))


def diameter(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(low, high): both the longest distance, as an exact search leaves no range."""
    far = all_distances(edges, vertices).agg(F.max("hops").alias("low"))
    return far.select("low", F.col("low").alias("high"))


def label_propagation(edges: DataFrame, vertices: DataFrame, rounds: int = 15) -> DataFrame:
    """(id, label): in each round all vertices take their neighbours' heaviest label, the smallest among equals.

    Rounds are synchronous, so results don't depend on an order of visits; a pair that swaps labels ends with the last round.
    """
    near = durable(both_ways(edges).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "near")
    labels = durable(vertices.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = near.join(labels, near["dst"] == labels["id"]).groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select("src", (-F.col("b")["l"]).alias("new"))
        moved = durable(labels.join(best, labels["id"] == best["src"], "left").select("id", "label", F.coalesce("new", "label").alias("new")), "moved")
        changed = not moved.where("label <> new").isEmpty()
        labels = moved.select("id", F.col("new").alias("label"))
        if not changed:
            break
    return labels


def louvain(edges: DataFrame, vertices: DataFrame, passes: int = 15) -> DataFrame:
    """(id, community): one level of modularity moves.

    In a pass, vertices of one parity of a hash may move at a time to the neighbouring community of greatest gain
    k_in / 2m - sigma * k / (2m)^2; alternating halves avoids swaps without visiting vertices one by one.
    """
    near = durable(both_ways(edges.where("src <> dst")).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "near")
    m2 = near.agg(F.sum("w")).first()[0] or 0.0
    strength = near.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = durable(vertices.select("id").join(strength, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("c")), "state")
    if not m2:
        return state.select("id", F.col("c").alias("community"))
    quiet = 0
    for turn in range(2 * passes):
        sigma = state.groupBy("c").agg(F.sum("k").alias("sigma"))
        movers = state.where(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2)
        links = near.join(movers.select(F.col("id").alias("src"), "k", F.col("c").alias("own")), "src").join(state.select(F.col("id").alias("dst"), "c"), "dst")
        inside = links.groupBy("src", "k", "own", "c").agg(F.sum("w").alias("k_in")).join(sigma, "c")
        rest = F.col("sigma") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gains = inside.withColumn("gain", F.col("k_in") / m2 - rest * F.col("k") / (m2 * m2))
        best = gains.groupBy("src").agg(F.max(F.struct("gain", (-F.col("c")).alias("l"))).alias("b"), F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))), F.lit(0.0)).alias("stay"))
        wins = best.where(F.col("b")["gain"] > F.col("stay") + 1e-12).select(F.col("src").alias("id"), (-F.col("b")["l"]).alias("n"))
        new = durable(state.join(wins, "id", "left").select("id", "k", F.coalesce("n", "c").alias("c"), F.col("n").isNotNull().alias("moved")), "state")
        quiet = 0 if not new.where("moved").isEmpty() else quiet + 1
        state = new.drop("moved")
        if quiet == 2:
            break
    return state.select("id", F.col("c").alias("community"))


#: Other names under which the same two methods are offered.
leiden = louvain
infomap = label_propagation


def ranks(df: DataFrame, keys: list[str], per: list[str] = (), descending: bool = False, name: str = "rank") -> DataFrame:
    """Standard ranks 1, 2, 2, 4 within groups, nulls last either way."""
    order = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in keys]
    return df.withColumn(name, F.rank().over(Window.partitionBy(*per).orderBy(*order)))


def pairs_above(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many pairs of rows of equal keys have a greater `v` in `high` than in `low`, where there are any.

    Rows are counted by value, values are dealt into cells of their range, and each value of `high` adds the rows of
    `low` in lower cells and lower in its own. Nulls are in no pair.
    """
    mark = lambda df, h: df.select(*keys, "v", F.lit(h).alias("h"), F.lit(1 - h).alias("l"))
    both = mark(high, 1).unionByName(mark(low, 0)).where("v IS NOT NULL")
    ends = both.agg(F.min("v").alias("from"), F.max("v").alias("to"))
    cell = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("from"), F.col("to") - F.col("from")) * CELLS), F.lit(CELLS - 1)), F.lit(0))
    values = both.groupBy(*keys, "v").agg(F.sum("h").alias("h"), F.sum("l").alias("l")).crossJoin(F.broadcast(ends)).select(*keys, "v", "h", "l", cell.alias("cell"))
    within = values.withColumn("under", F.sum("l").over(Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)))
    cells = within.groupBy(*keys, "cell").agg(F.sum("h").alias("h"), F.sum("l").alias("l"), F.sum(F.col("h") * F.coalesce("under", F.lit(0))).alias("n"))
    below = F.sum("l").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = cells.withColumn("n", F.col("n") + F.col("h") * F.coalesce(below, F.lit(0)))
    return sums.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def top(df: DataFrame, n: int, keys: list[str], per: list[str] = (), descending: bool = True) -> DataFrame:
    """The first n rows per group; without groups a top-k that keeps n rows per task only."""
    order = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in keys]
    if not per:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
