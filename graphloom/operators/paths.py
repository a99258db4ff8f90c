"""Paths as rounds of joins: variable length, k hops, shortest and cheapest paths.

All functions take a frame of relationships (id, src, dst, any properties) and a frame of start ids (column `start`).
A round is one equi-join with the relationships; lineage is cut between rounds, and a loop ends when its frontier is
empty. A bound that is reached without being asked for raises, so results are never silently cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.match import OUT, oriented
from graphloom.plans.durable import durable
from graphloom.plans.graph import GraphError

WALK, TRAIL, ACYCLIC, SIMPLE = "walk", "trail", "acyclic", "simple"
#: Rounds after which a search without an upper bound raises.
SAFETY = 200
#: Hops that shortest paths search if no quantifier is given.
SHORTEST_HOPS = 15


def _hops(rels: DataFrame, direction: str) -> DataFrame:
    return oriented(rels, direction)


def _stored(rels: DataFrame, *columns: Column | str) -> DataFrame:
    """The relationships as a slim table, so that rounds don't derive them again."""
    return durable(rels.select("src", "dst", *columns), "hops")


def var_length(rels: DataFrame, starts: DataFrame, low: int = 1, high: int | None = None, mode: str = TRAIL, direction: str = OUT, inner: DataFrame | None = None, until=None) -> DataFrame:
    """(start, end, depth, rels, nodes) of all paths of low to high hops.

    TRAIL repeats no relationship, ACYCLIC no node, SIMPLE no node save that the end may be the start, WALK may repeat
    anything and so needs an upper bound. Depth 0 is the start itself. `rels` and `nodes` list the path's ids in order.
    A hop may stand for several relationships: its id is then the array of theirs. `inner` (column id) lists the nodes
    that a path may pass through. `until(front, depth)` may drop paths of a round, and those that grow from them.
    """
    if high is None and mode == WALK:
        raise GraphError("a walk without an upper bound may be endless")
    one = F.col("id") if isinstance(rels.schema["id"].dataType, T.ArrayType) else F.array("id")
    slim = rels.select("src", "dst", one.alias("id"))
    slim = slim if high is not None and high <= 1 else _stored(slim, "id")
    hops = _hops(slim, direction).select("_from", "_to", F.col("id").alias("_rel"))
    front = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("rels"), F.array("start").alias("nodes"))
    found = [front] if low == 0 else []
    depth = 0
    while high is None or depth < high:
        depth += 1
        if depth > SAFETY:
            raise GraphError(f"paths of more than {SAFETY} hops: give an upper bound")
        if inner is not None and depth > 1:
            front = front.join(inner.select(F.col("id").alias("end")), "end", "left_semi")
        grown = front.join(hops, F.col("end") == F.col("_from"))
        if mode == TRAIL:
            grown = grown.where(~F.arrays_overlap("rels", F.col("_rel")))
        elif mode == ACYCLIC:
            grown = grown.where(~F.array_contains("nodes", F.col("_to")))
        elif mode == SIMPLE:  # a path that has come back to its start is over
            grown = grown.where((F.col("depth") == 0) | (F.col("end") != F.col("start"))).where(~F.array_contains(F.slice("nodes", 2, SAFETY + 1), F.col("_to")))
        front = grown.select("start", F.col("_to").alias("end"), F.lit(depth).alias("depth"), F.concat("rels", F.col("_rel")).alias("rels"), F.concat("nodes", F.array("_to")).alias("nodes"))
        if until is not None:
            front = until(front, depth)
        if high is None or high > 4 or until is not None:
            front = durable(front, "paths")
            if front.isEmpty():
                break
        if depth >= low:
            found.append(front)
    return reduce(DataFrame.unionByName, found) if found else front


def path_ends(rels: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, end, depth) of all trails of one hop or more, for callers that need no list of what lies on them.

    Where no relationship leads to a start and no two lead to one node, a node's trail is the one way back from it. Ways
    back then double in length from round to round, so rounds are logarithmic in the longest trail, a round moves a few
    numbers a node, and no length is too long. Any other graph is searched by var_length.
    """
    before = durable(rels.select(F.col("dst").alias("end"), F.col("src").alias("up"), F.lit(1).alias("depth")), "before")
    starts = durable(starts.select("start"), "starts")
    forked = before.groupBy("end").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entered = starts.join(before.select(F.col("end").alias("start")), "start", "left_semi")
    if not forked.isEmpty() or not entered.isEmpty():
        return var_length(rels, starts, 1, None).select("start", "end", "depth")
    n, way, front, done = before.count(), 1, before, []
    while way <= n:  # a longer way back runs in a circle, which no start leads to
        # An open row's way back is `way` hops long. It goes on by that of the node it has come to, if that has any.
        known = reduce(DataFrame.unionByName, [front, *done]).select(F.col("end").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        grown = front.join(known, "up", "left").select("end", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        way *= 2
        step = durable(grown, "ways")
        done.append(step.where(F.col("depth") < way))
        front = step.where(F.col("depth") == way)
        if front.isEmpty():
            break
    ways = reduce(DataFrame.unionByName, done, before.where("false"))
    return ways.join(starts.withColumnRenamed("start", "up"), "up").select(F.col("up").alias("start"), "end", "depth")


def _levels(hops: DataFrame, starts: DataFrame, high: int | None) -> list[DataFrame]:
    """Breadth-first levels (start, node, depth), level 0 being the starts; each node is in its first level only."""
    levels = [starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()]
    while high is None or len(levels) <= high:
        if len(levels) > SAFETY:
            raise GraphError(f"distances over {SAFETY}: give an upper bound")
        step = levels[-1].join(hops, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        # Levels are tables of their own; none is written twice.
        step = step.join(reduce(DataFrame.unionByName, levels).select("start", "node"), ["start", "node"], "left_anti")
        front = durable(step.withColumn("depth", F.lit(len(levels))), "front")
        if front.isEmpty():
            break
        levels.append(front)
    return levels


def k_hop(rels: DataFrame, starts: DataFrame, low: int = 1, high: int | None = None, direction: str = OUT) -> DataFrame:
    """(start, node, depth): every other node at breadth-first distance low to high from each start, once."""
    hops = durable(_hops(rels.select("src", "dst"), direction).select("_from", "_to").distinct(), "hops")
    seen = reduce(DataFrame.unionByName, _levels(hops, starts, high))
    return seen.where((F.col("depth") >= max(low, 1)) & (F.col("node") != F.col("start")))


def k_hop_counts(rels: DataFrame, starts: DataFrame, high: int, direction: str = OUT) -> DataFrame:
    """(depth, n): nodes per level over all starts."""
    return k_hop(rels, starts, 1, high, direction).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def walk_counts(rels: DataFrame, starts: DataFrame, hops: int, direction: str = OUT) -> DataFrame:
    """(start, n): number of walks of exactly `hops` hops, by propagating counts instead of listing walks."""
    step = durable(_hops(rels.select("src", "dst"), direction).groupBy("_from", "_to").agg(F.count(F.lit(1)).alias("_m")), "hops")
    # Counts flow backwards: n(u) = sum over hops u -> v of n(v).
    n = None
    for _ in range(hops):
        if n is None:
            n = step.groupBy("_from").agg(F.sum("_m").alias("n"))
        else:
            n = step.join(n.select(F.col("_from").alias("_to"), "n"), "_to").groupBy("_from").agg(F.sum(F.col("_m") * F.col("n")).alias("n"))
    return starts.join(n, F.col("start") == F.col("_from"), "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))


def distances(rels: DataFrame, pairs: DataFrame, low: int = 1, high: int = SHORTEST_HOPS, direction: str = OUT) -> DataFrame:
    """(start, end, length) of the shortest path of each pair (columns start, end) that has one of low to high hops.

    A pair of a node with itself has length 0 if low is 0, or else the length of its shortest cycle.
    """
    hops = durable(_hops(rels.select("src", "dst"), direction).select("_from", "_to").distinct(), "hops")
    return _distances(hops, pairs, low, high)


def _distances(hops: DataFrame, pairs: DataFrame, low: int, high: int) -> DataFrame:
    levels = _levels(hops, pairs.select("start").distinct(), high)
    seen = reduce(DataFrame.unionByName, levels).select("start", F.col("node").alias("end"), F.col("depth").alias("length"))
    if low > 0:  # the shortest cycle of a start ends with a hop from one of the nodes it reaches
        loops = seen.join(hops.select(F.col("_from").alias("end"), "_to"), "end").where("_to = start").groupBy("start").agg(F.min(F.col("length") + 1).alias("length")).where(F.col("length") <= high)
        seen = seen.where("start <> end").unionByName(loops.select("start", F.col("start").alias("end"), "length"))
    return pairs.join(seen, ["start", "end"]).where(F.col("length") >= low)


def shortest(rels: DataFrame, pairs: DataFrame, select: str = "all", k: int = 1, low: int = 1, high: int = SHORTEST_HOPS, direction: str = OUT) -> DataFrame:
    """(start, end, length, rels, nodes) of shortest trails.

    select: 'any' one per pair (the smallest by relationship ids), 'all' every one of least length, 'k' the k shortest
    (ties by ids), 'groups' all of the k least lengths. 'any' and 'all' follow only relationships that lie on shortest
    paths. 'k' and 'groups' grow trails level by level, only towards ends that still lack results and that can be
    reached in the hops left, and stop when no pair lacks any.
    """
    rels = _stored(rels, "id")
    hops = durable(_hops(rels, direction).select("_from", "_to").distinct(), "hops")
    back = hops.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
    far = durable(_distances(hops, pairs, low, high), "distances")
    # What a partial path still needs to reach an end, by backward search from the ends.
    ahead = durable(reduce(DataFrame.unionByName, _levels(back, far.select(F.col("end").alias("start")).distinct(), high)).select(F.col("start").alias("end"), F.col("node").alias("_at"), F.col("depth").alias("_left")), "ahead")
    if select in ("k", "groups"):
        return _shortest_k(rels, far, ahead, select, k, low, high, direction)
    steps = _hops(rels, direction).select("_from", "_to", F.col("id").alias("_rel"))
    front = far.select("start", "end", "length", F.col("start").alias("_at"), F.array().cast("array<bigint>").alias("rels"), F.array("start").alias("nodes"))
    done = front.where("length = 0")
    longest = far.agg(F.max("length")).first()[0] or 0
    for depth in range(1, longest + 1):
        grown = front.where(F.col("length") >= depth).join(steps, F.col("_at") == F.col("_from")).drop("_at").withColumnRenamed("_to", "_at")
        # Keep a partial path only while its remaining hops can still reach the end in time.
        grown = grown.join(ahead, ["end", "_at"]).where(F.col("_left") <= F.col("length") - depth)
        front = durable(grown.select("start", "end", "length", "_at", F.concat("rels", F.array("_rel")).alias("rels"), F.concat("nodes", F.array("_at")).alias("nodes")), "shortest")
        done = done.unionByName(front.where(F.col("length") == depth))
    done = done.drop("_at")
    if select == "any":
        done = done.withColumn("_r", F.row_number().over(Window.partitionBy("start", "end").orderBy("rels"))).where("_r = 1").drop("_r")
    return done


def _shortest_k(rels: DataFrame, far: DataFrame, ahead: DataFrame, select: str, k: int, low: int, high: int, direction: str) -> DataFrame:
    lacking = far.select("start", "end", F.lit(0).alias("have"))
    found: list[DataFrame] = []

    def until(front: DataFrame, depth: int) -> DataFrame:
        nonlocal lacking
        front = durable(front, "trails")
        if depth >= low:
            here = front.join(lacking, ["start", "end"]).withColumnRenamed("depth", "length").drop("have")
            found.append(here)
            got = here.groupBy("start", "end").agg((F.count(F.lit(1)) if select == "k" else F.lit(1)).cast("int").alias("new"))
            lacking = durable(lacking.join(got, ["start", "end"], "left").select("start", "end", (F.col("have") + F.coalesce("new", F.lit(0))).alias("have")).where(F.col("have") < k), "lacking")
        # A trail grows while some end that lacks results can be reached from it, by a walk at least. An end reached
        # already is reached again by way of a cycle, so its own distance is no bound.
        open_ends = lacking.join(ahead, "end").where(F.col("_left") <= high - depth).select("start", F.col("_at").alias("end")).distinct()
        return front.join(open_ends, ["start", "end"], "left_semi")

    if low == 0:
        none = far.where("length = 0").select("start", "end", "length", F.array().cast("array<bigint>").alias("rels"), F.array("start").alias("nodes"))
        found.append(none)
        lacking = durable(lacking.join(none.select("start", "end", F.lit(1).alias("new")), ["start", "end"], "left").select("start", "end", (F.col("have") + F.coalesce("new", F.lit(0))).alias("have")).where(F.col("have") < k), "lacking")
    var_length(rels, far.select("start").distinct(), 1, high, TRAIL, direction, until=until)
    trails = reduce(DataFrame.unionByName, found)
    rank = F.dense_rank().over(Window.partitionBy("start", "end").orderBy("length")) if select == "groups" else F.row_number().over(Window.partitionBy("start", "end").orderBy("length", "rels"))
    return trails.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def cheapest(rels: DataFrame, starts: DataFrame, cost: Column | None = None, direction: str = OUT, max_rounds: int = SAFETY) -> DataFrame:
    """(start, end, cost) of the cheapest path from each start to each node it reaches; costs must not be negative.

    Each round relaxes the relationships of nodes that got cheaper in the round before, with a map-side minimum.
    """
    hops = durable(_hops(rels.select("src", "dst", _price(rels, cost).alias("_cost")), direction).groupBy("_from", "_to").agg(F.min("_cost").alias("_cost")), "hops")
    best = front = durable(starts.select("start", F.col("start").alias("end"), F.lit(0.0).alias("cost")).distinct(), "best")
    for _ in range(max_rounds):
        offer = front.join(hops, F.col("end") == F.col("_from")).select("start", F.col("_to").alias("end"), (F.col("cost") + F.col("_cost")).alias("cost")).groupBy("start", "end").agg(F.min("cost").alias("offer"))
        front = durable(offer.join(best, ["start", "end"], "left").where(F.col("cost").isNull() | (F.col("offer") < F.col("cost") - 1e-12)).select("start", "end", F.col("offer").alias("cost")), "front")
        if front.isEmpty():
            return best
        best = durable(best.unionByName(front).groupBy("start", "end").agg(F.min("cost").alias("cost")), "best")
    raise GraphError(f"costs still fall after {max_rounds} rounds")


def farthest(rels: DataFrame, starts: DataFrame, cost: Column | None = None) -> DataFrame:
    """(start, n, far): how many other nodes each start reaches, if any, and the highest of their cheapest costs, for
    callers that need no list of them.

    Where no node has two ways on and none runs in a circle, what a start reaches lies on one way. Ways then double in
    length from round to round and carry their hops, their cost and the highest cost on them, so rounds are logarithmic
    in the longest way, no pair is listed and no length is too long; a cost may be negative there, and after a null one
    costs are unknown and leave `far` as it was. Any other graph is searched by cheapest.
    """
    starts = starts.select("start").distinct()
    price = _price(rels, cost)
    step = durable(rels.where("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("n"), price.alias("cost"), price.alias("far")), "hops")
    forked = step.groupBy("start").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    single, most, way, done = forked.isEmpty(), step.count(), 1, []
    while single:
        front = step.where(F.col("n") == way)  # open rows: their way is `way` hops long
        if front.isEmpty():
            break
        if way > most:  # it comes back to a node that it has left
            single = False
            break
        # A way goes on by that of the node it has come to, if that has any.
        known = reduce(DataFrame.unionByName, [step, *done]).select(F.col("start").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("cost").alias("_cost"), F.col("far").alias("_far"))
        grown = front.join(known, "to", "left").select(
            "start", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.when(F.col("_n").isNull(), F.col("cost")).otherwise(F.col("cost") + F.col("_cost")).alias("cost"), F.greatest("far", F.col("cost") + F.col("_far")).alias("far"),
        )
        done.append(step.where(F.col("n") < way))
        way *= 2
        step = durable(grown, "ways")
    if not single:
        best = cheapest(rels, starts, cost).where("start <> end")
        return best.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("far"))
    return reduce(DataFrame.unionByName, done, step).join(starts, "start", "left_semi").select("start", "n", "far")


def _price(rels: DataFrame, cost: Column | None) -> Column:
    return (cost if cost is not None else F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in rels.columns else F.lit(1.0)).cast("double")


def cheapest_paths(rels: DataFrame, pairs: DataFrame, select: str = "all", k: int = 1, cost: Column | None = None, direction: str = OUT, max_hops: int | None = None) -> DataFrame:
    """(start, end, cost, rels) of cheapest paths. 'any': one per pair; 'all': all within 1e-9; 'k': the k cheapest
    acyclic paths, of max_hops hops at most if given; ties by hops, then ids."""
    rels = durable(rels.select("id", "src", "dst", _price(rels, cost).alias("_cost")), "priced")
    price = F.col("_cost")
    if select == "k":
        return _cheapest_k(rels, pairs, k, direction, max_hops)
    best = cheapest(rels, pairs.select("start").distinct(), price, direction)
    hops = _hops(rels, direction).select("_from", "_to", F.col("id").alias("_rel"), "_cost")
    # Tight relationships: those on some cheapest path from the start. Walk them backwards from the end.
    front = durable(pairs.join(best, ["start", "end"]).select("start", "end", "cost", F.col("end").alias("_at"), F.array().cast("array<bigint>").alias("rels")), "tight")
    at_cost = best.select("start", F.col("end").alias("_at"), F.col("cost").alias("_here"))
    before = best.select("start", F.col("end").alias("_from"), F.col("cost").alias("_there"))
    done = front.where(F.col("_at") == F.col("start"))
    front = front.where(F.col("_at") != F.col("start"))
    for depth in range(SAFETY + 1):
        grown = front.join(at_cost, ["start", "_at"]).join(hops, F.col("_at") == F.col("_to")).join(before, ["start", "_from"])
        grown = grown.where(F.abs(F.col("_there") + F.col("_cost") - F.col("_here")) < 1e-9).where(~F.array_contains("rels", F.col("_rel")))
        front = durable(grown.select("start", "end", "cost", F.col("_from").alias("_at"), F.concat(F.array("_rel"), "rels").alias("rels")), "tight")
        if front.isEmpty():
            break
        if depth == SAFETY:
            raise GraphError(f"cheapest paths of more than {SAFETY} hops")
        done = done.unionByName(front.where(F.col("_at") == F.col("start")))
        front = front.where(F.col("_at") != F.col("start"))
    done = done.drop("_at")
    if select == "any":
        done = done.withColumn("_r", F.row_number().over(Window.partitionBy("start", "end").orderBy("rels"))).where("_r = 1").drop("_r")
    return done


def _cheapest_k(rels: DataFrame, pairs: DataFrame, k: int, direction: str, max_hops: int | None) -> DataFrame:
    """Acyclic paths within a growing budget per pair, never all of them.

    A pair's budget starts a little over its cheapest cost. A partial path grows while its cost and the cheapest rest of
    the way to some end are within that pair's budget. Pairs with fewer than k paths try again with more slack, until
    they have k or no path of theirs was cut for its cost.
    """
    hops = durable(_hops(rels, direction).select("_from", "_to", F.col("id").alias("_rel"), "_cost"), "hops")
    turned = rels.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "_cost")
    # Cheapest cost from any node to each end.
    rest = cheapest(turned, pairs.select(F.col("end").alias("start")).distinct(), F.col("_cost"), direction)
    rest = durable(rest.select(F.col("start").alias("end"), F.col("end").alias("_at"), F.col("cost").alias("_rest")), "rest")
    todo = durable(pairs.where("start <> end").distinct().join(rest.select("end", F.col("_at").alias("start"), F.col("_rest").alias("best")), ["start", "end"]), "todo")
    done: list[DataFrame] = []
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy("cost", F.size("rels"), "rels"))
    slack, depth_most = 0.25, max_hops or SAFETY
    unit = hops.agg(F.avg("_cost")).first()[0] or 0.0
    while not todo.isEmpty():
        budget = todo.select("start", "end", (F.col("best") * (1 + slack) + slack * unit / 4 + 1e-9).alias("budget"))
        front = budget.select("start", "end", "budget", F.col("start").alias("_at"), F.lit(0.0).alias("cost"), F.array().cast("array<bigint>").alias("rels"), F.array("start").alias("nodes"))
        found, cut = [], []
        for depth in range(1, depth_most + 1):
            grown = front.join(hops, F.col("_at") == F.col("_from")).where(~F.array_contains("nodes", F.col("_to")))
            grown = grown.select("start", "end", "budget", F.col("_to").alias("_at"), (F.col("cost") + F.col("_cost")).alias("cost"), F.concat("rels", F.array("_rel")).alias("rels"), F.concat("nodes", F.array("_to")).alias("nodes"))
            grown = durable(grown.join(rest, ["end", "_at"]), "grown")
            within = F.col("cost") + F.col("_rest") <= F.col("budget")
            cut.append(grown.where(~within).select("start", "end").distinct())
            found.append(grown.where(within & (F.col("_at") == F.col("end"))).select("start", "end", "cost", "rels"))
            front = durable(grown.where(within & (F.col("_at") != F.col("end"))).drop("_rest"), "cheap")
            if front.isEmpty():
                break
            if max_hops is None and depth == depth_most:
                raise GraphError(f"cheapest paths of more than {SAFETY} hops")
        paths = durable(reduce(DataFrame.unionByName, found), "found")
        more = reduce(DataFrame.unionByName, cut).distinct()
        few = budget.join(paths.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n")), ["start", "end"], "left").where(F.coalesce("n", F.lit(0)) < k).join(more, ["start", "end"], "left_semi").select("start", "end")
        few = durable(few, "few")
        done.append(paths.join(few, ["start", "end"], "left_anti"))
        todo = todo.join(few, ["start", "end"], "left_semi")
        slack *= 4
    if not done:
        return pairs.select("start", "end", F.lit(0.0).alias("cost"), F.array().cast("array<bigint>").alias("rels")).where("false")
    return reduce(DataFrame.unionByName, done).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
