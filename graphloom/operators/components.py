"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.durable import durable, release


def components(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component) of every id in the links, the component being named by its smallest id.

    In each round every vertex moves to whichever of itself and its neighbours has the smallest hash, the hash changing
    from round to round; links are relabelled and loops and repeats dropped. Whatever the graph's shape, a constant
    fraction of the vertices goes each round, so rounds are logarithmic even on long chains. Hubs are pre-aggregated
    by groupBy, only aggregates and equi-joins run, and the driver sees one emptiness flag per round.
    """
    edges = durable(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "links")
    found = edges.selectExpr("explode(array(u, v)) AS id").distinct().select("id", F.col("id").alias("at"))
    used, kept, turn = [edges], None, 0
    while not edges.where("u <> v").isEmpty():
        proper = edges.where("u <> v")
        both = proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("n"))
        step = durable(best.select("u", F.when(rank("n") < rank("u"), F.col("n")).otherwise(F.col("u")).alias("m")), "step")
        new = durable(found.join(step, found["at"] == step["u"], "left").select("id", F.coalesce("m", "at").alias("at")), "components")
        ends = proper.join(step, "u").join(step.select(F.col("u").alias("v"), F.col("m").alias("n")), "v")
        left = durable(ends.select(F.least("m", "n").alias("u"), F.greatest("m", "n").alias("v")).where("u <> v").distinct(), "links")
        release(*used, step, *([] if kept is None else [kept]))
        edges, found, used, kept, turn = left, new, [left], new, turn + 1
    name = found.groupBy("at").agg(F.min("id").alias("component"))
    return found.join(name, "at").select("id", "component")
