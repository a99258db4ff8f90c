"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut at each source's budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, n_words, text_or_empty

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Rows that one prefix-sum bucket should hold.
BUCKET_ROWS = 250_000
#: Rows of offsets (about 100 bytes each) up to which they are broadcast.
BROADCAST_STARTS = 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    The targets share `share` times all sizes by weight; what a source cannot take (over `most` times its size) is
    reshared by weight among the others until none is above: water-filling, solved in closed form with sources in the
    order in which they fill up. Windows run over one row per source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # A source is full at the water level cap / w; all those with a lower level are full before it.
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    past, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    # The water level is that of the first source that does not fill up.
    s = s.withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("l")))).over(everything)["l"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("water")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, **law) -> DataFrame:
    """The input's columns with `_size`, `_source_size`, `_target`, `_taken`: the words the mix takes of each row. Columns
    of the input with these names are replaced, all others stay.

    Rows of a source stand in the order of md5(id); a source's budget (its target, rounded) buys whole epochs and then
    the words up to the exact cut, so that one row at most per source is taken in part and the sum is the budget. Null
    sources are a source of their own; null texts have size 0 and are never taken; equal ids are ordered by size.
    A source may hold any share of the rows: prefix sums run over buckets of its order, never over a whole source. An
    empty table gives an empty result.
    """
    named = ("_size", "_source_size", "_target", "_taken")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c.lower() not in named]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_from"),
        (n_words(text_col) if size is None else size.cast("long")).alias("_size"),
        key.alias("_key"),
    )
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16))) if n > BUCKET_ROWS else 1
    rows = rows.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = rows.groupBy(F.col("_from").alias("source"), "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), **law)
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("_source"), F.col("_bucket").alias("_b"), "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    inside = Window.partitionBy("_from", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_upto", F.sum("_size").over(inside))
    # One row per source and bucket, about rows / BUCKET_ROWS of each; broadcast while they are few, so that texts that
    # the window has dealt out stay where they are.
    starts = durable(starts, "starts")
    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    placed = summed.join(starts, (F.col("_bucket") == F.col("_b")) & F.col("_from").eqNullSafe(F.col("_source")))
    budget = F.round("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("_source_size")
    ahead = F.col("_start") + F.col("_upto") - F.col("_size")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest - ahead))
    return placed.select("_row.*", "_size", "_source_size", "_target", taken.cast("long").alias("_taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken. Texts stay out of the shuffle."""
    slim = docs.select("doc_id", "source", n_words("text").alias("_n"))
    out = mix(slim, size=F.col("_n"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of the input: a row per epoch, the row at the cut holding its first words only."""
    # The words taken stand on the row itself: ids may be null, or shared by several texts.
    rows = docs.select("doc_id", "source", n_words("text").alias("_n"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    full = mix(rows, size=F.col("_n")).where("_taken > 0").select("_doc", "_size", "_taken", F.col("_doc")["text"].alias("_body"))
    epochs = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    copies = full.withColumn("_epoch", F.explode(F.sequence(F.lit(1), epochs)))
    left = F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size")
    first_words = F.array_join(F.slice(F.regexp_extract_all("_body", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(left, F.lit(1)).cast("int")), "")
    cut = copies.select("_doc", F.when(left < F.col("_size"), first_words).otherwise(F.col("_body")).alias("_body"))
    new = {"text": F.col("_body")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_body").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
