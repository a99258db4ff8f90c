"""Sharding by sampled splitters, law `bytes`: shards of near-equal size, from DataFrame operations only.

A size-weighted sample of sort keys gives quantile boundaries; records are range-partitioned by them; ranges that turn
out overfull are subdivided at the finer quantiles of the same sample. Exact range totals and a running sum inside
each (now small) range place every record on one global byte axis, which is cut into equal shards. Sample and
boundaries are tables, never collected: a record finds its range by joining them on a prefix of its key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable

#: Records a range should hold, so that a window over one range fits a task.
RANGE_ROWS = 500_000
#: Sampled keys per range; the sample holds about this many per range, whatever the corpus' size.
SAMPLES_PER_RANGE = 24
#: Boundaries up to which the tables of boundaries are broadcast (about 100 bytes each); beyond, they are shuffled.
BROADCAST_BOUNDS = 50_000


def _digits(n) -> int:
    """Hexadecimal digits that tell n things apart."""
    return max(1, math.ceil(math.log(max(n, 2), 16)))


def _with_range(rows: DataFrame, bounds: DataFrame, name: str = "_range") -> DataFrame:
    """`rows` (columns k, t: hexadecimal digests) with the number of boundaries (k, t) that are <= (k, t).

    The boundaries of a prefix of k are one row; those of one k (a hot text's) are told apart by prefixes of t as long
    as their number needs. So a record sees a handful of boundaries, however many there are and wherever they lie.
    """
    m = bounds.count()
    near = F.broadcast if m <= BROADCAST_BOUNDS else (lambda df: df)
    d = _digits(m)
    per_k = bounds.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    per_k = per_k.withColumn("d", F.greatest(F.lit(1), F.ceil(F.log(F.col("n").cast("double")) / math.log(16)).cast("int")))
    prefixes = rows.sparkSession.range(16**d).select(F.lower(F.lpad(F.hex("id"), d, "0")).alias("p"))
    by_prefix = per_k.groupBy(F.substring("k", 1, d).alias("p")).agg(F.collect_list(F.struct("k", "n", "d")).alias("ks"), F.sum("n").alias("here"))
    # A row per prefix, 16 times the boundaries at most.
    past = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    coarse = prefixes.join(by_prefix, "p", "left").select("p", "ks", F.coalesce(F.sum("here").over(past), F.lit(0)).alias("before"))
    hot = per_k.select("k", "d", F.explode(F.sequence(F.lit(0), F.pow(F.lit(16), F.col("d")).cast("int") - 1)).alias("i"))
    hot = hot.select("k", F.lower(F.lpad(F.hex("i"), F.col("d"), F.lit("0"))).alias("tp"))
    ts = bounds.join(per_k, "k").groupBy("k", F.expr("substring(t, 1, d)").alias("tp")).agg(F.collect_list("t").alias("ts"))
    past_k = Window.partitionBy("k").orderBy("tp").rowsBetween(Window.unboundedPreceding, -1)
    fine = hot.join(ts, ["k", "tp"], "left").select(F.col("k").alias("_hk"), F.col("tp").alias("_htp"), "ts", F.coalesce(F.sum(F.coalesce(F.size("ts"), F.lit(0))).over(past_k), F.lit(0)).alias("before_t"))
    fine = fine.withColumn("ts", F.coalesce("ts", F.array().cast("array<string>")))
    kept = rows.columns
    at = rows.withColumn("_p", F.substring("k", 1, d)).join(near(coarse), F.col("_p") == F.col("p"), "left")
    lower = F.aggregate(F.filter("ks", lambda x: x["k"] < F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    own = F.get(F.filter("ks", lambda x: x["k"] == F.col("k")), 0)
    at = at.select(*kept, (F.coalesce("before", F.lit(0)) + F.coalesce(lower, F.lit(0))).alias("_rank"), own["d"].alias("_d"))
    # Null where no boundary has this k, so that only such records look further.
    at = at.withColumn("_tp", F.when(F.col("_d").isNotNull(), F.expr("substring(t, 1, _d)")))
    at = at.join(near(fine), (F.col("_tp") == F.col("_htp")) & (F.col("k") == F.col("_hk")), "left")
    more = F.coalesce(F.col("before_t") + F.size(F.filter("ts", lambda x: x <= F.col("t"))), F.lit(0))
    return at.select(*kept, (F.col("_rank") + more).cast("long").alias(name))


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Records are ordered by (md5 of the text, md5 of the id, id): copies stay adjacent, and a group of copies of any size
    can still be cut inside. A shard takes the records whose byte midpoint on that axis lies in its n-th part, so shards
    differ by about one record's size. Null texts have size 8 and sort as empty texts; null ids sort first; repeated
    rows each take a place. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts are read once; everything below works on this slim table.
    rows = durable(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 8).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.substring(F.md5(text.cast("binary")), 1, 16).alias("k"),
            F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 16).alias("t"),
        ),
        "keys",
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).first()
    n_rows, n_bytes = total["n"], total["b"] or 0
    n_ranges = max(4, math.ceil(n_rows / RANGE_ROWS), min(96, n_rows // 2000))
    # Exponential races: a record is drawn if -ln(u) / size is below the rate that gives the sample its expected size,
    # so that its chance follows its size.
    u = (F.conv(F.substring("t", 1, 8), 16, 10).cast("double") + 1) / 2**32
    rate = n_ranges * SAMPLES_PER_RANGE / max(n_bytes, 1)
    drawn = rows.where(-F.log(u) / F.col("_size") < rate).select("k", "t").distinct()
    # Numbering runs over the sample, SAMPLES_PER_RANGE keys per RANGE_ROWS records.
    sample = durable(drawn.select("k", "t", (F.row_number().over(Window.orderBy("k", "t")) - 1).alias("r")), "sample")
    half = SAMPLES_PER_RANGE // 2
    bounds = sample.where(F.col("r") % SAMPLES_PER_RANGE == half)
    ranged = durable(_with_range(rows, bounds.select("k", "t")), "ranges")
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_b"))
    full = durable(sums.where((F.col("_b") > 2 * n_bytes / n_ranges) | (F.col("_n") > 2 * RANGE_ROWS)).select("_range"), "overfull")
    if not full.isEmpty():  # subdivide at the sample's finer quantiles
        inside = sample.withColumn("_range", F.floor((F.col("r") + half) / SAMPLES_PER_RANGE)).join(full, "_range", "left_semi").where("r % 4 = 0")
        finer = bounds.select("k", "t").union(inside.select("k", "t")).distinct()
        ranged = durable(_with_range(rows, finer), "ranges")
        sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_b"))

    # Offsets of ranges: one row per range, a number bounded by rows / RANGE_ROWS.
    near = F.broadcast if n_ranges <= BROADCAST_BOUNDS else (lambda df: df)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    order = Window.partitionBy("_range").orderBy("k", "t", "_id", "_size")
    placed = (
        ranged.withColumns({"_rn": F.row_number().over(order), "_cum": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        .join(near(offsets), "_range")
        .select("_id", "_size", "_crc", (F.col("_n0") + F.col("_rn")).alias("_at"), F.least(F.floor((F.col("_b0") + F.col("_cum") - F.col("_size") / 2) * n_shards / max(n_bytes, 1)), F.lit(n_shards - 1)).cast("int").alias("_shard"))
    )
    placed = durable(placed, "placed")
    first = placed.groupBy("_shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").select(  # one row per shard
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_at") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the records as Parquet below path/shard=N, in slot order per file, and return the assignment.

    The files hold the input's columns with `shard` and `slot`, which replace columns of those names. Rows are told
    apart by id and text; rows equal in both are interchangeable and each take one of their slots.
    """
    plan = durable(assign_shards(docs, n_shards, id_col, text_col), "assignment")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    twin = Window.partitionBy("_i", "_c", "_b").orderBy(F.lit(1))
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.col(id_col).alias("_i"), F.crc32(text.cast("binary")).alias("_c"), (F.octet_length(text) + 8).cast("long").alias("_b"))
    # Texts that share a checksum and a size under one id differ so rarely that slots are dealt to them in any order.
    rows = rows.withColumn("_n", F.row_number().over(twin))
    slots = plan.select(F.col(id_col).alias("_j"), F.col("text_crc32").alias("_d"), F.col("size").alias("_e"), "shard", "slot")
    slots = slots.withColumn("_m", F.row_number().over(Window.partitionBy("_j", "_d", "_e").orderBy("shard", "slot")))
    same = F.col("_i").eqNullSafe(F.col("_j")) & (F.col("_c") == F.col("_d")) & (F.col("_b") == F.col("_e")) & (F.col("_n") == F.col("_m"))
    placed = rows.join(slots, same).select("_row.*", "shard", "slot")
    spread = F.floor(F.col("slot") / 50_000)
    placed.repartition(max(n_shards, 24), "shard", spread).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return plan
