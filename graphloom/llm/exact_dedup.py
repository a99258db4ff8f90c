"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its rows into a sorted run of (digest, best row, count), one row per digest. Runs are then
exchanged in rounds of a binomial tree of radix k: before round r a run owns the digests whose first r digits are its
own; in the round, the k runs that differ in their r-th digit only swap slices of the digest space, and each merges the
k sorted slices it gets in one pass, keeping the best row and the sum of the counts. The rounds are as many as digits
tell the runs apart, so their number grows with the logarithm of the partitions. After the last round every digest
lives in exactly one run. A digest that holds a third of all rows costs at most k rows per cell in any round.

A match is verified, not assumed: the merge key is the SHA-256 of the normalised text together with its length and an
independent 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, squeezed, text_or_empty

#: Runs that one merge takes in.
RADIX = 8
KEY = ["_sha", "_len", "_x64"]


def _digested(docs: DataFrame, id_col: str, text_col: str, keep: list) -> DataFrame:
    norm = squeezed(text_col)
    return docs.select(
        *keep,
        F.sha2(norm, 256).alias("_sha"),
        F.char_length(norm).alias("_len"),
        F.xxhash64(norm).alias("_x64"),
        # Ordered so that the maximum is the longest original text, then the smallest id (a null id last).
        F.struct(F.char_length(text_or_empty(text_col)).alias("n"), F.bitwise_not(F.col(id_col).cast("long")).alias("i")).alias("_best"),
    )


def merge_runs(rows: DataFrame, radix: int = RADIX) -> DataFrame:
    """(_sha, _len, _x64, _best, _n), one row per digest, from digested rows."""
    leaves = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(leaves, 2), radix) - 1e-9))
    # The partition decides where a row's digest travels, never what becomes of it, so a task that runs again elsewhere
    # gives the same result.
    runs = rows.select(*KEY, "_best", F.lit(1).cast("long").alias("_n"), F.pmod(F.spark_partition_id(), F.lit(radix**rounds)).alias("_run"))
    digit = lambda r: F.pmod(F.floor(F.pmod("_x64", F.lit(radix**rounds)) / radix**r), F.lit(radix))
    run_digit = lambda r: F.pmod(F.floor(F.col("_run") / radix**r), F.lit(radix))
    cells = [f"_c{i}" for i in range(rounds)]
    for r in range(rounds):
        # A run's address after this round: its digits up to r are those of the digests it owns.
        cell = [digit(i) if i <= r else run_digit(i) for i in range(rounds)]
        named = runs.withColumns({f"_c{i}": c.cast("int") for i, c in enumerate(cell)})
        # Sorted slices: a run leaves its partition with one row per digest, in order (partial aggregation), and the
        # cell's slices are merged by digest.
        merged = named.groupBy(*cells, *KEY).agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
        runs = merged.select(*KEY, "_best", "_n", sum(F.col(f"_c{i}") * radix**i for i in range(rounds)).alias("_run"))
    return runs.drop("_run")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; null counts as empty, so nulls, empty and blank texts
    form one group. The row with the most code points stays, then the smallest id; a null id loses to any other. Fully
    repeated rows (same id and length) tie and are all marked kept; `deduplicate` leaves one of them. An empty table
    gives an empty report. Columns other than the two named are ignored, whatever their names.
    """
    rows = durable(_digested(docs, id_col, text_col, [F.col(id_col).alias("_id")]), "digests")  # texts are read once
    groups = merge_runs(rows, radix).where("_n > 1").withColumnRenamed("_best", "_top")
    joined = rows.join(groups, KEY, "left")
    top = F.coalesce("_top", "_best")
    return joined.select(
        F.col("_id").alias(id_col),
        F.bitwise_not(top["i"]).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_best").eqNullSafe(top).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """The input's rows and columns with one row per group of equal texts, chosen as in duplicate_report; of fully
    repeated rows one stays. Rows that lose go before the one shuffle of texts where their group makes up a thousandth
    of all grouped rows, so no task gets a hot group."""
    slim = _digested(docs, id_col, text_col, [])
    groups = durable(merge_runs(slim, radix).where("_n > 1").select(*KEY, F.col("_best").alias("_top"), "_n"), "groups")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("_n") * 1000 >= total).drop("_n"))  # a thousand rows at most
    rest = groups.where(F.col("_n") * 1000 < total).drop("_n")
    full = _digested(docs, id_col, text_col, [F.struct(*[docs[c] for c in docs.columns]).alias("_row")])
    stays = F.col("_top").isNull() | F.col("_best").eqNullSafe(F.col("_top"))
    full = full.join(hot, KEY, "left").where(stays).drop("_top")
    return full.join(rest, KEY, "left").where(stays).drop("_top").dropDuplicates(KEY).select("_row.*")
