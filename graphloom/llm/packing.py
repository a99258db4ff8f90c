"""Conflict-constrained best-fit packing.

Documents are dealt to packing groups of bounded size by a hash, so that hot sources and groups of copies spread over
all of them, and each group is packed on its own. Inside a group, pieces come by falling size; bins stand in lists by
residual space and carry bitmaps of the sources and duplicate clusters that they hold. The search starts at the
smallest residual that fits and goes on to the next larger until a compatible bin is found; if none is, a bin opens.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, n_words, squeezed

#: Words a bin holds, and documents per packing group.
CAPACITY, GROUP = 2_048, 4_096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the given order; sources and clusters are bit positions, -1 for none."""
    by_residual: dict[int, list[int]] = {}
    filled = 0  # bit r is set if some bin has residual r
    residual: list[int] = []
    held: list[tuple[int, int]] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        s_bit, c_bit = (1 << s) if s >= 0 else 0, (1 << c) if c >= 0 else 0
        up, found = (filled >> size) << size, -1
        while up and found < 0:
            r = (up & -up).bit_length() - 1
            for b in by_residual[r]:
                if not (held[b][0] & s_bit or held[b][1] & c_bit):
                    found = b
                    break
            up &= up - 1
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            held.append((0, 0))
        else:
            r = residual[found]
            by_residual[r].remove(found)
            if not by_residual[r]:
                filled &= ~(1 << r)
        out.append((found, capacity - residual[found]))
        r = residual[found] = residual[found] - size
        held[found] = (held[found][0] | s_bit, held[found][1] | c_bit)
        by_residual.setdefault(r, []).append(found)
        filled |= 1 << r
    return out


def _packed(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_id", "_c64", "_piece"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        blank = (pdf["_size"] == 0).to_numpy()  # without words there is nothing to conflict
        source = pd.factorize(pdf["_source"], use_na_sentinel=False)[0]
        source = source.astype(int)
        source[blank] = -1
        source = source.tolist()
        copies = pdf["_c64"].duplicated(keep=False) & ~blank
        cluster = pd.Series(-1, index=pdf.index)
        cluster[copies] = pd.factorize(pdf.loc[copies, "_c64"])[0]
        at = best_fit(pdf["_size"].tolist(), source, cluster.tolist(), capacity)
        pdf["bin_id"] = [(int(g) << 24) + b for g, (b, _) in zip(pdf["_group"], at, strict=True)]
        pdf["bin_offset"] = [o for _, o in at]
        return pdf

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, cluster: Column | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, source, cluster, bin_id, bin_offset.

    A document of more than `capacity` words is cut into full pieces, which fill a bin each, and a rest. No bin
    exceeds the capacity or holds two pieces of one source or of one duplicate cluster (by default, equal texts without
    white space). Null and empty texts give one piece of 0 words, which any bin may hold; a null source is a source; null ids and repeated rows are packed like others. An empty table gives an empty result. Sizes are
    words unless a column is given, and other columns are ignored.
    """
    words = F.coalesce(n_words(text_col) if size is None else size, F.lit(0)).cast("long")
    c64 = F.xxhash64(squeezed(text_col)) if cluster is None else F.xxhash64(cluster)
    slim = durable(docs.select(F.col(id_col).alias("_id"), words.alias("_n"), F.col(source_col).cast("string").alias("_source"), c64.alias("_c64")), "sizes")
    n_pieces = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("long")
    total = slim.agg(F.sum(n_pieces)).first()[0] or 0
    pieces = slim.select("*", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("_piece"))
    pieces = pieces.withColumn("_size", F.least(F.lit(capacity), F.col("_n") - F.col("_piece") * capacity).cast("int"))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "_c64", "_piece"), F.lit(max(1, math.ceil(total / group)))).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _n long, _source string, _c64 long, _piece int, _size int, _group int, bin_id long, bin_offset int"
    packed = dealt.groupBy("_group").applyInPandas(_packed(capacity), schema)
    return packed.select(F.col("_id").alias(id_col), F.col("_piece").alias("piece"), (F.col("_piece") * F.lit(capacity).cast("long")).alias("start"), F.col("_size").alias("n_tokens"), F.col("_source").alias("source"), F.col("_c64").alias("cluster"), "bin_id", "bin_offset")
