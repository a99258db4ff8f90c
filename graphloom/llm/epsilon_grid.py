"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are sorted by their grid cells (side epsilon) on the corpus' leading principal axes, label by label.
Cutting the sorted sequence gives blocks; FAN blocks in a row make an interval, FAN intervals a longer one, up to the
whole sequence. The join descends from the whole sequence with itself: a pair of intervals whose bounding boxes come
within epsilon is replaced by the pairs of their parts, any other is dropped with all that it holds. Pairs of blocks
are joined in the same way inside a task, halves instead of parts, down to tiles that one matrix product compares in
double precision. A block pair returns link counts and the spanning links of its local components, so a group of copies
of any size emits rows in proportion to members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, durable

#: Vectors that the principal axes are fitted on, those with the smallest hash of their id; the axes only steer pruning.
SAMPLE = 8_000
#: Vectors per block, axes of the grid order, and the tile at which the recursion compares.
INTERVAL, AXES, TILE = 1_024, 6, 128
#: Bits that number the parts of an interval: FAN = 2**FAN_BITS parts.
FAN_BITS = 4


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, lest squares overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(sample: list, dim: int) -> np.ndarray:
    """dim x dim orthonormal columns by falling variance."""
    x = _unit(np.array(sample, dtype=np.float64)) if sample else np.zeros((0, dim))
    if len(x) < 2:
        return np.eye(dim)
    _, vectors = np.linalg.eigh(np.cov(x.T).reshape(dim, dim))
    return vectors[:, ::-1]


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the bounding boxes of two sets of points come within eps."""
    gap = np.maximum(0, np.maximum(b.min(0) - a.max(0), a.min(0) - b.max(0)))
    return float((gap * gap).sum()) <= eps * eps


def _join(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, at: int, bt: int, same: bool, eps: float, cosine: float, out: list) -> None:
    """Append the positions of vectors of a and b that reach the cosine; pa and pb are their places on the axes."""
    if not _near(pa, pb, eps):
        return
    if len(a) <= TILE and len(b) <= TILE:
        hit = a @ b.T >= cosine
        i, j = np.nonzero(np.triu(hit, 1) if same else hit)
        if len(i):
            out.append((i + at, j + bt))
        return
    h, k = -(-len(a) // 2), -(-len(b) // 2)
    if same:
        _join(a[:h], a[:h], pa[:h], pa[:h], at, at, True, eps, cosine, out)
        _join(a[:h], a[h:], pa[:h], pa[h:], at, at + h, False, eps, cosine, out)
        _join(a[h:], a[h:], pa[h:], pa[h:], at + h, at + h, True, eps, cosine, out)
        return
    for x, px, xt in ((a[:h], pa[:h], at), (a[h:], pa[h:], at + h)):
        for y, py, yt in ((b[:k], pb[:k], bt), (b[k:], pb[k:], bt + k)):
            if len(x) and len(y):
                _join(x, y, px, py, xt, yt, False, eps, cosine, out)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each vertex's component, by repeated minimum and pointer jumping."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        for x in (i, j, lab[i], lab[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def similar_vectors(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null (any rows if label_col is None) and their vectors have the same
    length and a cosine of at least `cosine` in double precision. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing. Equal vectors are compared once and count for each of their rows; rows
    that repeat an id count as vectors of their own. An empty table gives an empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    label = F.col(label_col) if label_col else F.lit(0)
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(label.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.when(usable, label).alias("_label"), F.when(usable, v).alias("_v"))
    classes = durable(rows.where("_v IS NOT NULL").groupBy("_label", "_v").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "classes")

    picked = classes.select("_v", F.size("_v").alias("dim"), F.xxhash64("least").alias("h")).orderBy("h").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r["_v"])
    axes = {d: _axes(x, d) for d, x in by_dim.items()}

    def gridded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["_v"].map(len)):
                x = _unit(_matrix(part["_v"], dim))
                p = np.ascontiguousarray((x @ axes[dim] if dim in axes else x)[:, :AXES])
                cells = np.floor(p / max(eps, 0.05)).astype(np.int64)
                yield pd.DataFrame({"_label": part["_label"].to_numpy(), "dim": dim, "cells": list(cells), "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "p": [r.tobytes() for r in p], "x": [r.tobytes() for r in x]})

    label_type = classes.schema["_label"].dataType.simpleString()
    grid = classes.mapInPandas(gridded, f"_label {label_type}, dim int, cells array<long>, rep long, copies long, p binary, x binary")
    n_rows = classes.count()
    n_parts = max(1, math.ceil(n_rows / (INTERVAL * 16)))
    order = ["_label", "dim", "cells", "rep"]

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cut the sorted rows of a partition into blocks of one label and dimension, numbered in their order."""
        held: pd.DataFrame | None = None
        part_id, n = TaskContext.get().partitionId(), count()

        def emit(part: pd.DataFrame) -> pd.DataFrame:
            p = np.frombuffer(b"".join(part["p"]), dtype=np.float64).reshape(len(part), -1)
            low, high = p.min(0), p.max(0)
            box = {f"{e}{i}": [v[i] if i < len(v) else 0.0] for e, v in (("lo", low), ("hi", high)) for i in range(AXES)}
            return pd.DataFrame({"part": [part_id], "n": [next(n)], "_label": [part["_label"].iloc[0]], "dim": [int(part["dim"].iloc[0])], **box, "reps": [part["rep"].to_numpy()], "copies": [part["copies"].to_numpy()], "p": [p.tobytes()], "x": [b"".join(part["x"])]})

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            groups = [g for _, g in held.groupby(["_label", "dim"], sort=False)]
            for i, g in enumerate(groups):
                done = len(g) if i < len(groups) - 1 else len(g) // INTERVAL * INTERVAL
                for at in range(0, done, INTERVAL):
                    yield emit(g.iloc[at : min(at + INTERVAL, done)])
                held = g.iloc[done:]
            if held is not None and not len(held):
                held = None
        if held is not None:
            for at in range(0, len(held), INTERVAL):
                yield emit(held.iloc[at : at + INTERVAL])

    ends = [f"{e}{i}" for e in ("lo", "hi") for i in range(AXES)]
    schema = f"part long, n long, _label {label_type}, dim int, {', '.join(f'{e} double' for e in ends)}, reps array<long>, copies array<long>, p binary, x binary"
    blocks = durable(grid.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInPandas(intervals, schema), "blocks")

    # A block's place in the sequence: partitions are ranges in order, and their blocks are numbered.
    most = blocks.agg(F.max("n").alias("n"), F.max("part").alias("part"), F.count(F.lit(1)).alias("blocks")).first()
    n_blocks, per_part = most["blocks"], int(most["n"] or 0) + 1
    seq = F.col("part") * per_part + F.col("n")
    meta = blocks.select("_label", "dim", seq.alias("at"), *ends)
    levels = max(1, -(-((int(most["part"] or 0) + 1) * per_part - 1).bit_length() // FAN_BITS))

    def level(i: int) -> DataFrame:
        """The intervals of FAN**i blocks with their bounding boxes."""
        box = [(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in ends]
        return meta if i == 0 else meta.groupBy("_label", "dim", F.shiftright("at", FAN_BITS * i).alias("at")).agg(*box)

    pairs = level(levels).select("_label", "dim", F.col("at").alias("p"), F.col("at").alias("q"))
    for i in reversed(range(levels)):
        parts = level(i).withColumn("above", F.shiftright("at", FAN_BITS))
        left, right = (parts.select("_label", "dim", F.col("above").alias(c), F.col("at").alias(f"at_{c}"), *[F.col(e).alias(f"{e}_{c}") for e in ends]) for c in "pq")
        gap = [F.greatest(F.col(f"lo{k}_q") - F.col(f"hi{k}_p"), F.col(f"lo{k}_p") - F.col(f"hi{k}_q"), F.lit(0.0)) for k in range(AXES)]
        met = pairs.join(left, ["_label", "dim", "p"]).join(right, ["_label", "dim", "q"])
        pairs = met.where("at_p <= at_q").where(sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= eps * eps).select("_label", "dim", F.col("at_p").alias("p"), F.col("at_q").alias("q"))
    body = blocks.select("_label", "dim", seq.alias("at"), "reps", "copies", "p", "x")
    one = body.select("_label", "dim", F.col("at").alias("p"), F.col("reps").alias("reps_p"), F.col("copies").alias("copies_p"), F.col("p").alias("p_p"), F.col("x").alias("x_p"))
    two = body.select("_label", "dim", F.col("at").alias("q"), F.col("reps").alias("reps_q"), F.col("copies").alias("copies_q"), F.col("p").alias("p_q"), F.col("x").alias("x_q"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = r.p == r.q
                a, b = (np.frombuffer(x, dtype=np.float64).reshape(-1, r.dim) for x in (r.x_p, r.x_q))
                pa, pb = (np.frombuffer(x, dtype=np.float64).reshape(len(y), -1) for x, y in ((r.p_p, a), (r.p_q, b)))
                found: list = []
                _join(a, b, pa, pb, 0, 0, same, eps, cosine, found)
                if not found:
                    continue
                i, j = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                j = j if same else j + len(a)
                reps = r.reps_p if same else np.concatenate((r.reps_p, r.reps_q))
                copies = r.copies_p if same else np.concatenate((r.copies_p, r.copies_q))
                n = np.bincount(i, weights=copies[j], minlength=len(reps)) + np.bincount(j, weights=copies[i], minlength=len(reps))
                at = np.flatnonzero(n)
                yield pd.DataFrame({"rep": reps[at], "links": n[at].astype(np.int64), "root": reps[_labels(len(reps), i, j)[at]]})

    joined = pairs.join(one, ["_label", "dim", "p"]).join(two, ["_label", "dim", "q"])
    found = durable(joined.repartition(max(12, n_blocks // 4), "p", "q").mapInPandas(compared, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    merged = merged.join(classes.select("rep", "least"), "rep")
    smallest = merged.groupBy("component").agg(F.min("least").alias("smallest"))
    merged = merged.join(smallest, "component").select("rep", "smallest")
    known = classes.join(links, "rep", "left").join(merged, "rep", "left").select("_label", "_v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    # Rows that link with nothing stay out of the join, where their null keys would meet in one task.
    found = rows.where("_v IS NOT NULL").join(known, ["_label", "_v"]).select("_id", "n_links", "component_id")
    out = found.unionByName(rows.where("_v IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True)).alias("kept"))
