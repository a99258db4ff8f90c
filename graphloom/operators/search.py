"""Full-text search: an exploded term table, BM25 in column arithmetic, fuzzy terms by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The usual BM25 constants.
K1, B = 1.2, 0.75
#: Rows a search returns at most (a top-k report).
TOP = 100


def terms(nodes: DataFrame, *properties: str) -> DataFrame:
    """(id, term, tf): lower-cased runs of letters and digits of the given properties."""
    text = F.lower(F.concat_ws(" ", *[F.col(p) for p in properties]))
    words = nodes.select("id", F.explode(F.split(text, r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def search(index: DataFrame, n_docs: DataFrame, query: str, fuzzy: bool = False, limit: int | None = TOP) -> DataFrame:
    """(id, score) of the documents with any of the query's terms, best first, ties by id.

    `index` is a term table, `n_docs` the frame of all documents (column id). Statistics are global. A fuzzy query also
    accepts terms within an edit distance of 2; the nearest term of a document counts for each query term by its own
    frequency.
    """
    wanted = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    size = index.groupBy("id").agg(F.sum("tf").alias("dl"))
    stats = size.agg(F.avg("dl").alias("avgdl")).crossJoin(n_docs.agg(F.count(F.lit(1)).alias("n")))
    if fuzzy:
        near = F.array(*[F.levenshtein(F.col("term"), F.lit(w), 2).between(0, 2) for w in wanted])
        hits = index.where(F.array_contains(near, True))
    else:
        hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = hits.join(df, "term").join(size, "id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = joined.groupBy("id").agg(F.sum(gain).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)
