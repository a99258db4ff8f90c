"""Token counts through a digest cache.

A cache row is (content digest, tokenizer digest, count). A call joins its distinct content digests to the rows of its
tokenizer, encodes one text per missing digest, appends the new counts to the cache, and joins counts back to rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, scratch_dir, text_or_empty

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Texts that a library call encodes at once.
CALL = 256


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, CALL):
                counts += encode(batch.column("_text")[at : at + CALL].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _cached(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    # Two writers may have appended the same digest; their counts are equal.
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens of the whole text, without begin, end or added special tokens.

    Null counts as empty: 0 bytes, 0 tokens. Equal texts are encoded once. `cache` names a Parquet folder in storage
    that all executors share; without it the call keeps a cache of its own below spark.checkpoint.dir. Null and
    repeated ids are counted like others; other columns are ignored; an empty table gives an empty result.
    """
    cache = cache or f"{scratch_dir(docs.sparkSession)}/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer_path)
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    # One row per distinct content; its smallest id stands for it.
    distinct = keyed.groupBy("digest").agg(F.min("_id").alias("_one"))
    known = _cached(docs, cache, version)
    missing = distinct if known is None else distinct.join(known, "digest", "left_anti")
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    wanted = missing.select(F.col("digest").alias("_d"), "_one")
    todo = texts.join(wanted, (F.col("digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_one")), "left_semi").select("digest", "_text")
    new = todo.mapInArrow(_encoded(tokenizer_path), "digest binary, n_tokens long")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # A table of its own, so that the join may split a digest that a third of all rows share.
    counts = durable(_cached(docs, cache, version), "counts")
    return keyed.join(counts, "digest", "left").select(F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
