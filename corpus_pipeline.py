"""A training corpus from raw documents: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import dart_minhash, exact_dedup, language_id, mixing, packing
from graphloom.llm.common import durable, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or without a text, go."""
    model = language_id.train(docs.where(~language_id.held_out()))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    return language_id.identify(docs, model, keep=[row]).where("lang_pred <> 'und'").select("_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dart_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents repeat once per epoch, one per source is cut at the budget."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of one context length; copies and documents of one source never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Language models, near duplicates and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = durable(kept, f"pipeline-{name}")
            if i:  # what a stage has read is done with, save the input itself
                release(docs)
        docs = kept
    return docs
