"""Language ID by multilingual mixture inference.

Training counts hashed byte trigrams per language over all training rows; each partition sends one row per trigram and
language it has seen. A document is a mixture: each of its words is drawn from one language with the likelihood of its
trigrams, and expectation-maximisation estimates the proportions. Nested language sets (by falling proportion) are
then refitted, and the set of greatest likelihood less a penalty per language is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.ragged import flat, steps, words

#: Trigram buckets, additive smoothing, EM rounds of the full fit and of each refit, penalty per further language.
BUCKETS, SMOOTHING, ROUNDS, REFITS, PENALTY = 1 << 16, 0.05, 10, 4, 3.0

#: Bytes of text that a training task counts at once.
TRAIN_BYTES = 500_000


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts one byte before each byte; the bytes; the offsets of the texts."""
    data, offsets = flat(pc.utf8_lower(texts))
    data = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    x = np.concatenate(([32], data, [32])).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64), data, offsets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("_lang").to_pylist(), dtype=object)
        for a, b in steps(batch.column("_text"), TRAIN_BYTES):
            for lang in set(langs[a:b]):
                part = batch.column("_text")[a:b].filter(pa.array(langs[a:b] == lang))
                bucket, _, _ = _trigrams(part)
                counts[lang] = counts.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their log-likelihood table, BUCKETS x languages; all rows with a text and a language count."""
    slim = rows.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = slim.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    if langs:
        column = np.searchsorted(np.array(langs, dtype=object), np.array(counts.column("lang").to_pylist(), dtype=object))
        table[counts.column("bucket").to_numpy(), column] = counts.column("n").to_numpy()
    table += SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document after some rounds, and each document's log-likelihood (up to each word's own scale)."""
    for _ in range(rounds):
        part = like * share[doc]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.add.reduceat(part, first, axis=0)
        share /= share.sum(axis=1, keepdims=True) + 1e-30
    fit = np.add.reduceat(np.log((like * share[doc]).sum(axis=1) + 1e-30), first)
    return share, fit


def mixtures(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages, texts x languages; a row of zeros where a text has no word with a letter."""
    n_langs = table.shape[1]
    bucket, data, offsets = _trigrams(texts)
    starts, ends, firsts = words(data, offsets)
    out = np.zeros((len(texts), n_langs), dtype=np.float32)
    if not len(starts):
        return out
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    score = np.add.reduceat(table[bucket[: len(data)]], starts, axis=0)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    lettered = np.add.reduceat(letter.astype(np.int32), starts) > 0
    score, doc = score[lettered], doc[lettered]
    if not len(doc):
        return out
    who, first, at = np.unique(doc, return_index=True, return_inverse=True)
    like = np.exp(score - score.max(axis=1, keepdims=True))
    share, _ = _em(like, first, at, np.full((len(who), n_langs), 1 / n_langs, dtype=np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    n = np.diff(np.append(first, len(at)))
    best, best_fit = None, None
    for size in range(1, n_langs + 1):
        mask = np.zeros_like(share)
        np.put_along_axis(mask, order[:, :size], 1, axis=1)
        start = mask * (share + 1e-3)
        fitted, fit = _em(like, first, at, start / start.sum(axis=1, keepdims=True), REFITS if size > 1 else 0)
        fit = fit - PENALTY * (size - 1) * np.log(n + 1.0)
        if best is None:
            best, best_fit = fitted, fit
        else:
            better = fit > best_fit
            best, best_fit = np.where(better[:, None], fitted, best), np.where(better, fit, best_fit)
    out[who] = best
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """`keep` columns (default: all of the input) with lang_pred, score and langs (all chosen languages with shares).
    Columns of the input with these three names are replaced by default.

    Texts that are null, or without a letter, get `und`, score 0 and no languages, as do all texts if nothing was
    learned. Texts are read whole. Repeated rows get equal results.
    """
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    step_bytes = max(100_000, 2_000_000 // max(4, len(langs)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        for batch in batches:
            pred, score, sets = [], [], []
            known = batch.column("_known").to_pylist()
            for a, b in steps(batch.column("_text"), step_bytes):
                share = mixtures(batch.column("_text")[a:b], log_p) if names else np.zeros((b - a, 1))
                top = share.argmax(axis=1)
                for i, row in enumerate(share):
                    if not known[a + i] or row[top[i]] <= 0:
                        pred.append("und"), score.append(0.0), sets.append("")
                        continue
                    pred.append(names[top[i]])
                    score.append(min(1.0, float(row[top[i]])))
                    sets.append(",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0))
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["_kept", "lang_pred", "score", "langs"])

    kept = F.struct(*(keep or [docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score", "langs")]))
    slim = docs.select(kept.alias("_kept"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_known"))
    schema = f"_kept {slim.schema['_kept'].dataType.simpleString()}, lang_pred string, score double, langs string"
    return slim.mapInArrow(predict, schema).select("_kept.*", "lang_pred", "score", "langs")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs; trained on the rows that are not held out."""
    model = train(docs.where(~held_out()))
    return identify(docs, model, keep=[F.col("doc_id"), held_out().alias("held_out")])
