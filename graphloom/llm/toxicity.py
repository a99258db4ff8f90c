"""Toxicity by noisy-channel deobfuscation: character lattices are decoded under a character model, then scored.

The channel writes letters as look-alikes, repeats them, or puts separators between them. Runs of text that show such
signs become lattices; Viterbi search finds the most probable letters under a trigram model of characters, counted over
the whole corpus. The restored words join the plain ones, and a lexicon learned from labelled rows scores both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable
from graphloom.llm.language_id import held_out
from graphloom.llm.ragged import U, flat, mix64, shingles, steps, word_hashes, words

# Letters that a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Log-probabilities of the channel: a letter replaced, a letter repeated.
REPLACED, REPEATED = -1.5, -1.0
#: Bytes of the prefixes that are features besides whole words.
PREFIXES = (4, 5, 6)
#: Bounds of the fit: labelled rows (smallest hash of the id), smallest support, support at which a feature without
#: clean rows needs no further reason, least precision.
FIT_ROWS, SUPPORT, SIGNIFICANT, PRECISION = 20_000, 3, 6, 0.8
#: Separators between two letters of a spaced word; log-probability under which a double letter is rare.
APART, RARE = 3, -4.5
LETTERS = 27  # a to z, and everything else
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in LOOKALIKES]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data >= 97) & (data <= 122)) | (data >= 128)


def _codes(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 97) & (data <= 122), data.astype(np.int64) - 97, LETTERS - 1)


def _lm_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, dtype=np.int64)
    for batch in batches:
        for a, b in steps(batch.column("_text")):
            data, _ = flat(pc.utf8_lower(batch.column("_text")[a:b]))
            c = _codes(data)
            total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) as a 27 x 27 x 27 array, counted over all texts."""
    slim = docs.select(F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    counts = slim.mapInArrow(_lm_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(LETTERS**3, 0.5)
    table[counts.column("gram").to_numpy()] += counts.column("n").to_numpy()
    table = table.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(table / table.sum(axis=2, keepdims=True))


def decode(text: str, model: np.ndarray) -> str:
    """The most probable letters behind a run of letters and look-alikes; other characters are separators."""
    runs: list[list] = []  # [options, repeats]
    for ch in text:
        options = ch if "a" <= ch <= "z" else LOOKALIKES.get(ch, "")
        if not options:
            continue
        if runs and runs[-1][2] == ch:
            runs[-1][1] += 1
        else:
            runs.append([options, 1, ch])
    out = LETTERS - 1
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(out, out): (0.0, None)}
    for options, n, ch in runs:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in beams.items():
            for o in options:
                c = ord(o) - 97
                s = score + model[a, b, c] + (0.0 if o == ch else REPLACED) + (REPEATED if n > 1 else 0.0)
                for key, t, p in (((b, c), s, (o, path)), *((((c, c), s + model[b, c, c] - (REPEATED if n == 2 else 0.0), (o + o, path)),) if n > 1 else ())):
                    if key not in new or new[key][0] < t:
                        new[key] = (t, p)
        beams = new
    _, path = max(((s + model[a, b, out], p) for (a, b), (s, p) in beams.items()), key=lambda x: x[0])
    parts = []
    while path:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))


def _hash_words(texts: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(texts, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:] - 1)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def rare_doubles(model: np.ndarray) -> np.ndarray:
    """Which bytes are letters that the character model hardly ever doubles; a double of theirs may be a repetition."""
    out = np.zeros(256, dtype=bool)
    for c in range(LETTERS - 1):
        out[97 + c] = np.median(model[: LETTERS - 1, c, c]) < RARE
    return out


def _suspects(data: np.ndarray, doubles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the runs worth decoding, and whether they are letters set apart by separators."""
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    plain = (data >= 97) & (data <= 122)
    following = np.append(plain[1:] | _SYMBOLS[data[1:]], False)
    strict = (data == 33) | (data == 124) | (data == 43)  # ! | + end words too
    ok = plain | (_SYMBOLS[data] & ~strict) | (strict & np.append(plain[1:], False) & following)
    starts, ends = _runs(ok)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    n_plain, n_odd = sums(plain), sums(ok & ~plain)
    triple = np.zeros(len(data), dtype=bool)
    triple[:-2] = plain[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
    triple[:-1] |= doubles[data[:-1]] & (data[:-1] == data[1:])
    n_triple = sums(triple)
    letters, odd = n_plain[ends] - n_plain[starts], n_odd[ends] - n_odd[starts]
    mixed = (letters >= 1) & (odd >= 1) & (ends - starts >= 3) | (n_triple[ends] - n_triple[starts] > 0)
    # Letters set apart: three or more single word characters in a row, with up to APART other characters of any kind
    # (but no line feed) between two of them.
    wordy = plain | _SYMBOLS[data] | (data >= 128)
    alone = (plain | _SYMBOLS[data]) & ~np.append(False, wordy[:-1]) & ~np.append(wordy[1:], False)
    at = np.flatnonzero(alone)
    between = sums(wordy | (data == 10))
    gap = (np.diff(at) > APART + 1) | (between[at[1:]] - between[at[:-1] + 1] > 0)
    first = np.flatnonzero(np.append(True, gap)) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    long = last - first >= 2
    s = np.concatenate((starts[mixed], at[first[long]] if len(at) else first))
    e = np.concatenate((ends[mixed], at[last[long]] + 1 if len(at) else first))
    return s, e, np.concatenate((np.zeros(int(mixed.sum()), bool), np.ones(int(long.sum()), bool)))


def features(texts: pa.Array, model: np.ndarray, seen: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): words and their prefixes, as written and as restored, by 64-bit hash."""
    data, offsets = flat(pc.utf8_lower(texts))
    starts, ends = _runs(_letters(data))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    docs, hashes = [doc], [word_hashes(data, starts, ends)]
    for n in PREFIXES:
        long = ends - starts >= n
        docs.append(doc[long])
        hashes.append(mix64(word_hashes(data, starts[long], starts[long] + n) + U(n)))
    s, e, apart = _suspects(data, rare_doubles(model))
    restored, owner = [], []
    for a, b, split, d in zip(s.tolist(), e.tolist(), apart.tolist(), (np.searchsorted(offsets, s, side="right") - 1).tolist(), strict=True):
        raw = data[a:b].tobytes().decode("ascii", "ignore")
        word = seen.get(raw)
        if word is None:
            word = decode(raw, model)
            if len(seen) < 200_000:
                seen[raw] = word
        if split:  # where a word begins in such a run is not known: take every stretch
            stretches = {word[i : i + n] for n in range(3, 15) for i in range(len(word) - n + 1)}
        else:
            stretches = {word}
        restored += stretches
        owner += [d] * len(stretches)
    if restored:
        docs.append(np.array(owner))
        hashes.append(_hash_words(restored))
        for n in PREFIXES:
            some = [(d, w[:n]) for d, w in zip(owner, restored, strict=True) if len(w) >= n]
            if some:
                docs.append(np.array([d for d, _ in some]))
                hashes.append(mix64(_hash_words([w for _, w in some]) + U(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _families(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash per text that near copies mostly share: the least hash of three words in a row."""
    starts, ends, firsts = words(data, offsets)
    h, doc = shingles(word_hashes(data, starts, ends), firsts, 3)
    out = np.full(len(offsets) - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out, doc, h)
    return out.view(np.int64)


def _featured(shared, wanted=None):
    """mapInArrow function from (_y, _text) to (fam, f) per text: its family and distinct features (those wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        only = None if wanted is None else wanted.value
        for batch in batches:
            for a, b in steps(batch.column("_text")):
                doc, h = features(batch.column("_text")[a:b], model, seen)
                if only is not None:
                    hit = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h if len(only) else np.zeros(len(h), bool)
                    doc, h = doc[hit], h[hit]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
                family = _families(*flat(pc.utf8_lower(batch.column("_text")[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(family), lists], names=["fam", "f"])

    return run


def _cover(incidence: list[list[int]], clean: dict[int, int]) -> tuple[dict[int, float], int]:
    """Choose features that explain the toxic rows: the one with most unexplained rows first, until support ends.

    Rare words that merely stand beside a toxic word are not chosen, since their rows are explained already; features
    of SIGNIFICANT toxic rows (of different families) and no clean row are. Returns the precision of each chosen
    feature and the number of rows left unexplained.
    """
    rows: dict[int, set[int]] = {}
    for i, fs in enumerate(incidence):
        for f in fs:
            rows.setdefault(f, set()).add(i)
    precise = {f: (len(r) + 0.1) / (len(r) + clean.get(f, 0) + 0.2) for f, r in rows.items()}
    total = {f: len(r) for f, r in rows.items()}
    left = {f: set(r) for f, r in rows.items() if precise[f] >= PRECISION and len(r) >= SUPPORT}
    lexicon: dict[int, float] = {}
    explained: set[int] = set()
    while left:
        most = max(len(r) for r in left.values())
        if most < SUPPORT:
            break
        # Among features of about the same reach: fewest clean rows, most toxic rows in all, then the longest form.
        best = max((f for f, r in left.items() if len(r) >= 0.98 * most), key=lambda f: (-clean.get(f, 0), total[f], f))
        lexicon[best] = precise[best]
        now = left.pop(best)
        explained |= now
        left = {f: r - now for f, r in left.items() if len(r - now) >= SUPPORT}
    lexicon |= {f: precise[f] for f, n in total.items() if n >= SIGNIFICANT and not clean.get(f, 0)}
    return lexicon, len(incidence) - len(explained)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted lexicon hashes, their precisions, and the score of a text without any; fitted on FIT_ROWS labelled rows at most.

    Only labelled rows are read: distinct texts count, a row labelled twice is toxic if either label is 1, null labels
    do not count.
    """
    sc = docs.sparkSession.sparkContext
    sample = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg((F.max(F.col(label_col)) > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_i"), "_i").limit(FIT_ROWS)
    # Broadcast: FIT_ROWS rows of 12 bytes at most.
    rows = docs.join(F.broadcast(sample), docs[id_col] == F.col("_i")).select("_y", F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    rows = durable(rows.groupBy("_text").agg(F.max("_y").alias("_y")).select("_y", "_text"), "labelled")
    shared = sc.broadcast(model)
    schema = "fam long, f array<long>"
    featured = lambda y, *wanted: rows.where(F.col("_y") == y).mapInArrow(_featured(shared, *wanted), schema)
    # Near copies of one toxic text are one witness.
    witnesses = lambda *wanted: featured(1, *wanted).groupBy("fam").agg(F.min("f").alias("f"))
    seen = witnesses().select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    clean = featured(0).select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("clean"))
    # Only features that are precise enough leave Spark, however many rows they have.
    n, n_clean = F.col("n"), F.coalesce("clean", F.lit(0))
    fit = seen.join(clean, "f", "left").where(n >= PRECISION * (n + n_clean)).select("f", n_clean.alias("clean")).toArrow()
    chosen = fit.column("f").to_numpy()
    clean_rows = dict(zip(chosen.tolist(), fit.column("clean").to_pylist(), strict=True))
    some = sc.broadcast(np.sort(chosen.view(np.uint64)))
    incidence = [r["f"] for r in witnesses(some).collect()]
    lexicon, unexplained = _cover(incidence, clean_rows)
    total = max(1, rows.count())
    keys = np.array(list(lexicon), dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(list(lexicon.values()))[order], min(0.5, (unexplained + 0.1) / total)


def score(docs: DataFrame, model: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. A text's score is the chance that some of its lexicon features is toxic.

    Null and empty texts, and texts without any such feature, get the base rate of the rows that the lexicon does not
    explain. Whole texts are read; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, (keys, precision, base) = shared.value
        seen: dict[str, str] = {}
        for batch in batches:
            out = np.full(batch.num_rows, base)
            for a, b in steps(batch.column("_text")):
                doc, h = features(batch.column("_text")[a:b], lm, seen)
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                pair = np.unique(np.stack((doc[hit], at[hit]), axis=1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
                miss = np.bincount(pair[:, 0], weights=np.log(1 - precision[pair[:, 1]] + 1e-12), minlength=b - a)
                out[a:b] = 1 - (1 - base) * np.exp(miss)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.float64())], names=["_id", "score"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, score double").select(F.col("_id").alias(id_col), "score")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    model = character_model(docs)
    lexicon = train(docs, labels.where(~held_out(parts=3, part=1)), model)
    out = score(docs, model, lexicon)
    return out.select("doc_id", held_out(parts=3, part=1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
