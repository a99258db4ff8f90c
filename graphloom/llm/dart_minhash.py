"""Near-duplicate documents by DartMinHash: hashed darts thrown at weighted element regions, banded, then verified.

A document is a weighted set: its runs of five words (lower-cased, split at ASCII white space), weighted by how often
they occur. Every element has a plane weight x rank in which darts lie as a Poisson process of rate 1 that depends on
the element alone. A document owns the darts below its element's weight; per coordinate of the signature the owned
dart of lowest rank is kept. Two documents keep the same dart with probability equal to their weighted Jaccard
similarity (sum of minima over sum of maxima). Only darts of rank below t / (total weight) are thrown, about t per
document however long it is; a document that leaves a coordinate empty throws on to twice that rank.

Bands propose pairs in the shape of stars (each member of a bucket with the bucket's pivot), so a bucket's pairs are as
many as its members; every pair is then verified on whole texts, and verified links make components. The pivot is the
member that shares most buckets, which is the original among its copies. Buckets that still hold several classes propose
once more, with other pivots (those with most links). What then remains unresolved is compared exactly, rarest runs
first: two texts at the threshold share one of the rarest fifth of their runs, and the first that they share stands so
early in both that enough runs follow it. Texts that have a passage in common, however many they are, differ in their
rare runs and never meet, and texts of one class are not paired. So no link is lost to the choice of pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, durable, release, text_or_empty
from graphloom.llm.ragged import U, flat, mix64, shingles, steps, word_hashes, words

N_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Rounds of stars before the exact comparison, and pivots of a bucket in the second.
STARS, PIVOTS = 2, 4
#: Texts in one block of a common run's comparison; bits of the sketch that bounds how much two texts differ.
BLOCK, BITS = 2_048, 512
#: A text's rarest runs that go along with each of its postings.
HEAD = 16
#: Cells of the rank axis end at 4**LOWEST, 4**(LOWEST+1), ...; the first starts at 0.
LOWEST = -4
_POISSON: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events as 64-bit integers, up to where nothing is left."""
    if mean not in _POISSON:
        p, total, out = math.exp(-mean), 0.0, []
        for i in range(400):
            total += p
            out.append(min(total, 1.0))
            p *= mean / (i + 1)
            if total > 1 - 1e-15:
                break
        _POISSON[mean] = np.array([min(int(x * 2**64), 2**64 - 1) for x in out], dtype=np.uint64)
    return _POISSON[mean]


def weighted_shingles(texts: pa.Array, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text and hash."""
    data, offsets = flat(pc.utf8_lower(texts))
    starts, ends, firsts = words(data, offsets)
    h, doc = shingles(word_hashes(data, starts, ends), firsts, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def units(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of unit elements: the k-th occurrence of a run in a text is one of its own."""
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(doc, weight), mix64(np.repeat(element, weight) + copy.astype(np.uint64) * U(0xA24BAED4963EE407))


def sketches(doc: np.ndarray, unit: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x BITS / 64 words: bit i tells whether an odd number of the text's units fall in cell i. A unit that only
    one of two texts has turns one bit, so sketches differ in no more bits than texts in units."""
    odd = np.bincount(doc * BITS + (unit >> U(20)).astype(np.int64) % BITS, minlength=n_docs * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_docs, BITS), axis=1).view(np.int64)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k signature of 32-bit dart ids; rows of documents without elements are all zero."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    best = np.full(n_docs * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.zeros(n_docs)
    high = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n_docs), where=total > 0)
    # An integer weight w is w unit cells of weight, so that a larger weight owns all darts of a smaller one.
    unit_doc, unit = units(doc, element, weight)
    live = np.arange(len(unit))
    while len(live):
        d, u = unit_doc[live], unit[live]
        top = high[d].max()
        level = LOWEST
        while True:
            a, b = (0.0 if level == LOWEST else 4.0 ** (level - 1)), 4.0**level
            in_cell = (high[d] > a) & (low[d] < b)
            cd, cu = d[in_cell], u[in_cell]
            seed = mix64(cu + U((level - LOWEST + 1) * 0x9FB21C651E98DF25 % 2**64))
            count = np.searchsorted(_poisson(b - a), seed, side="left")
            has = count > 0
            dd, ds, dc = np.repeat(cd[has], count[has]), np.repeat(seed[has], count[has]), count[has]
            nth = np.arange(len(dd)) - np.repeat(np.cumsum(dc) - dc, dc)
            dart = mix64(ds + (nth.astype(np.uint64) + U(1)) * U(0xE7037ED1A0B428DB))
            rank = a + (b - a) * (dart >> U(11)).astype(np.float64) * 2.0**-53
            ok = (rank < high[dd]) & (rank >= low[dd])
            dd, dart, rank = dd[ok], mix64(dart[ok] + U(1)), rank[ok]
            # One word orders by rank and carries the dart's id: a positive float's bits order like the number.
            word = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (dart >> U(32))
            np.minimum.at(best, dd * k + ((dart & U(0xFFFFFFFF)) % U(k)).astype(np.int64), word)
            if b >= top:
                break
            level += 1
        short = np.zeros(n_docs, dtype=bool)
        short[np.flatnonzero((best.reshape(n_docs, k) == np.iinfo(np.uint64).max).any(axis=1))] = True
        short &= total > 0
        low = np.where(short, high, low)
        high = np.where(short, 2 * high, high)
        live = live[short[unit_doc[live]]]
    out = (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, k)
    out[total == 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands 64-bit keys, one per band of `rows` coordinates."""
    key = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * U(0xD6E8FEB86659FD93) + sig.reshape(len(sig), bands, rows)[:, :, r].astype(np.uint64) + U(1))
    return mix64(key + np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys of each text, none for a text without words, its size in runs and its sketch."""
    for batch in batches:
        texts = batch.column("_text")
        for a, b in steps(texts):
            doc, element, count = weighted_shingles(texts[a:b])
            keys = band_keys(signatures(doc, element, count, b - a, BANDS * ROWS), BANDS, ROWS)
            some = np.bincount(doc, minlength=b - a) > 0
            ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel().view(np.int64)))
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(sketches(*units(doc, element, count), b - a).ravel()), BITS // 64).cast(pa.list_(pa.int64()))
            size = pa.array(np.bincount(doc, weights=count, minlength=b - a).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_id")[a:b], batch.column("_sha")[a:b], lists, size, sketch], names=["_id", "_sha", "keys", "size", "sketch"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) and their classes (ca, cb) whose whole texts reach the threshold, exactly computed."""
    for batch in batches:
        ta, tb = batch.column("text_a"), batch.column("text_b")
        size = pc.add(pc.binary_length(ta), pc.binary_length(tb))
        ends, at, good = np.cumsum(size.to_numpy(zero_copy_only=False)), 0, []
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + 2_000_000, side="right")))
            m = to - at
            doc, h, count = weighted_shingles(pa.chunked_array([ta[at:to], tb[at:to]]).combine_chunks())
            pair, order = doc % m, np.lexsort((doc, h, doc % m))
            pair, h, count, doc = pair[order], h[order], count[order], doc[order]
            total = np.bincount(pair, weights=count, minlength=m)
            same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
            common = np.bincount(pair[1:][same], weights=np.minimum(count[1:], count[:-1])[same], minlength=m)
            good.append(common >= THRESHOLD * (total - common) - 1e-9)
            good[-1] &= total > 0
            at = to
        keep = pa.array(np.concatenate(good)) if good else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "ca", "cb")], names=["a", "b", "ca", "cb"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_rep, runs): all elements of each text."""
    for batch in batches:
        for a, b in steps(batch.column("_text")):
            doc, h = units(*weighted_shingles(batch.column("_text")[a:b]))
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b - a)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id")[a:b], lists], names=["_rep", "runs"])


def _postings(some: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(_rep, size, run, at, head): the runs that a text shares with others, at their places by (how common, hash), as far as
    a pair at the threshold must share one, and the first of them. Runs that no other text has come first and are only
    counted. The tables that this reads are given too, to be released once it is stored."""
    listed = durable(some.mapInArrow(_listed, "_rep long, runs array<long>"), "runs")
    each = listed.select("_rep", F.size("runs").cast("long").alias("size"), F.explode("runs").alias("run"))
    counts = durable(each.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "run-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # A run that makes up a thousandth of all or more is joined by broadcast: a thousand rows at most.
    hot = F.broadcast(counts.where(F.col("n") * 1000 >= total))
    rest = each.join(hot.select("run"), "run", "left_anti").join(counts.where(F.col("n") * 1000 < total), "run")
    shared = each.join(hot, "run").unionByName(rest)
    by_text = shared.groupBy("_rep", "size").agg(F.sort_array(F.collect_list(F.struct("n", "run"))).alias("s"))
    alone = F.col("size") - F.size("s")
    length = F.col("size") - F.ceil(F.col("size") * THRESHOLD - 1e-6) + 1
    prefix = by_text.select("_rep", "size", alone.alias("alone"), F.slice("s", 1, F.greatest(length - alone, F.lit(0)).cast("int")).alias("s"))
    placed = prefix.select("_rep", "size", "alone", F.slice(F.col("s")["run"], 1, HEAD).alias("head"), F.posexplode("s").alias("i", "r"))
    return placed.select("_rep", "size", F.col("r")["run"].alias("run"), (F.col("alone") + F.col("i")).alias("at"), "head"), [listed, counts]


def _tasks(rows: DataFrame, per_task: int) -> int:
    """Partitions for work that is far heavier than its bytes tell, which adaptive coalescing would put into one task."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // per_task)


def _differ_little(x, y, size_x, size_y):
    """Whether two sketches leave it open that the texts reach the threshold: those have at most a ninth of their units
    alone."""
    bits = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, BITS // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return bits <= (1 - THRESHOLD) / (1 + THRESHOLD) * (size_x + size_y) + 1e-6


def _unresolved(live: DataFrame, classes: DataFrame, texts: DataFrame, known: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """The pairs (a, b, ca, cb) of different classes that share a bucket of `live` and may reach the threshold; none
    that does is left out. None if no bucket holds several classes. The tables that the pairs are read from are given
    too, to be released once those are stored."""
    with_class = live.join(classes.select("_rep", "c"), "_rep")
    mixed = with_class.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    members = durable(with_class.join(mixed, "key").groupBy("_rep", "c").agg(F.collect_list("key").alias("keys")), "unresolved")
    if members.isEmpty():
        return None, [members]
    some = texts.join(members.select(F.col("_rep").alias("_id")), "_id", "left_semi")
    postings, used = _postings(some)
    posted = durable(postings.join(members.select("_rep", "c"), "_rep").join(known.select("_rep", "sketch"), "_rep"), "postings")
    release(*used)
    # The first run that two texts share has min(size - at) runs from there on at most, all that they can have in common.
    # That many are too few unless it stands within the first ninth of the smaller text (2t / (1 + t) = 8/9).
    early = F.col("size") - F.col("at") >= 2 * THRESHOLD / (1 + THRESHOLD) * F.col("size") - 1e-6
    per = durable(posted.groupBy("run", "c").agg(F.count(F.lit(1)).alias("n"), F.max(early).alias("early")), "run-classes")
    # A run's texts meet block by block. A class that fills a block has blocks of its own, which never meet each other.
    alone = F.col("n") >= BLOCK
    useful = per.groupBy("run").agg(F.count(F.lit(1)).alias("k"), F.max("early").alias("early"), F.sum(F.when(~alone, F.col("n"))).alias("rest")).where("k > 1 AND early").select("run", "rest")
    cells = per.join(useful, "run").select("run", "c", F.when(alone, F.col("c")).otherwise(-1).alias("g"), F.ceil(F.when(alone, F.col("n")).otherwise(F.col("rest")) / BLOCK).alias("blocks"))
    placed = posted.join(cells, ["run", "c"]).select("run", F.struct("g", F.pmod(F.xxhash64("_rep"), "blocks").alias("i")).alias("block"), F.struct("_rep", "c", "size", "at", "head", "sketch").alias("m"))
    placed = durable(placed, "blocks")
    release(posted, per)
    block = placed.select("run", "block").distinct()
    small, large = block.withColumnRenamed("block", "p"), block.withColumnRenamed("block", "q")
    met = small.join(large, "run").where((F.col("p") <= F.col("q")) & ((F.col("p")["g"] != F.col("q")["g"]) | (F.col("p")["g"] < 0)))
    x, y = placed.select("run", F.col("block").alias("p"), F.col("m").alias("x")), placed.select("run", F.col("block").alias("q"), F.col("m").alias("y"))
    most = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    fit = most * (1 + THRESHOLD) >= THRESHOLD * (F.col("x.size") + F.col("y.size")) - 1e-6
    # Texts of one block meet once, in the order of their numbers.
    once = (F.col("p") < F.col("q")) | (F.col("x._rep") < F.col("y._rep"))
    # Two texts meet at the first run that both have, if it is among the first of both; there they fit if they do anywhere.
    both = F.array_intersect("x.head", "y.head")
    first = (F.size(both) == 0) | (F.get(both, F.lit(0)) == F.col("run"))
    close = _differ_little(F.col("x.sketch"), F.col("y.sketch"), F.col("x.size"), F.col("y.size"))
    pairs = met.join(x, ["run", "p"]).repartition(_tasks(placed, 100_000), "run", "q").join(y, ["run", "q"]).where((F.col("x.c") != F.col("y.c")) & fit & once & close & first)
    mine, other = F.struct("x._rep", "x.c"), F.struct("y._rep", "y.c")
    low, high = F.least(mine, other), F.greatest(mine, other)
    pairs = pairs.select(low["_rep"].alias("a"), high["_rep"].alias("b"), low["c"].alias("ca"), high["c"].alias("cb")).distinct()
    keys = lambda c: members.select(F.col("_rep").alias(c), F.col("keys").alias(f"keys_{c}"))
    return pairs.join(keys("a"), "a").join(keys("b"), "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b", "ca", "cb"), [placed, members]


def _verify(pairs: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose whole texts reach the threshold, stored; texts are fetched for those only that their sketches leave open."""
    sides = [known.select(F.col("_rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"]
    pairs = pairs.join(sides[0], "a").join(sides[1], "b").where(_differ_little(F.col("sketch_a"), F.col("sketch_b"), F.col("size_a"), F.col("size_b"))).select("a", "b", "ca", "cb")
    pairs = durable(pairs, "pairs")
    a = texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a"))
    b = texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b"))
    both = pairs.join(a, "a").repartition(_tasks(pairs, 20_000), "b").join(b, "b").select("a", "b", "ca", "cb", "text_a", "text_b")
    links = durable(both.mapInArrow(_verified, "a long, b long, ca long, cb long"), "verified")
    release(pairs)
    return links


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with the columns _id, _sha (digest of the text), component_id, kept."""
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    signed = durable(slim.mapInArrow(_signed, "_id long, _sha binary, keys array<long>, size long, sketch array<long>"), "signed")
    # One row stands for identical texts; the keys follow from the text. Texts are told apart by a number of their own,
    # fixed once the table is written, since different texts may have one id.
    reps = durable(signed.where(F.col("_id").isNotNull() & (F.size("keys") > 0)).groupBy("_sha").agg(F.min(F.struct("_id", "keys", "size", "sketch")).alias("r")).select("_sha", F.monotonically_increasing_id().alias("_rep"), F.col("r")["_id"].alias("_first"), "r.keys", "r.size", "r.sketch"), "reps")
    buckets = reps.select("_rep", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = durable(buckets.join(shared, "key").select("_rep", "key"), "buckets")
    # A text's score chooses pivots: at first the buckets it shares, then the links it has as well.
    classes = durable(live.groupBy("_rep").agg(F.count(F.lit(1)).alias("score")).withColumn("c", F.col("_rep")), "classes")
    searched = durable(reps.join(classes.select("_rep"), "_rep", "left_semi").select("_sha", F.col("_first").alias("_id"), "_rep", "size", "sketch"), "searched")
    known = searched.select("_rep", "size", "sketch")
    texts = durable(slim.join(searched.drop("size", "sketch"), ["_id", "_sha"]).select(F.col("_rep").alias("_id"), "_text"), "texts")
    found = []
    for turn in range(STARS):
        with_class = live.join(classes, "_rep")
        # A bucket that holds several classes has pivots, its members of greatest score; they meet all of other classes
        # and leave, so pairs are a few times the members.
        slots = PIVOTS if turn else 1
        member, rank, slot = F.struct("_rep", "c"), F.struct("score", F.xxhash64("_rep", "key")), F.pmod(F.xxhash64("_rep"), F.lit(slots))
        best = F.array_compact(F.array(*[F.max_by(F.when(slot == i, member), F.when(slot == i, rank)) for i in range(slots)]))
        first = with_class.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), best.alias("f")).where(F.col("lo") < F.col("hi")).select("key", "f")
        met = durable(with_class.join(first, "key"), "met")
        release(live)
        low, high = F.least(member, F.col("p")), F.greatest(member, F.col("p"))
        # A text meets a pivot once, however many of its buckets share it; a list holds BANDS * PIVOTS entries at most.
        others = F.array_distinct(F.flatten(F.collect_list(F.filter("f", lambda p: p["c"] != F.col("c")))))
        pairs = met.groupBy("_rep", "c").agg(others.alias("f")).select("_rep", "c", F.explode("f").alias("p")).select(low["_rep"].alias("a"), high["_rep"].alias("b"), low["c"].alias("ca"), high["c"].alias("cb")).distinct()
        links = _verify(pairs, texts, known)
        live = met.where(~F.exists("f", lambda x: x["_rep"] == F.col("_rep"))).select("_rep", "key")
        if links.isEmpty():
            break
        found.append(links.select("a", "b"))
        # One step of hooking to the smallest linked class is enough here: it merges stars, and a pair of classes that
        # stays apart is only compared again. The components of all links are taken once, after the last round.
        hooked = links.select(F.explode(F.array("ca", "cb")).alias("c"), F.least("ca", "cb").alias("to")).groupBy("c").agg(F.min("to").alias("to"))
        gained = links.select(F.explode(F.array("a", "b")).alias("_rep")).groupBy("_rep").agg(F.count(F.lit(1)).alias("gain"))
        old, classes = classes, durable(classes.join(hooked, "c", "left").join(gained, "_rep", "left").select("_rep", F.coalesce("to", "c").alias("c"), (F.col("score") + F.coalesce("gain", F.lit(0)) * BANDS).alias("score")), "classes")
        release(old)
    # Chains of links leave texts of one component in many classes, whose pairs would all be compared below.
    merged = durable(components(reduce(DataFrame.union, found)), "merged") if found else None
    if merged is not None:
        old, classes = classes, durable(classes.join(merged.withColumnRenamed("id", "_rep"), "_rep", "left").select("_rep", F.coalesce("component", "_rep").alias("c")), "classes")
        release(old)
    # Pairs that no pivot has met are compared now.
    pairs, used = _unresolved(live, classes, texts, known)
    if pairs is not None:
        links = _verify(pairs, texts, known)
        if not links.isEmpty():
            links = links.select("a", "b")
            merged = components(links if merged is None else links.union(merged.select("id", "component")))
    release(live, classes, texts, searched, *used)
    named = reps.select("_sha", "_first", F.col("_rep").alias("c"))
    if merged is not None:
        named = named.join(merged, F.col("c") == F.col("id"), "left").select("_sha", "_first", F.coalesce("component", "c").alias("c"))
    tops = named.groupBy("c").agg(F.min(F.struct("_first", "_sha")).alias("top"))
    named = named.join(tops, "c").select("_sha", "top")
    known = signed.select("_id", F.col("_sha").alias("_text_sha"), F.when(F.col("_id").isNotNull() & (F.size("keys") > 0), F.col("_sha")).alias("_sha"))
    done = known.join(named, "_sha", "left")
    kept = F.col("top").isNull() | ((F.col("_id") == F.col("top")["_first"]) & (F.col("_text_sha") == F.col("top")["_sha"]))
    return done.select("_id", F.col("_text_sha").alias("_sha"), F.coalesce(F.col("top")["_first"], F.col("_id")).alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, component_id (smallest id of its class), kept (id = component_id).

    Two texts are linked if they share a band bucket and their weighted Jaccard similarity over runs of five words is
    0.8 or more; classes are the connected components. A text of one to four words is a single run; null, empty and
    blank texts have no run, link with nothing and stay. Identical texts are one class from the start and enter the
    search once. Rows with a null id stay apart, with a null class, and are kept. Repeated rows share a class.
    Different texts of one id are classed apart; if they are the smallest of one class, the smallest digest is kept.
    Other columns are ignored.
    """
    return _marked(docs, id_col, text_col).select(F.col("_id").alias(id_col), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one document of each class; a row goes by its id and text, not by its id alone."""
    gone = _marked(docs, id_col, text_col).where("NOT kept").select(F.col("_id").alias("_gone"), F.col("_sha").alias("_gone_sha")).distinct()
    sha = F.unhex(F.sha2(text_or_empty(docs[text_col]), 256))
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (sha == gone["_gone_sha"]), "left_anti")
