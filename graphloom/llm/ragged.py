"""Words and hashes of a batch of texts as flat numpy arrays: one pass over the bytes, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one step of a task holds in flat arrays.
STEP_BYTES = 2_000_000
_ODD = U(0x9E3779B97F4A7C15)  # multiplier of the rolling hash
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about step_bytes of text each; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
        yield at, to
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and the offsets at which texts start (one more at the end)."""
    t = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    t = pc.fill_null(t.cast(pa.large_string()), "")
    t = pc.binary_join_element_wise(t, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, grown as needed."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 200_000)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (ASCII white space separates) and the number of words before each text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, equal wherever the word stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, and the text of each; a text of 1 to n-1 words has one shorter run."""
    lens = np.diff(firsts)
    counts = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lens)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[:-1][doc]
    out = np.zeros(len(doc), dtype=np.uint64)
    last = firsts[1:][doc]
    for i in range(n):
        inside = at + i < last
        h = np.where(inside, hashes[np.minimum(at + i, len(hashes) - 1)] if len(hashes) else U(0), U(0))
        out = out * U(0xD6E8FEB86659FD93) + h
    return mix64(out), doc
