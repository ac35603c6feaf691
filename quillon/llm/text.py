"""Words and shingles: JVM expressions, and the same over byte buffers in numpy.

A word is a run of anything but the six ASCII white space characters, in lower case
(in numpy A-Z alone, as the join of documents asks for); a shingle is five words in a row, or the whole sequence where
there are fewer (and at least one).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: What numpy takes for white space, and A-Z in lower case.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finaliser of a well-known generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What a byte adds to its word's value, A-Z as a-z; what a place multiplies it by; the weight of each word of a shingle.
BYTES = mixed(LOWER.astype(np.uint64) + np.uint64(1))
PLACE, PLACE_BACK = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)
#: Powers of both are kept up to so many places.
KEPT_PLACES = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    if len(have := _powers.get(base, ())) < n:
        factors = np.full(max(n, 4096), base, dtype=np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if n <= KEPT_PLACES:
            _powers[base] = have
    return have[:n]


def shingle_sets(buffer: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document numbers, hashes, words per document) of every shingle of texts
    that stand one after another in a buffer of UTF-8 bytes; ends[i] is where
    text i ends. Sorted by document and hash, each hash once per document.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from running
    sums; a shingle's hash is a weighted sum of its words', mixed. Whole texts, and
    all in array operations.
    """
    n_docs = len(ends)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    inside = ~SPACE[buffer]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = ends > starts
    begins[starts[full]] |= inside[starts[full]]
    closes[ends[full] - 1] |= inside[ends[full] - 1]
    b, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(BYTES[buffer] * powers(PLACE, len(buffer)), dtype=np.uint64, out=sums[1:])
        h = mixed((sums[e] - sums[b]) * powers(PLACE_BACK, len(buffer))[b])
        counts = np.searchsorted(b, ends) - np.searchsorted(b, starts)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        n_sh = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(n_docs), n_sh)
        at = np.arange(len(owner)) + np.repeat(firsts - (np.cumsum(n_sh) - n_sh), n_sh)
        padded = np.concatenate([h, np.zeros(size, np.uint64)])
        s = np.zeros(len(owner), dtype=np.uint64)
        for k in range(size):
            s += padded[at + k] * WEIGHTS[k]
        few = np.flatnonzero((counts > 0) & (counts < size))  # their one shingle ends with the document
        place = np.cumsum(n_sh)[few] - 1
        for k in range(1, size):
            beyond = counts[few] <= k
            s[place[beyond]] -= padded[at[place[beyond]] + k] * WEIGHTS[k]
        s = mixed(s)
    order = np.argsort(s)
    if n_docs <= 1 << 16:
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    owner, s = owner[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], s[new], counts


#: The weights of a shingle's words.
WEIGHTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * MIX) | np.uint64(1)
