"""Words and word shingles: words are lower-cased runs of anything but white space, shingles five of them.

A text of one to four words has one shingle of all its words; a text without words has none.
"""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5
SIMILAR = 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def let(value: Column, use) -> Column:
    """`use(value)`, with `value` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def native_shingles(hashes: Column, size: int = WORDS) -> Column:
    """Shingle hashes of an array of word hashes, for texts of at least `size` words, else an empty array."""

    def shingles(w):
        starts = F.slice(w, 1, F.greatest(F.size(w) - size + 1, F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(w, i + k) for k in range(1, size)]))

    return let(hashes, shingles)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Shingle hashes, in order, of one text's word hashes."""
    w = hashes.view(np.uint64)
    if not w.size:
        return w
    size = min(size, w.size)
    count = w.size - size + 1
    h = w[:count].copy()
    for k in range(1, size):
        h = h * _STEP + w[k : k + count]
    return mix(h + np.uint64(size))


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs."""
    return np.unique(shingle_hashes(hashes), return_counts=True)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """Sorted numbers, one per shingle and occurrence: as sets they have the weighted Jaccard similarity of the
    texts whose shingles are weighted by counts."""
    distinct, counts = weighted(hashes)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix(np.repeat(distinct, counts) + nth.astype(np.uint64) * _STEP))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of numbers; 0 for two empty ones."""
    if not a.size or not b.size:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (a.size + b.size - shared)
