"""Hashed token counts of whole texts, for the trained models.

Tokens are words and runs of marks. A word that equals the one before it is a repeat; texts with many repeats
get extra tokens for each share of repeats they exceed, which count as often as the text has words. Each is hashed into one of a fixed number of buckets. Python's own hash is seeded per process, so CRC-32 is used.
"""

import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np

BUCKETS = 8192
REMEMBERED = 500_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT_SHARES = (0.08, 0.2, 0.5)


class Hasher:
    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known = {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets of the distinct tokens, how often each token occurs, and the number of tokens."""
        text = text.lower() if text else ""
        words, tokens = text.split(), _TOKEN.findall(text)
        found = Counter(tokens)
        repeats = sum(map(eq, words, words[1:]))
        for share in REPEAT_SHARES:
            if repeats > share * len(words):
                found[f"\x01{share}"] = len(words)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for token in [t for t in found if t not in known]:
            known[token] = crc32(token.encode()) % self.buckets
        place = np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))
        return place, np.fromiter(found.values(), dtype=np.float64, count=len(found)), len(tokens)
