"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are laid end to end in one numpy array. In each round every sequence that can
still merge applies its pair of lowest rank (the leftmost of equal ones), all sequences at once; what is
left are the tokens. Pre-tokens occur again and again, so a task remembers the count of each.

The counts are those of sentencepiece for a BPE model with identity normalisation, a dummy prefix and
byte fallback: spaces become the mark U+2581, which no piece holds after another character, so that a text
may be cut before each mark; characters in no piece are as many tokens as UTF-8 bytes, and the line feed
is one of them, so that lines are counted apart.

Defined cases: a null or empty text has no bytes and no tokens; texts of any length are counted whole;
repeated rows and ids, null ids and other columns are passed over.
"""

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Pre-tokens remembered by a task at most, and those merged in one array.
REMEMBERED, TOGETHER = 1_000_000, 20_000
# Longer pre-tokens are merged one by one with a heap, which takes n log n steps instead of n rounds.
LONG = 200
_NONE = np.iinfo(np.int64).max
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merges:
    """Which neighbouring symbols a vocabulary merges, and how early."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is known here")
        scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in scores):
            raise ValueError("a piece crosses a pre-token")
        rank_of = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.symbols = {}
        for piece in scores:
            for symbol in (piece, *piece):
                self.symbols.setdefault(symbol, len(self.symbols))
        self.base = len(self.symbols) + 1  # the last number stands for characters of no piece
        # Tokens each symbol counts for: a piece is one, a character of no piece its bytes.
        self.cost = np.array([1 if s in scores else len(s.encode()) for s in self.symbols] + [0], dtype=np.int64)
        pairs = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank_of[score], self.symbols[piece])
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, _NONE)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [0], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [0], dtype=np.int64)

    def counts(self, units: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = np.zeros(len(units), dtype=np.int64)
        short = []
        for i, unit in enumerate(units):
            if len(unit) > LONG:
                out[i] = self._count_long(unit)
            elif unit:
                short.append(i)
        for start in range(0, len(short), TOGETHER):
            chosen = short[start : start + TOGETHER]
            out[chosen] = self._count_together([units[i] for i in chosen])
        return out.tolist()

    def _laid_out(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbol numbers of the characters, and the tokens of those that are in no piece."""
        other = self.base - 1
        number = {c: self.symbols.get(c, other) for c in set(text)}
        width = {c: len(c.encode()) if n == other else 0 for c, n in number.items()}
        return (
            np.fromiter(map(number.__getitem__, text), dtype=np.int64, count=len(text)),
            np.fromiter(map(width.__getitem__, text), dtype=np.int64, count=len(text)),
        )

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; a pair that does not merge has the rank `_NONE`."""
        pair = left * self.base + right
        place = np.searchsorted(self.keys, pair)
        return np.where(self.keys[place] == pair, self.ranks[place], _NONE), self.merged[place]

    def _count_together(self, units: list[str]) -> np.ndarray:
        symbols, other = self._laid_out("".join(units))
        owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done = np.bincount(owner, weights=other, minlength=len(units)).astype(np.int64)
        # What each symbol and the next one of its sequence would become, and how early.
        rank, into = self._look_up(symbols, np.append(symbols[1:], 0))
        rank[np.append(owner[1:] != owner[:-1], True)] = _NONE
        while symbols.size:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, symbols.size))
            active = np.repeat(lowest < _NONE, lengths)
            over = ~active  # finished sequences leave
            done += np.bincount(owner[over], weights=self.cost[symbols[over]], minlength=len(units)).astype(np.int64)
            hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & active)
            at = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if hit.size else hit  # leftmost of each
            symbols[at] = into[at]
            active[at + 1] = False
            place = np.cumsum(active)[at] - 1
            symbols, owner, rank, into = symbols[active], owner[active], rank[active], into[active]
            for changed in (place, place[place > 0] - 1):  # pairs that begin or end with a merged symbol
                beside = np.minimum(changed + 1, symbols.size - 1)
                rank[changed], into[changed] = self._look_up(symbols[changed], symbols[beside])
                rank[changed[(beside == changed) | (owner[beside] != owner[changed])]] = _NONE
        return done

    def _count_long(self, unit: str) -> int:
        symbols, other = self._laid_out(unit)
        symbols = symbols.tolist()
        n, pairs, base = len(symbols), self.pairs, self.base
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := pairs.get(symbols[i] * base + symbols[i + 1]):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(heap)
        while heap:
            _, i, left, right, merged = heappop(heap)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := pairs.get(symbols[a] * base + symbols[b])):
                    heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))
        return int(other.sum()) + sum(int(self.cost[s]) for s in symbols if s >= 0)


@lru_cache(maxsize=4)
def merges(model_path: str) -> Merges:
    return Merges(model_path)


def _units(text: str) -> Iterator[str]:
    """Pre-tokens in which spaces are marks already; line feeds are left out."""
    for i, line in enumerate(text.split("\n")):
        parts = line.split(" ")
        if "" in parts or MARK in line:
            line = line.replace(" ", MARK)
            yield from _UNIT.findall(line if i else MARK + line)
        else:
            yield parts[0] if i else MARK + parts[0]
            for part in parts[1:]:
                yield MARK + part


def count_tokens(texts: list[str], model: Merges, known: dict[str, int]) -> list[int]:
    """Tokens of each text; `known` keeps what pre-tokens count for."""
    cut = [list(_units(t)) if t else [] for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list({u for units in cut for u in units if u not in known})
    known.update(zip(new, model.counts(new)))
    get = known.__getitem__
    return [sum(map(get, units)) + text.count("\n") for units, text in zip(cut, texts)]


def token_counts(
    docs: DataFrame, model_path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` per row of `docs`; `model_path` is read by every worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = merges(model_path), {}
        for batch in batches:
            counted = pa.array(count_tokens(batch["text"].to_pylist(), model, known), pa.int64())
            columns = [batch["doc_id"], batch["n_bytes"], counted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
