"""Periodic runs of words: stretches that repeat one unit at least a number of times, and texts without the repeats.

A run is a maximal stretch of words with smallest period q whose length is at least MIN_LENGTH and MIN_POWER x q.
Words are separated by ASCII white space and compared as bytes. Every text is cut at words that cannot be part
of a run (a word of a run occurs at least MIN_POWER times in it), and each piece left is treated as follows:

1. The first phase of Baier's suffix sorter keeps suffixes in groups of equal context, takes the groups from the
   greatest to the smallest, and appends each group's context to the contexts of the nearest suffixes before its
   members that still belong to lower groups. The context a suffix ends with is the longest Lyndon word that
   starts there, so the final context lengths are the Lyndon array. This is done under the order of the words
   and under its reverse.
2. Every run has Lyndon roots under one of the orders: at places i, i + q and i + 2q the array holds q. Such roots
   are extended both ways by longest common extensions of the text with itself q words on; the roots of one run
   are extended once.

A text is treated within one task, as a run may span all of it; memory is some 100 bytes per word of it.

Defined cases: null, empty and blank texts have no runs and an empty collapsed text; repeated rows and ids give
a row each; texts of one run, overlapping runs and runs inside runs are all reported; columns named like a
result are replaced, other columns pass through.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 6
MIN_POWER = 4
BLANKS = " \t\n\x0b\f\r"
# Rounds of cutting a text at words that are too rare in their piece; pieces beyond are sorted as they are.
CUTS = 6
SMALL = 64

_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")])


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping of suffixes."""
    n = len(ranks)
    first = {}
    for i, rank in enumerate(ranks):
        first.setdefault(rank, []).append(i)
    # Groups of suffixes: members in text order, length of the shared context, the next lower and next greater group.
    members = [first[rank] for rank in sorted(first)]
    context = [1] * len(members)
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    done, before, lengths = bytearray(n), [-1] * n, [0] * n
    g = len(members) - 1
    while g >= 0:
        places = [i for i in members[g] if group[i] == g]
        members[g] = None
        size = context[g]
        for i in places:
            done[i] = 1
            lengths[i] = size
        # Suffixes to extend, and by how many copies of this context: members with the same one follow each other.
        targets, copies = [], []
        for i in places:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if targets and targets[-1] == j:
                copies[-1] += 1
            elif j >= 0:
                targets.append(j)
                copies.append(1)
        longer = {}
        for j, k in zip(targets, copies):
            longer.setdefault((group[j], k), []).append(j)
        # The more copies, the greater: groups of one origin are put above it in ascending order.
        top = {}
        for old, k in sorted(longer):
            new, below = len(members), top.get(old, old)
            members.append(longer[old, k])
            context.append(context[old] + k * size)
            for j in members[new]:
                group[j] = new
            above = upper[below]
            lower.append(below)
            upper.append(above)
            upper[below] = lower[above] = top[old] = new
        g = lower[g]
    return lengths


def _extension(words: np.ndarray, a: int, b: int) -> int:
    """Number of equal words from places a < b on."""
    n, length, step = len(words), 0, 16
    while b + length < n:
        step = min(step, n - b - length)
        differ = words[a + length : a + length + step] != words[b + length : b + length + step]
        at = int(differ.argmax())
        if differ[at]:
            return length + at
        length += step
        step *= 2
    return length


def _piece_runs(words: np.ndarray, min_length: int, min_power: int) -> set[tuple[int, int, int]]:
    """Runs of a piece as (start, length, period)."""
    n, found = len(words), set()
    backwards = words[::-1]
    ranks = np.unique(words, return_inverse=True)[1]
    for order in (ranks, -ranks):
        lengths = np.array(lyndon_array(order.tolist()))
        at = np.arange(n)
        at = at[at + 3 * lengths <= n]
        q = lengths[at]
        roots = at[(lengths[at + q] == q) & (lengths[at + 2 * q] == q) & (words[at] == words[at + q])]
        known = {}  # end of the latest run of a period
        for i, q in zip(roots.tolist(), lengths[roots].tolist()):
            if i + q <= known.get(q, 0):
                continue
            end = i + q + _extension(words, i, i + q)
            start = i - _extension(backwards, n - i - q, n - i)
            if end - start >= 2 * q:
                known[q] = end
                if end - start >= max(min_length, min_power * q):
                    found.add((start, end - start, q))
    return found


def _pieces(words: np.ndarray, min_length: int, min_power: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that can hold runs, with their places: no word of them is rarer than a run's words."""
    at = np.flatnonzero(np.bincount(words)[words] >= min_power) if len(words) >= min_length else np.zeros(0, np.int64)
    cut = len(at) < len(words)
    for _ in range(CUTS):
        if not cut or not len(at):
            break
        # Neighbouring words make a piece; short pieces go, then words rare within their piece.
        piece = np.cumsum(np.diff(at, prepend=at[0]) > 1)
        at, piece = at[np.bincount(piece)[piece] >= min_length], piece[np.bincount(piece)[piece] >= min_length]
        _, kind, count = np.unique(piece * (len(words) + 1) + words[at], return_inverse=True, return_counts=True)
        often = count[kind] >= min_power
        cut = not often.all()
        at = at[often]
    if len(at):
        for places in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(places) >= min_length:
                yield int(places[0]), words[places]


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """Runs of a sequence of words as (start, length, period), by start and period."""
    if min_power < 4:
        raise ValueError("runs are told by three roots in a row, which takes a power of 4 or more")
    if len(words) < min_length:
        return []
    first = {}
    numbers = np.fromiter(map(first.setdefault, words, itertools.count()), dtype=np.int64, count=len(words))
    if len(words) <= SMALL and np.bincount(numbers).max() < min_power:
        return []
    found = []
    for start, piece in _pieces(numbers, min_length, min_power):
        found += [(start + s, length, q) for s, length, q in _piece_runs(piece, min_length, min_power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those of a run's second and later copies."""
    if not runs:
        return words
    covers = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        covers[start + q] += 1
        covers[start + length] -= 1
    return list(itertools.compress(words, np.cumsum(covers[:-1]) == 0))


def periodic_runs(
    docs: DataFrame, *, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed",
    min_length: int = MIN_LENGTH, min_power: int = MIN_POWER,
) -> DataFrame:
    """`docs` with the runs of every whole text (by start, then period) and the text without repeated units."""
    kept = [c for c in docs.columns if c not in (runs_col, collapsed_col)]
    # The text goes in under a name of its own, so that the input may be replaced.
    given = docs.select(*kept, F.col(text_col).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, texts = [], []
            for text in batch["_bytes"]:
                words = (text.as_py() or b"").split()
                runs = runs_of(words, min_length, min_power)
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(all_runs, pa.list_(_ARROW_RUN)), pa.array(texts, pa.string())],
                [*kept, runs_col, collapsed_col],
            )

    schema = T.StructType(
        [*docs.select(kept).schema, T.StructField(runs_col, T.ArrayType(_RUN, False)), T.StructField(collapsed_col, T.StringType())]
    )
    return given.mapInArrow(run, schema)


def repeated_tail(text: Column, number: Column) -> Column:
    """The text in which every word from place a on is taken from the p words there in turn, where a and p follow
    from `number`: a = number % n, p = 1 + (n - a) div (3 + number % 8), with n words. Blank texts stay."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    n = F.size(words).cast("long")
    a = number % n
    rest = n - a
    p = F.lit(1) + F.floor(rest / (F.lit(3) + number % 8)).cast("long")
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.ceil(rest / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, copies)), F.lit(1), rest.cast("int"))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, ties by smallest start, then period; null without runs."""
    def order(x, y):
        gain = y["length"] * x["period"] - x["length"] * y["period"]
        later = F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.signum(F.when(gain != 0, gain).otherwise(later)).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))
