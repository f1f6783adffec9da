"""Bytes of repeated passages, found by deep-shallow suffix sorting.

A passage is any string of LENGTH bytes that starts at two places or more, in one document or in two. Sorting
the suffixes at all places would move each byte hundreds of times, so suffixes are sampled: of the grams
(GRAM bytes) inside each LENGTH bytes, the one of least hash is an anchor. Equal passages choose equal
anchors, so every passage that occurs twice is seen from two anchors with equal grams. Anchors whose gram
occurs once are left out by counting. For the rest, the suffix from the anchor on and the prefix before it,
reversed, are sorted among those of equal grams, deep-shallow: multikey quicksort by eight-byte words as
deep as the gram, then a blind trie for each group that is still together. The common prefixes of neighbours
give those of all pairs, and with them the offsets at which an anchor lies in a passage that occurs again.

Equal texts are folded first, as each removes the other. A gram with more than MOST anchors is not sorted in
one task: anchors with equal bytes on both sides are folded by counting, and the rest is dealt again by longer
strings, each for a part of the offsets, until groups are small.

Defined cases: a null text is an empty one; texts shorter than LENGTH keep all bytes; rows without an id keep
their rows; repeated rows are rows and copies of one another; rows of one id are told apart; other columns
are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.row_ids import unique_ids, with_row_ids
from trafficlens.llm.shingles import mix
from trafficlens.session import written

LENGTH = 400
GRAM = 64
# The anchor lies at one of these offsets within a passage: from 0 to the last one.
LAST = LENGTH - GRAM
MOST = 20_000
# Texts with repeated grams up to which their ids are broadcast (8 bytes each), so that the others do not move.
BROADCAST_IDS = 2_000_000
# Groups up to this size compare all offsets of all pairs at once, larger ones go offset by offset.
PAIRED = 400

_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


# --- anchors -----------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, put together from halves."""
    h, width, power = _BYTE[data], 1, _STEP
    while width < GRAM:
        h = h[: h.size - width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % 2**64
    return mix(h)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over each `width` neighbouring values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = pick(values[: values.size - reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[: values.size - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text."""
    if data.size < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = _gram_hashes(data)
    least = _sliding(h, LAST + 1, np.minimum)
    edge = np.zeros(LAST, dtype=np.uint64)
    # A gram is an anchor if it is the least of one of the windows it lies in: the greatest of those minima.
    greatest = _sliding(np.concatenate([edge, least, edge]), LAST + 1, np.maximum)
    place = np.flatnonzero(greatest == h)
    return place, h[place]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(np.frombuffer(t, dtype=np.uint8)) for t in batch["text"].to_pylist()]
        place = pa.array([p for p, _ in found], pa.list_(pa.int64()))
        gram = pa.array([g.view(np.int64) for _, g in found], pa.list_(pa.int64()))
        rest = [batch[c] for c in ("doc_id", "text_key", "n_bytes", "whole_sha256")]
        yield pa.RecordBatch.from_arrays([*rest, place, gram], ["doc_id", "text_key", "n_bytes", "whole_sha256", "places", "grams"])


_CHUNK = "node long, gram long, n long, at long, before binary, after binary, lo long, hi long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes round each anchor. Anchors of one text with equal bytes round them lie in passages that repeat
    within it: one goes on, and the covered bytes (`lo` to `hi`) of all are known already."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (c.split() for c in _CHUNK.split(", "))])
    for batch in batches:
        for node, text, asked in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist()):
            seen, rows = {}, []
            for one in asked:
                at = one["at"]
                before, after = text[max(0, at - LAST) : at], text[at : at + LENGTH]
                seen.setdefault((before, after), []).append((at, one["gram"], one["n"]))
            for (before, after), places in seen.items():
                at, gram, n = places[0]
                rows.append((node, gram, n, at, before, after, None, None))
                if len(places) > 1 and len(before) + len(after) >= LENGTH:
                    rows += [(node, None, None, at, None, None, at - len(before), at + len(after)) for at, _, _ in places]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- deep-shallow sorting ----------------------------------------------------------------------


def shallow_groups(strings: list[bytes], depth: int = GRAM) -> list[np.ndarray]:
    """Indexes of strings that agree in their first `depth` bytes, in groups of two or more, by multikey
    quicksort with keys of eight bytes: each round sorts within the groups of the last one."""
    keys = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), dtype=">u8").reshape(len(strings), -1)
    index, group = np.arange(len(strings)), np.zeros(len(strings), dtype=np.int64)
    for word in range(keys.shape[1]):
        key = keys[index, word].astype(np.uint64)
        order = np.lexsort([key, group])
        index, group, key = index[order], group[order], key[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new) - 1
        together = np.bincount(group)[group] > 1
        index, group = index[together], group[together]
        if not index.size:
            return []
    return np.split(index, np.flatnonzero(np.diff(group)) + 1)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by their branching bytes alone: a string goes down blindly, is compared once with the string it
    meets, and is put where they part."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.depth, self.kids, self.same = [], [], {}
        self.root = None
        for i in range(len(strings)):
            self._insert(i)

    def _branch(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        if self.root is None:
            self.root, self.same[i] = ~i, [i]
            return
        node = self.root
        while node >= 0:
            kids = self.kids[node]
            node = kids.get(self._branch(i, self.depth[node]), next(iter(kids.values())))
        met = ~node
        a, b = self.strings[i], self.strings[met]
        if a == b:
            self.same[met].append(i)
            return
        part = common_prefix(a, b)
        self.same[i] = [i]
        above, node = None, self.root
        while node >= 0 and self.depth[node] < part:
            above, node = node, self.kids[node][self._branch(i, self.depth[node])]
        if node >= 0 and self.depth[node] == part:
            self.kids[node][self._branch(i, part)] = ~i
            return
        self.depth.append(part)
        self.kids.append({self._branch(i, part): ~i, self._branch(met, part): node})
        new = len(self.depth) - 1
        if above is None:
            self.root = new
        else:
            self.kids[above][self._branch(i, self.depth[above])] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indexes of all strings in order, and the common prefix of each with the one before (0 for the first)."""
        order, shared = [], []
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if node < 0:
                equal = self.same[~node]
                order += equal
                shared += [common] + [len(self.strings[~node])] * (len(equal) - 1)
                continue
            kids = sorted(self.kids[node].items(), reverse=True)
            stack += [(kid, self.depth[node]) for _, kid in kids[:-1]] + [(kids[-1][1], common)]
        return order, shared


def _all_pairs(strings: list[bytes]) -> np.ndarray:
    """Common prefix of every two strings, from neighbours in sorted order."""
    order, shared = BlindTrie(strings).ordered()
    n = len(order)
    out = np.zeros((n, n), dtype=np.int64)
    for i in range(n - 1):
        run = np.minimum.accumulate(shared[i + 1 :])
        out[order[i], order[i + 1 :]] = run
        out[order[i + 1 :], order[i]] = run
    return out


def repeated_offsets(before: list[bytes], after: list[bytes], low: int = 0, high: int = LAST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of each anchor in passages that another one shares, from `low` to `high`; the
    least exceeds the greatest where there is none. `before` is reversed."""
    n = len(before)
    if n == 2:
        first = max(low, LENGTH - common_prefix(*after))
        last = min(high, common_prefix(*before))
        return np.full(2, first), np.full(2, last)
    if n <= PAIRED:
        first = np.maximum(LENGTH - _all_pairs(after), low)
        last = np.minimum(_all_pairs(before), high)
        np.fill_diagonal(first, LENGTH + 1)
        fits = first <= last
        return np.where(fits, first, LENGTH + 1).min(axis=1), np.where(fits, last, -1).max(axis=1)
    least, most = np.full(n, LENGTH + 1), np.full(n, -1)
    sorted_by = [BlindTrie(side).ordered() for side in (after, before)]
    sizes = [np.array([len(s) for s in side]) for side in (after, before)]
    for offset in range(low, high + 1):
        part = []
        for (order, shared), wanted in zip(sorted_by, (LENGTH - offset, offset)):
            of = np.empty(n, dtype=np.int64)
            of[order] = np.cumsum(np.array(shared) < wanted)
            part.append(of)
        long_enough = (sizes[0] >= LENGTH - offset) & (sizes[1] >= offset)
        key = np.where(long_enough, part[0] * (n + 1) + part[1], -1 - np.arange(n))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[which] > 1
        least[again] = np.minimum(least[again], offset)
        most[again] = offset
    return least, most


_COVERED = "node long, lo long, hi long"


def _resolve(low: int, high: int):
    """Covered bytes of anchors that arrive sorted by `key`."""

    def covered(rows: list[dict]) -> list[tuple]:
        out = []
        for group in shallow_groups([r["after"] for r in rows]):
            part = [rows[i] for i in group]
            first, last = repeated_offsets([r["before"][::-1] for r in part], [r["after"] for r in part], low, high)
            out += [(r["node"], r["at"] - int(b), r["at"] + LENGTH - int(a)) for r, a, b in zip(part, first, last) if a <= b]
        return out

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [[], [], []])], ["node", "lo", "hi"])

    def run(batches):
        held = []
        for batch in batches:
            held += batch.to_pylist()
            if not held:
                continue
            last = held[-1]["key"]
            cut = len(held)
            while cut and held[cut - 1]["key"] == last:  # the last group may go on
                cut -= 1
            ready, held = held[:cut], held[cut:]
            yield made(covered(ready)) if ready else made([])
        if held:
            yield made(covered(held))

    return run


def _sorted_out(rows: DataFrame, low: int, high: int) -> DataFrame:
    dealt = rows.select("key", "node", "at", "before", "after").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_resolve(low, high), _COVERED)


def _spans(rows: DataFrame, most: int) -> DataFrame:
    """Covered bytes from anchors `key, n, node, at, before, after` of equal grams, `n` of a key at most."""
    parts, todo = [], [(rows, 0, LAST, False)]
    while todo:
        now, low, high, folded = todo.pop()
        if "n" in now.columns:
            # The bytes are dealt out once: how many there are of a gram is known from counting grams alone.
            few, many = now.where(F.col("n") <= most), now.where(F.col("n") > most).drop("n")
            parts.append(written(_sorted_out(few, low, high), "passage-spans"))
            if not many.limit(1).count():
                continue
        else:
            counts = written(now.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "passage-counts")
            hot = counts.where(F.col("n") > most).select("key")
            few = now.join(counts.where(F.col("n") <= most).select("key"), "key")
            parts.append(written(_sorted_out(few, low, high), "passage-spans"))
            if not hot.limit(1).count():
                continue
            many = written(now.join(hot, "key"), "passage-anchors")
        if not folded:
            met, rest = _folded(many, low, high)
            parts.append(met)
            if low < high:  # else what was alike has been one passage, and the rest is alone
                todo.append((rest, low, high, True))
            continue
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle + 1, high)):
            # Bytes that every passage with an offset from a to b has: a before the anchor, the rest after.
            inside = many.where((F.octet_length("before") >= a) & (F.octet_length("after") >= LENGTH - b))
            longer = F.xxhash64("key", F.expr(f"right(before, {a})") if a else F.lit(""), F.substring("after", 1, LENGTH - b))
            todo.append((written(inside.withColumn("key", longer), "passage-anchors"), a, b, False))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return spans


def _folded(many: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Covered bytes of anchors whose passages with offsets from `low` to `high` are all shared with another
    anchor's, and the anchors that are left: one of those alike, and the others."""
    whole = (F.octet_length("before") >= high) & (F.octet_length("after") >= LENGTH - low)
    around = F.concat(F.expr(f"right(before, {high})") if high else F.lit(b""), F.substring("after", 1, LENGTH - low))
    marked = written(many.withColumn("around", F.when(whole, F.md5(around))), "passage-anchors")
    alike = marked.where("around is not null").groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("node", "at")).alias("first"))
    met = written(marked.join(alike.where("n > 1"), ["key", "around"], "left"), "passage-alike")
    spans = met.where("n is not null").select("node", (F.col("at") - high).alias("lo"), (F.col("at") - low + LENGTH).alias("hi"))
    rest = met.where(F.col("n").isNull() | (F.struct("node", "at") == F.col("first")))
    return spans, rest.select("key", "node", "at", "before", "after")


# --- whole texts -------------------------------------------------------------------------------


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        rows = []
        for node, text, spans in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist()):
            edges = np.zeros(len(text) + 1, dtype=np.int64)
            lo = np.array([s["lo"] for s in spans])
            np.add.at(edges, lo, 1)
            np.add.at(edges, [s["hi"] for s in spans], -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
            rows.append((node, int(gone.sum()), runs, sha256(kept).hexdigest(), kept))
        columns = zip(*rows) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["node", "removed", "runs", "sha256", "kept"])


def without_repeats(docs: DataFrame, *, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` per row, and with `keep_bytes` the bytes left, `kept`
    (null: all of them)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if unique_ids(given, "doc_id"):
        return _without(given, most, keep_bytes)
    # Rows are told by numbers of their own.
    keyed = with_row_ids(given)
    out = _without(keyed.select(F.col("_row").alias("doc_id"), "text"), most, keep_bytes).withColumnRenamed("doc_id", "_row")
    return keyed.select("_row", "doc_id").join(out, "_row").drop("_row")


def _without(docs: DataFrame, most: int, keep_bytes: bool) -> DataFrame:
    """`without_repeats` of rows (`doc_id, text`) with ids of their own."""
    raw = F.col("text")
    rows = docs.select(
        "doc_id", F.md5(raw).alias("text_key"), F.length(raw).cast("long").alias("n_bytes"),
        F.sha2(raw, 256).alias("whole_sha256"), raw.alias("text"),
    )
    schema = "doc_id long, text_key string, n_bytes long, whole_sha256 string, places array<bigint>, grams array<bigint>"
    anchored = written(rows.mapInArrow(_anchored, schema), "passage-texts")
    texts = written(
        anchored.groupBy("text_key").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("places").alias("places"), F.first("grams").alias("grams")
        ),
        "passage-distinct",
    )
    placed = texts.select("node", F.explode(F.arrays_zip("places", "grams")).alias("p"))
    placed = placed.select("node", F.col("p.places").alias("at"), F.col("p.grams").alias("gram"))
    again = placed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    asked = placed.join(again, "gram").groupBy("node").agg(F.collect_list(F.struct("at", "gram", "n")).alias("asked"))
    asked = written(asked, "passage-asked")
    # One row per distinct text: the one of the smallest id.
    named = rows.select(F.col("doc_id").alias("node"), "text")
    if asked.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(asked.select("node")), "node", "left_semi")
    wanted = written(named.join(asked, "node"), "passage-wanted")

    chunks = written(wanted.mapInArrow(_chunks, _CHUNK), "passage-chunks")
    between = _spans(chunks.where("gram is not null").select(F.col("gram").alias("key"), "n", "node", "at", "before", "after"), most)
    spans = chunks.where("gram is null").select("node", "lo", "hi").unionByName(between)
    covered = spans.groupBy("node").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    done = wanted.select("node", "text").join(covered, "node")
    removed = done.mapInArrow(_removed, "node long, removed long, runs long, sha256 string, kept binary")
    if not keep_bytes:
        removed = removed.drop("kept")

    folded = texts.select("text_key", "node", "copies").join(removed, "node", "left").drop("node")
    out = anchored.select("doc_id", "text_key", "n_bytes", "whole_sha256").join(folded, "text_key")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    pick = lambda gone, part, none: F.when(all_gone, gone).otherwise(F.coalesce(part, none))
    columns = {
        "n_removed": pick(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")),
        "n_spans": pick(F.lit(1).cast("long"), F.col("runs"), F.lit(0).cast("long")),
        "kept_sha256": pick(F.sha2(F.lit("").cast("binary"), 256), F.col("sha256"), F.col("whole_sha256")),
    }
    if keep_bytes:
        columns["kept"] = F.when(all_gone, F.lit("").cast("binary")).otherwise(F.col("kept"))
    return out.select("doc_id", "n_bytes", *[c.alias(n) for n, c in columns.items()])
