"""Trie of the turns that conversations start with: which beginnings are shared, by whom, and what sharing saves.

A z-fast trie over sequences of turns, held as tables:

- A turn is known by a digest of its role and text, a beginning of d turns by the chain of the digests of its
  turns (16 bytes). Texts never move.
- A row per compacted node: the stretch (start, stop] of depths of its edge with the digests along it, and the
  handle, the digest at the two-fattest depth of that stretch (the number divisible by the highest power of two).
- Conversations are inserted in batches. All that are not yet in the trie locate their exit node by fat binary
  search: every step halves the depths in question by looking up the digest at their two-fattest depth among the
  handles, one equality join a step. Edges are then cut at the depths where conversations leave or end inside
  them, and of the conversations that leave at one place with the same turn one, chosen by hash, is added
  whole. The others go on to the next batch; a conversation meets as many batches as its path has branches
  at which another was chosen, a logarithmic number on average.
- Sums over subtrees follow parent links with doubling: after round k a node holds the sums of what lies less than
  2^k compacted nodes below. Edges are expanded to a row per depth last.

No group is gathered: cuts per edge are bounded by its length, choices and sums are partial aggregates, and lists
of ids are hashed as a sorted stream of pieces.

Defined cases: null role and text count as empty; rows without an id belong to no conversation; turns are ordered
by number (nulls first), equal numbers by the turn's digest; repeated rows are turns of their own; an
empty table gives no nodes; columns other than the named ones are not looked at. A conversation's digests (about 40
bytes a turn) are one row.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.session import written

ROOT = bytes(16)
# Joined ids are hashed in pieces of about this many bytes.
PIECE = 1 << 20

_STEP = pa.struct([("at", pa.binary()), ("chars", pa.int64()), ("upto", pa.int64())])


def conversations_of_rows(rows: DataFrame, *, key: str, turn: str, role: str, text: str) -> DataFrame:
    """`conv_id, turns`: the turns of each conversation in order, as digest (`key`) and length in characters."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    whole = F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    turns = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest.alias("key"), F.length(said).cast("long").alias("chars")).alias("t"),
    )
    sorted_turns = F.array_sort(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(sorted_turns, lambda t: F.struct(t["key"], t["chars"])).alias("turns"))


def with_shared_starts(conversations: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Each conversation with its first `shared` turns replaced by those of conversation `base` (none if absent)."""
    table = written(conversations.withColumns({"base": base, "shared": shared}), "trie-conversations")
    starts = table.where("conv_id = base").select("base", F.col("turns").alias("start"))
    own = F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns") - F.col("shared"), F.lit(0)))
    start = F.coalesce(F.slice("start", F.lit(1), F.col("shared")), F.slice("turns", 1, 0))
    return table.join(starts, "base", "left").select("conv_id", F.concat(start, own).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every beginning of a conversation, with the length of its last turn and of all of it."""
    for batch in batches:
        turns = batch["turns"]
        ends = turns.offsets.to_numpy() - turns.offsets[0].as_py()
        flat = turns.flatten()
        keys, sizes = flat.field("key").to_pylist(), flat.field("chars").to_numpy(zero_copy_only=False)
        at, chars, upto, offsets = [], [], [], [0]
        for start, stop in zip(ends.tolist(), ends[1:].tolist()):
            digest = ROOT
            at.append(digest)
            for key in keys[start:stop]:
                digest = hashlib.blake2b(digest + key, digest_size=16).digest()
                at.append(digest)
            own = np.concatenate([[0], sizes[start:stop]]).astype(np.int64)
            chars.append(own)
            upto.append(np.cumsum(own))
            offsets.append(len(at))
        flat_steps = pa.StructArray.from_arrays(
            [pa.array(at, pa.binary()), *(pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (chars, upto))],
            fields=list(_STEP),
        )
        steps = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat_steps)
        seq = pa.array([at[stop - 1] for stop in offsets[1:]], pa.binary())
        depth = pa.array(np.diff(offsets) - 1, pa.int32())
        yield pa.RecordBatch.from_arrays([batch["conv_id"], seq, depth, steps], ["conv_id", "seq", "n", "steps"])


def _two_fattest(low: str, high: str) -> str:
    """The number in (low, high] that the highest power of two divides."""
    return f"({high} & shiftleft(-1, length(bin({low} ^ {high})) - 1))"


def _as_nodes(edges: DataFrame) -> DataFrame:
    """Compacted nodes of `start, stop, path` (steps from depth start to stop): with handle, first step and own digest."""
    return edges.select(
        "start", "stop", "path",
        F.expr(f"path[{_two_fattest('start', 'stop')} - start].at").alias("handle"),
        F.expr("path[1].at").alias("first"),
    )


def _located(pending: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """`pending` with the node it leaves the trie in (`exit`, its first step; null at a node's end) and the depth `d`.

    While `low < high`, the trie has a node that ends at depth `low` of the sequence's path, and none beyond `high`.
    """
    # How far a node's path agrees with a sequence: digests are of whole beginnings, so equal ones come first.
    agreed = """start + size(filter(path, (p, i) -> i > 0 and start + i <= n and p.at = steps[start + i].at))"""
    nodes = nodes.select("start", "stop", "path", "handle", "first")
    found = pending.selectExpr("*", "0 as low", "n as high", "cast(null as binary) as exit", "cast(null as int) as d")
    kept = [*pending.columns, "low", "high", "exit", "d"]
    for _ in range(rounds):
        # Rows that are through look for nothing; their own digest deals them out evenly.
        asked = found.withColumn("asked", F.expr(f"if(d is null and low < high, steps[{_two_fattest('low', 'high')}].at, seq)"))
        hit = asked.join(nodes, (F.col("asked") == F.col("handle")) & F.expr("d is null and low < high"), "left")
        hit = hit.withColumn("m", F.when(F.col("handle").isNotNull(), F.expr(agreed)))
        found = hit.selectExpr(
            *pending.columns,
            "if(m = stop, m, low) as low",
            f"if(d is null and low < high and m is null, {_two_fattest('low', 'high')} - 1, high) as high",
            "if(m < stop, first, exit) as exit",
            "if(m < stop, m, d) as d",
        )
    # What is left lies on the edge that goes on from `low` with the sequence's next turn, if there is one.
    asked = found.withColumn("asked", F.expr("if(d is null and low < n, steps[low + 1].at, seq)"))
    hit = asked.join(nodes, (F.col("asked") == F.col("first")) & F.expr("d is null and low < n"), "left")
    hit = hit.withColumn("m", F.when(F.col("first").isNotNull(), F.expr(agreed)))
    return hit.select(*kept, "m", "stop", "first").selectExpr(
        *pending.columns,
        "if(d is null and m < stop, first, exit) as exit",
        "coalesce(d, m, low) as d",
    )


def compacted(sequences: DataFrame) -> DataFrame:
    """Compacted nodes below the root (`start, stop, path`) of the trie of `seq, n, steps`, inserted in batches."""
    pending = written(sequences.where("n > 0").withColumn("dice", F.xxhash64("seq")), "trie-pending")
    longest = pending.agg(F.max("n")).first()[0]
    nodes = None
    while longest and not pending.isEmpty():
        if nodes is None:
            found = pending.withColumns({"exit": F.lit(None).cast("binary"), "d": F.lit(0)})
        else:
            found = written(_located(pending, nodes, int(longest).bit_length() + 1), "trie-located")
        leaving = found.where("d < n")
        # One of those that go on with the same turn; the digest tells the place as well.
        chosen = leaving.groupBy(F.expr("steps[d + 1].at").alias("turn")).agg(
            F.min_by(F.expr("struct(seq, d as start, n as stop, slice(steps, d + 1, n - d + 1) as path)"), F.struct("dice", "seq")).alias("c")
        )
        chosen = written(chosen.select("c.*"), "trie-chosen")
        edges = chosen.select("start", "stop", "path")
        if nodes is not None:
            cuts = found.where("exit is not null").groupBy(F.col("exit").alias("first")).agg(F.array_sort(F.collect_set("d")).alias("cuts"))
            bounds = F.expr("concat(array(start), coalesce(cuts, array()), array(stop))")
            parts = nodes.join(cuts, "first", "left").withColumn("bounds", bounds)
            stretches = "transform(sequence(0, size(bounds) - 2), i -> struct(bounds[i] as start, bounds[i + 1] as stop))"
            parts = parts.selectExpr("start as a", "path as whole", f"inline({stretches})")
            parts = parts.selectExpr("start", "stop", "slice(whole, start - a + 1, stop - start + 1) as path")
            edges = parts.unionByName(edges)
        nodes = written(_as_nodes(edges), "trie-nodes")
        rest = leaving.join(chosen.select("seq"), "seq", "left_anti")
        pending = written(rest.select(*pending.columns), "trie-pending")
    if nodes is None:
        return sequences.selectExpr("0 as start", "n as stop", "steps as path").where("false")
    return nodes.select("start", "stop", "path")


def _summed(nodes: DataFrame) -> DataFrame:
    """Sums over subtrees of `node, parent, n_convs, conv_id, n_leaves, end_chars, edge_chars`, by doubling links."""
    sums = ["n_convs", "n_leaves", "end_chars", "edge_chars"]
    table = written(nodes.withColumn("above", F.col("parent")), "trie-sums")
    while not table.where("above is not null").isEmpty():
        below = table.where("above is not null").groupBy(F.col("above").alias("node")).agg(
            *[F.sum(c).alias(f"b_{c}") for c in sums], F.min("conv_id").alias("b_conv_id")
        )
        # Links from the root's own children end; so the root, where most links may meet, is not looked up.
        links = table.where("above is not null").select(F.col("node").alias("above"), F.col("above").alias("next"))
        table = table.join(below, "node", "left").join(links, "above", "left").select(
            "node", "parent", F.col("next").alias("above"),
            *[(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in sums],
            F.least("conv_id", "b_conv_id").alias("conv_id"),
        )
        table = written(table, "trie-sums")
    return table.drop("above")


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids per node (`node, conv_id`). A node's ids are sorted over many
    tasks, which join them to pieces; the pieces are then hashed one after the other."""

    def joined(batches):
        node, first, size, texts = None, None, 0, []
        rows = ([], [], [])

        def emit():
            for column, value in zip(rows, (node, first, ",".join(texts))):
                column.append(value)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["node", "first", "ids"])
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            for key, conv in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist()):
                if key != node or size > PIECE:
                    if texts:
                        emit()
                    node, first, size, texts = key, conv, 0, []
                texts.append(str(conv))
                size += len(texts[-1]) + 1
            yield flush()
        if texts:
            emit()
        yield flush()

    def hashed(batches):
        node, digest = None, None
        for batch in batches:
            done, hexes = [], []
            for key, ids in zip(batch["node"].to_pylist(), batch["ids"]):
                if key != node:
                    if digest:
                        done.append(node)
                        hexes.append(digest.hexdigest())
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(hexes, pa.string())], ["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ordered.mapInArrow(joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of `conv_id, turns`, a row per distinct beginning (see the module for the method).

    `node` (digest), `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens` (characters that members after the first need not hold again, over the subtree), `ends_sha256`.
    """
    schema = "conv_id long, seq binary, n int, steps array<struct<at: binary, chars: long, upto: long>>"
    chained = written(conversations.select("conv_id", "turns").mapInArrow(_chained, schema), "trie-chained")
    ends = chained.groupBy("seq").agg(F.count("*").alias("n_ends"), F.min("conv_id").alias("first_end"), F.first("n").alias("n"), F.first("steps").alias("steps"))
    ends = written(ends, "trie-sequences")
    edges = compacted(ends.select("seq", "n", "steps"))
    # The root is a node of its own, with an edge of no length.
    root = ends.limit(1).selectExpr("-1 as start", "0 as stop", "slice(steps, 1, 1) as path")
    own = edges.unionByName(root).selectExpr(
        "start", "stop", "path", "path[size(path) - 1].at as node", "if(start < 0, null, path[0].at) as parent",
        "path[size(path) - 1].upto as total", "path[size(path) - 1].upto - path[0].upto as edge_chars",
    )
    children = own.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    own = own.join(children, "node", "left").join(ends.select(F.col("seq").alias("node"), "n_ends", "first_end"), "node", "left")
    own = written(own.fillna({"n_children": 0, "n_ends": 0}), "trie-compacted")
    sums = _summed(
        own.selectExpr(
            "node", "parent", "n_ends as n_convs", "first_end as conv_id", "if(n_children = 0, 1L, 0L) as n_leaves",
            "n_ends * total as end_chars", "edge_chars",
        )
    )
    parents = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("above_conv_id"))
    hashes = _hashed_ids(chained.select(F.col("seq").alias("node"), "conv_id"))
    whole = own.drop("parent", "edge_chars").join(sums.withColumnRenamed("edge_chars", "edges"), "node").join(parents, "parent", "left").join(hashes, "node", "left")
    # Saved below the node: members' characters below it, less one copy of every edge below.
    below = "end_chars - n_convs * total - (edges - (total - path[0].upto))"
    expanded = whole.withColumn("saved", F.expr(below)).selectExpr("*", "posexplode(path) as (i, step)").where("start < 0 or i > 0")
    return expanded.selectExpr(
        "step.at as node",
        "conv_id",
        "cast(if(start < 0, 0, start + i) as long) as depth",
        "if(i > 1, conv_id, above_conv_id) as parent_conv_id",
        "n_convs",
        "if(step.at = node, n_children, 1L) as n_children",
        "n_leaves",
        "saved + (n_convs - 1) * (total - step.upto + step.chars) as saved_tokens",
        f"if(step.at = node and n_ends > 0, ends_sha256, '{hashlib.sha256(b'').hexdigest()}') as ends_sha256",
    )
