"""Near-duplicate documents by DartMinHash.

Every shingle of a text is an element with its count as weight. The plane of weight and rank over an element
is cut into cells of area one, each with a hashed (Poisson) number of darts at hashed places. A text collects
the darts below its weights up to a rank that yields k ln k + 2k of them; each dart belongs to a hashed
coordinate, and the one of least rank is kept per coordinate. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. If a coordinate stays empty the rank is doubled.

Coordinates are joined in bands. Equal texts are folded first. In each bucket of a band every text is
compared with one of them, its centre (the one in the largest buckets), on their whole shingle multisets, so that
buckets of any size take linear work; where that leaves more than one component among the others of a bucket, the
texts outside the centre's component are compared with all, in blocks, by their sketches and then their shingles. Pairs that may be similar are verified on their whole
shingle multisets, and classes are the connected components of the verified links.

Defined cases: a null text is an empty one; texts without words are similar to equal texts only; equal texts
always share a class; rows without an id keep their rows; repeated rows are rows; rows of one id are told apart,
and of several classes with the same smallest id the first by text is named by it, the others, like classes without
an id, by a hash of their text; other columns are ignored; an empty table gives an empty result.
"""

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.row_ids import unique_ids, with_row_ids
from trafficlens.llm.shingles import SIMILAR, mix, occurrences, similarity, weighted, word_hashes
from trafficlens.session import written

BANDS, ROWS = 20, 5
# A pair within a block whose sketches agree in fewer coordinates is not verified: 5 standard deviations below 0.8.
AGREE = 0.6
# Texts to be verified up to which their ids are broadcast (8 bytes each); beyond, texts are dealt by id.
BROADCAST_IDS = 2_000_000
# Texts of a bucket compared in one task.
BLOCK = 1024
# Shingles whose darts are thrown together, and texts handed to Python at once.
TOGETHER, TEXTS = 200_000, 500
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


@contextmanager
def _small_batches(spark: SparkSession):
    """Batches hold arrays as long as texts: fewer rows each, for the jobs run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _part(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x ^ np.uint64(salt))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of repeated items."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _throw(element, weight, owner, reach, n_owners, k):
    """Earliest dart per owner and coordinate, 0 where there is none; `reach` is the rank limit of each owner."""
    levels = np.maximum(np.ceil(np.log2(weight + 1)), 1).astype(np.int64)
    of = np.repeat(np.arange(element.size), levels)
    level = _within(levels)
    cells = np.ceil(reach[owner[of]] * 2.0**level).astype(np.int64)
    of, level, rank_cell = np.repeat(of, cells), np.repeat(level, cells), _within(cells)
    seed = mix(element[of] + mix((level.astype(np.uint64) << np.uint64(48)) + rank_cell.astype(np.uint64) + np.uint64(1)))
    darts = np.searchsorted(_POISSON, _unit(_part(seed, 1)), side="right")
    nth = _within(darts).astype(np.uint64)
    of, level, rank_cell, seed = (np.repeat(x, darts) for x in (of, level, rank_cell, seed))
    dart = mix(seed + (nth + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    width = 2.0**level
    rank = (rank_cell + _unit(_part(dart, 2))) / width
    hit = (rank < reach[owner[of]]) & (width - 1 + width * _unit(_part(dart, 3)) < weight[of])
    of, rank, dart = of[hit], rank[hit], dart[hit]
    late_first = np.argsort(-rank, kind="stable")
    place = owner[of] * k + (_part(dart, 4) % np.uint64(k)).astype(np.int64)
    kept = np.zeros(n_owners * k, dtype=np.uint64)
    kept[place[late_first]] = dart[late_first]  # of equal places the last one stays, which is the earliest dart
    return kept.reshape(n_owners, k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of `k` dart numbers per weighted set (elements, weights); zeros for an empty set."""
    out = np.zeros((len(sets), k), dtype=np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(sets) if e.size], dtype=np.int64)
    wanted = k * math.log(k) + 2 * k
    reach = np.array([wanted / float(sets[i][1].sum()) for i in todo])
    while todo.size:
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(todo.size), [sets[i][0].size for i in todo])
        found = _throw(element, weight, owner, reach, todo.size, k)
        out[todo] = found
        short = (found == 0).any(axis=1)
        todo, reach = todo[short], reach[short] * 2
    return out


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for r in range(rows):
        h = mix(h + signature[:, r::rows][:, :bands])
    return h.view(np.int64)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        for batch in batches:
            column = batch["hashes"]
            flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOGETHER, side="right")) - 1)
                stop = min(stop, batch.num_rows)
                sets = [weighted(flat[ends[i] : ends[i + 1]]) for i in range(start, stop)]
                signature = signatures(sets, k)
                empty = [not s[0].size for s in sets]
                keys = [[] if e else row.tolist() for e, row in zip(empty, _bands(signature, bands, rows))]
                short = (signature & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(start, stop - start),
                        batch["text_key"].slice(start, stop - start),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["doc_id", "text_key", "bands", "sketch"],
                )
                start = stop

    return run


def _occurrences(batches):
    for batch in batches:
        coded = [occurrences(np.asarray(row.values)).view(np.int64) for row in batch["hashes"]]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(coded, pa.list_(pa.int64()))], ["node", "shingles"])


def _shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """`node, shingles` of the given nodes (distinct). `texts` has `node, text`."""
    asked = written(nodes, "near-asked")
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    whole = texts.join(asked, "node").select("node", word_hashes(F.col("text")).alias("hashes"))
    with _small_batches(whole.sparkSession):
        return written(whole.mapInArrow(_occurrences, "node long, shingles array<bigint>"), "near-shingles")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (`a`, `b`, `similarity`) among the pairs, on whole shingle multisets."""
    pairs = written(pairs, "near-pairs")
    shingles = _shingles(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)

    def compare(batches):
        for batch in batches:
            a, b = (batch[c] for c in ("sa", "sb"))
            found = [
                similarity(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)) for x, y in zip(a, b)
            ]
            scored = pa.array(found, pa.float64())
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], scored], ["a", "b", "similarity"])
            yield out.filter(pa.array([f >= threshold for f in found], pa.bool_()))

    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    with _small_batches(joined.sparkSession):
        return written(joined.mapInArrow(compare, "a long, b long, similarity double"), "near-links")


def _packed(batches):
    """Half of each shingle number, which takes half the room and decides all but the closest cases."""
    for batch in batches:
        short = [np.sort(np.asarray(r.values).view(np.uint64).astype(np.uint32)).tobytes() for r in batch["shingles"]]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(short, pa.binary())], ["node", "halves"])


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket that are similar, by half their shingle numbers, and belong to different components.

    `members` has `bucket, band, size, outside, node, component, main, bands, sketch, halves`: `outside` texts of the
    bucket are not in the component `main` of its centre. These are compared with all, block by block. A pair is
    compared in the first band it shares only, after its sketches; nothing but similar pairs leaves a block, and of
    those one for each text and component, besides pairs so near the threshold that halves cannot decide.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["bucket", "band", "node", "component", "bands", "sketch", "halves", "one", "side", "other"]
    out = members.where("component <> main")
    asking = out.withColumns({"side": F.lit(0), "one": own(F.col("outside"))}).withColumn("other", every(F.col("size")))
    asked = members.withColumns({"side": F.lit(1), "other": own(F.col("size"))}).withColumn("one", every(F.col("outside")))
    dealt = asking.select(columns).unionByName(asked.select(columns))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        band = int(group["band"].iloc[0])
        sides = [group[group["side"] == s] for s in (0, 1)]
        sketch = [np.frombuffer(b"".join(s["sketch"]), dtype=np.uint16).reshape(len(s), -1) for s in sides]
        bands = [np.stack(s["bands"].to_numpy())[:, :band] if len(s) else np.zeros((0, band)) for s in sides]
        halves = [[np.frombuffer(h, dtype=np.uint32) for h in s["halves"]] for s in sides]
        node, component = ([s[c].to_numpy() for s in sides] for c in ("node", "component"))
        found = []
        for i in range(len(sides[0])):
            met = (bands[1] == bands[0][i]).any(axis=1)
            near = ~met & (component[1] != component[0][i]) & ((sketch[1] == sketch[0][i]).mean(axis=1) >= AGREE)
            linked = set()
            for j in np.flatnonzero(near):
                if component[1][j] in linked:
                    continue
                alike = similarity(halves[0][i], halves[1][j])
                # Equal halves of different numbers, as a share of the numbers, with room to spare.
                doubt = 1e-3 + (halves[0][i].size + halves[1][j].size) * 2.0**-31
                if alike >= threshold - doubt:
                    found.append((node[0][i], node[1][j]))
                if alike >= threshold + doubt:
                    linked.add(component[1][j])
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    pairs = dealt.groupBy("bucket", "one", "other").applyInPandas(compare, "a long, b long")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, threshold: float = SIMILAR, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`doc_id, class_id` per row of `docs`: the class is named by its smallest id."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if unique_ids(given, "doc_id"):
        return _classes(given, threshold, bands, rows)
    # Rows are told by numbers of their own, and classes named by ids afterwards.
    keyed = with_row_ids(given)
    found = _classes(keyed.select(F.col("_row").alias("doc_id"), "text"), threshold, bands, rows)
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key")
    found = found.withColumnRenamed("doc_id", "_row").join(keyed.select("_row", "doc_id", key), "_row")
    found = written(found.drop("_row"), "near-found")
    # An id may be the smallest of several classes: the first of them by text has it.
    names = found.groupBy("class_id").agg(F.min("doc_id").alias("name"), F.min("text_key").alias("least"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("least"))
    by_id = F.col("name").isNotNull() & (turn == 1)
    names = names.select("class_id", F.when(by_id, F.col("name")).otherwise(F.xxhash64("least")).alias("named"))
    return found.join(names, "class_id").select("doc_id", F.col("named").alias("class_id"))


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """`doc_id, class_id` of rows (`doc_id, text`) with ids of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(
        "doc_id", F.md5(text.cast("binary")).alias("text_key"), word_hashes(text).alias("hashes")
    )
    schema = "doc_id long, text_key string, bands array<bigint>, sketch binary"
    with _small_batches(docs.sparkSession):
        sketched = written(given.mapInArrow(_sketch(bands, rows), schema), "near-sketches")
    folded = sketched.groupBy("text_key").agg(
        F.min("doc_id").alias("node"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    nodes = written(folded, "near-nodes")

    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    # The centre of a bucket is the text whose buckets are the largest: it agrees with most of the others.
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(placed.join(sizes, "bucket"), "near-shared")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    first = F.max(F.struct("company", F.xxhash64("node").alias("order"), F.col("node").alias("node")))
    placed = written(shared.join(company, "node"), "near-placed")
    centres = placed.groupBy("bucket").agg(first["node"].alias("centre"))
    members = written(placed.drop("company").join(centres, "bucket"), "near-buckets")

    stars = members.where("node <> centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
    texts = docs.select(F.col("doc_id").alias("node"), text.alias("text"))
    links = _verified(stars.distinct(), texts, threshold)
    joined = written(components(links), "near-components")

    rest = written(_unsettled(members, joined), "near-rest")
    halves = _shingles(rest.select("node").distinct(), texts).mapInArrow(_packed, "node long, halves binary")
    open_nodes = nodes.select("node", "bands", "sketch").join(halves, "node")
    similar = written(_across(rest.join(open_nodes, "node"), threshold), "near-across")
    more = _verified(similar, texts, threshold)
    both = links.select("a", "b").unionByName(more.select("a", "b"))
    final = components(both)
    classes = nodes.select("text_key", "node").join(final, "node", "left")
    named = classes.select("text_key", F.coalesce("component", "node").alias("class_id"))
    result = sketched.select("doc_id", "text_key").join(named, "text_key")
    return result.select("doc_id", "class_id")


def _unsettled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets in which more than the centre's own comparisons are open."""
    part = members.where("size > 2").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    at_centre = F.col("node") == F.col("centre")
    beside = F.when(~at_centre, F.col("component"))
    main = F.max(F.when(at_centre, F.col("component")))
    per = part.groupBy("bucket").agg(
        main.alias("main"), F.min(beside).alias("_least"), F.max(beside).alias("_most")
    )
    per = per.where("_least <> _most").drop("_least", "_most")
    kept = written(part.join(per, "bucket"), "near-unsettled")
    out = kept.where("component <> main").groupBy("bucket").agg(F.count("*").alias("outside"))
    # The centre has been compared with all of them.
    others = kept.join(out, "bucket").where("node <> centre")
    return others.select("bucket", "band", "size", "outside", "node", "component", "main")
