"""Quality scores by nearest-neighbour voting in a latent semantic space.

Labelled texts (a bounded sample, see FIT_ROWS) are hashed, weighted by tf-idf and reduced by a randomized
singular value decomposition. Their latent vectors, with the projection, are broadcast: their number and
width are parameters, so their size does not grow with the data. For every document the cosines with all of
them are computed in blocks of documents, and the labels of the nearest ones vote with their cosine.

Defined cases: null and empty texts, and texts without tokens known to the model, get the mean label of the
sample; without labelled rows every score is 0.5; labels of a document that differ are averaged; rows with a
null label are left out; ties among neighbours are decided by their order in the sample; an existing column
of the score's name is replaced, other columns pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.features import BUCKETS, Hasher

# Labelled documents the model is fitted on and votes with, at most: those of least hashed id.
FIT_ROWS = 4096
DIMENSIONS = 32
NEIGHBOURS = 25
BLOCK = 256
THRESHOLD = 0.3


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray  # a row per bucket
    vectors: np.ndarray  # a unit row per labelled text
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if self.labels.size else 0.5

    def vector(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(count)) * self.idf[place]
        return weight @ self.projection[place]

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(vectors, axis=1)
        out = np.full(len(vectors), self.prior)
        known = np.flatnonzero(size > 1e-9)
        if not known.size or not self.labels.size:
            return out
        cosine = (vectors[known] / size[known, None]) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0)
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        out[known] = np.where(total > 0, voted, self.prior)
        return np.round(np.clip(out, 0, 1), 6)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, Column], rows: int, id_col: str = "doc_id", text_col: str = "text"):
    """At most `rows` labelled texts (`text` and the named label columns), by least hashed id. The ids are
    chosen from the label table alone, so only the chosen texts move."""
    means = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    chosen = means.dropna(subset=list(columns)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # At most `rows` ids, two numbers each.
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).drop("doc_id")


def hashed_rows(sample: DataFrame, names: list[str]) -> list[dict]:
    """The sample as bucket counts, for the driver: bounded by the sample's rows and the number of buckets. Buckets and
    counts are views of the arrays they arrive in."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            places, counts, sizes = [], [], []
            for text in batch["text"].to_pylist():
                place, count, n = hasher.counts(text)
                merged = np.bincount(place, weights=count, minlength=BUCKETS) if place.size else np.zeros(BUCKETS)
                at = np.flatnonzero(merged)
                places.append(at.astype(np.int32))
                counts.append(merged[at].astype(np.float32))
                sizes.append(n)
            columns = [batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), pa.array(sizes, pa.int64())],
                [*names, "place", "count", "tokens"],
            )

    schema = ", ".join(f"{n} double" for n in names) + ", place array<int>, count array<float>, tokens long"
    found = sample.mapInArrow(run, schema).toArrow().combine_chunks()
    columns = {n: found[n].to_pylist() for n in [*names, "tokens"]}
    for n in ("place", "count"):
        parts = [c for c in found[n].chunks if len(c)]
        columns[n] = [v for c in parts for v in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])]
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


def _decompose(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, as columns, by random projection."""
    width = min(dimensions + 16, *x.shape)
    basis = x @ np.random.default_rng(7).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x @ (x.T @ basis))
    _, _, right = np.linalg.svd(basis.T @ x, full_matrices=False)
    return right[:dimensions].T.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> Model:
    """Learns from labels whose id is not held out."""
    learnt = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
    found = hashed_rows(labelled_sample(docs, learnt, {"label": F.col(label)}, rows), ["label"])
    target = np.array([r["label"] for r in found], dtype=np.float64)
    x = np.zeros((len(found), BUCKETS), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, r["place"]] = 1 + np.log(r["count"])
    if not len(found):
        return Model(np.ones(BUCKETS), np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros((0, 1)), target)
    texts_with = np.bincount(np.concatenate([r["place"] for r in found]), minlength=BUCKETS)
    idf = np.log((1 + len(found)) / (1 + texts_with)) + 1
    x *= idf.astype(np.float32)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]  # no second matrix of squares
    x /= np.where(size > 0, size, 1)
    projection = _decompose(x, dimensions)
    vectors = x @ projection
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    keep = size[:, 0] > 1e-9
    return Model(idf, projection, (vectors / np.where(size > 0, size, 1))[keep], target[keep])


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of every whole text."""
    kept = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), shared.value
        for batch in batches:
            texts, out = batch[text_col], []
            for start in range(0, batch.num_rows, BLOCK):
                block = texts.slice(start, BLOCK).to_pylist()
                vectors = np.zeros((len(block), known.projection.shape[1]))
                for i, text in enumerate(block):
                    place, count, _ = hasher.counts(text)
                    if place.size:
                        vectors[i] = known.vector(place, count)
                out.append(known.scores(vectors))
            score = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), score], [*kept, score_col])

    schema = T.StructType([*docs.select(kept).schema, T.StructField(score_col, T.DoubleType())])
    return docs.select(kept).mapInArrow(run, schema)
