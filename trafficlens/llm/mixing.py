"""Rates of documents that bring the token totals of domains to target weights.

Domains are told by labels. A softmax classifier, fitted on a bounded sample of labelled texts (see FIT_ROWS),
gives every document a soft membership in each domain. Nonnegative rates are then fitted by projected
gradient least squares, so that the expected tokens of each domain (sum of rate, tokens and membership) match
the targets. The gradient is scaled by a document's tokens and, across domains, by the inverse of the matrix
that says how totals move with it (over rates not at zero). A document's rate then depends only on its
memberships and on the steps so far, one number per domain and step, so that no step has to store rates: each
goes once over the memberships, and only sums per domain and pair of domains reach the driver.

A rate says how often a document is used in the mix: its whole part, and once more with the probability of
the rest, decided by a hash of the row.

Defined cases: null and empty texts have no tokens and the mean membership of the sample; a domain without
labelled rows or without tokens keeps no target, and the others share its weight; without any labels all
rates are one; repeated rows get equal rates and copies; existing columns of the result's names are replaced.
"""

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.features import BUCKETS, Hasher
from trafficlens.llm.quality import hashed_rows, labelled_sample
from trafficlens.session import written

FIT_ROWS = 4096
FIT_STEPS, DECAY = 200, 1e-5
# The fit ends when every domain is this close to its target, relative to all tokens, or after so many steps.
CLOSE, STEPS = 1e-4, 60


@dataclass
class Domains:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per bucket, a column per domain
    bias: np.ndarray
    prior: np.ndarray

    def memberships(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.tile(self.prior, (len(rows), 1))
        for i, (place, count) in enumerate(rows):
            if place.size:
                value = (1 + np.log(count)) * self.idf[place]
                logit = value @ self.weights[place] / np.linalg.norm(value) + self.bias
                out[i] = np.exp(logit - logit.max())
        return out / out.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: dict[str, str], *, rows: int = FIT_ROWS) -> Domains:
    """`domains`: name to an SQL condition on rows of `labels`; the first that holds is the domain."""
    names = list(domains)
    case = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names))):
        case = F.when(F.expr(domains[name]), i).otherwise(case)
    told = labels.withColumn("_domain", case).where(F.col("_domain").isNotNull())
    shares = {f"d{i}": (F.col("_domain") == i).cast("double") for i in range(len(names))}
    found = hashed_rows(labelled_sample(docs, told, shares, rows), list(shares))
    target = np.array([[r[s] for s in shares] for r in found], dtype=np.float32).reshape(len(found), len(names))
    if not len(found):
        k = len(names)
        return Domains(names, np.ones(BUCKETS), np.zeros((BUCKETS, k)), np.zeros(k), np.full(k, 1 / k))
    prior = target.mean(axis=0).astype(np.float64)
    told = [i for i, r in enumerate(found) if len(r["place"])]
    target = target[told]
    place = np.concatenate([np.array(found[i]["place"], dtype=np.int64) for i in told] or [np.zeros(0, dtype=np.int64)])
    value = np.concatenate([1 + np.log(found[i]["count"].astype(np.float64)) for i in told] or [np.zeros(0)])
    idf = np.log((1 + len(found)) / (1 + np.bincount(place, minlength=BUCKETS))) + 1
    weights, bias = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    if not told:
        return Domains(names, idf, weights, np.log(np.maximum(prior, 1e-9)), prior)
    counts = np.array([len(found[i]["place"]) for i in told])
    start, row = np.cumsum(counts) - counts, np.repeat(np.arange(len(told)), counts)
    value *= idf[place]
    value /= np.sqrt(np.add.reduceat(value**2, start))[row]
    times = lambda w: np.add.reduceat(value[:, None] * w[place], start)
    back = lambda e: np.stack([np.bincount(place, value * e[row, k], BUCKETS) for k in range(e.shape[1])], axis=1)
    along = np.ones((BUCKETS, 1))
    for _ in range(20):  # the largest curvature of the squares, by power iteration
        along = back(times(along))
        along /= np.linalg.norm(along)
    step = 2 * len(told) / max(float(np.linalg.norm(times(along))) ** 2, 1.0)
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(FIT_STEPS):  # accelerated gradient
        error = (_softmax(times(ahead) + ahead_bias) - target) / len(told)
        new, new_bias = ahead - step * (back(error) + DECAY * ahead), ahead_bias - error.sum(axis=0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, following
    return Domains(names, idf, weights, bias, prior)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def with_memberships(docs: DataFrame, model: Domains, *, text_col: str = "text") -> DataFrame:
    """`docs` with `tokens` and `memberships`, in the order of the model's domains."""
    kept = [c for c in docs.columns if c not in ("tokens", "memberships")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher, known = Hasher(), shared.value
        for batch in batches:
            rows = [hasher.counts(t.as_py()) for t in batch[text_col]]
            member = known.memberships([r[:2] for r in rows])
            columns = [*(batch[c] for c in kept), pa.array([r[2] for r in rows], pa.int64()), pa.array(list(member), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "tokens", "memberships"])

    added = [T.StructField("tokens", T.LongType()), T.StructField("memberships", T.ArrayType(T.DoubleType()))]
    return docs.select(kept).mapInArrow(run, T.StructType([*docs.select(kept).schema, *added]))


def _rates(member: np.ndarray, pulls: np.ndarray) -> np.ndarray:
    """Rates after the steps with `pulls`, a row per step: what membership in each domain takes off the rate."""
    rate = np.ones(len(member))
    for pull in pulls:
        rate = np.maximum(rate - member @ pull, 0)
    return rate


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def fit_rates(members: DataFrame, weights: list[float], *, budget: float | None = None, close: float = CLOSE, steps: int = STEPS) -> np.ndarray:
    """The pulls of the steps up to the one of least error, with a warning if that misses a target. `weights`: target share of tokens per domain; `budget`: tokens of the mix
    (default: all tokens there are)."""
    width = len(weights)

    def totals(pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per domain at the rates so far, and how they change with a pull, by pairs of domains."""

        def run(batches):
            for batch in batches:
                member = _matrix(batch["memberships"], width)
                tokens = np.asarray(batch["tokens"])
                rate = _rates(member, pulls)
                total = (tokens * rate) @ member
                moving = (member * (tokens * (rate > 0))[:, None]).T @ member
                yield pa.RecordBatch.from_arrays([pa.array([np.append(total, moving)], pa.list_(pa.float64()))], ["sums"])

        part = members.select("tokens", "memberships").mapInArrow(run, "sums array<double>")
        row = part.agg(*[F.sum(F.col("sums")[i]) for i in range(width + width**2)]).first()
        sums = np.array([v or 0.0 for v in row])
        return sums[:width], sums[width:].reshape(width, width)

    now, moving = totals(np.zeros((0, width)))
    whole = now.sum()
    has = now > whole * 1e-9
    share = np.where(has, np.array(weights, dtype=float), 0)
    if whole <= 0 or share.sum() <= 0:
        return np.zeros((0, width))
    target = share / share.sum() * (budget if budget is not None else whole)
    pulls, size, error, least, best = np.zeros((0, width)), 1.0, np.inf, np.inf, 0
    for step in range(steps + 1):
        off = np.abs(np.where(has, now - target, 0)).max()
        if off < least:
            least, best = off, step
        if off <= close * whole or step == steps:
            break
        size, error = (size / 2 if off >= error else min(1.0, 2 * size)), off
        ridge = 1e-9 * whole * np.eye(width)
        pull = size * np.linalg.solve(moving + ridge, np.where(has, now - target, 0))
        pulls = np.vstack([pulls, pull])
        now, moving = totals(pulls)
    if least > close * whole:
        warnings.warn(f"rates miss a target by {least / whole:.2g} of all tokens after {len(pulls)} steps", stacklevel=2)
    return pulls[:best]


def with_rates(members: DataFrame, pulls: np.ndarray) -> DataFrame:
    kept = [c for c in members.columns if c != "rate"]
    width = pulls.shape[1]

    def run(batches):
        for batch in batches:
            rate = _rates(_matrix(batch["memberships"], width), pulls)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(rate, pa.float64())], [*kept, "rate"])

    return members.select(kept).mapInArrow(run, T.StructType([*members.select(kept).schema, T.StructField("rate", T.DoubleType())]))


def mixed(
    docs: DataFrame, labels: DataFrame, domains: dict[str, str], weights: list[float], *,
    budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` with `tokens`, `memberships`, `rate` and `copies`, how often the mix takes the row."""
    model = fit_domains(docs, labels, domains)
    members = written(with_memberships(docs, model, text_col=text_col), "mix-memberships")
    rated = with_rates(members, fit_rates(members, weights, budget=budget))
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), F.lit(1 << 20)) / (1 << 20)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
