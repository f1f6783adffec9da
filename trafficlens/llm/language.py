"""Language of texts by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in windows of WINDOW bytes, which a network of gated recurrent units reads from both
ends (Cho et al. 2014: update gate, reset gate, candidate). Every position of a window is labelled with
probabilities of the languages from the two states there; a document's probabilities are their mean over all its
positions, and the most probable language is predicted.

The network is trained in numpy by backpropagation through time with Adam, on windows of a bounded, documented
sample: at most FIT_ROWS labelled texts, chosen by hash, about as many of each of the LANGUAGES most frequent
languages, and FIT_WINDOWS windows of each text, spread evenly over it. Its parameters are broadcast; their size depends on
HIDDEN and the number of languages only. Scoring reads every window of every text in one narrow stage.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled texts so is every
text; rows with a null label are not learnt from; ties go to the language of least name; repeated rows get
equal answers; columns named like a result are replaced, other columns pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT_ROWS = 4096
# Languages learnt: the most frequent ones.
LANGUAGES = 64
FIT_WINDOWS = 3
WINDOW = 64
HIDDEN = 12
# Steps of training, of MINIBATCH windows each, whatever the size of the sample.
STEPS = 264
MINIBATCH = 128
RATE = 0.01
# Windows scored at once: all arrays of a step stay in a core's cache.
BLOCK = 1024
UNKNOWN = "und"
_PAD = 256


@dataclass
class Model:
    languages: list[str]
    inputs: np.ndarray  # per direction, a row per byte and one for padding: update, reset, candidate
    states: np.ndarray  # per direction, HIDDEN x (update, reset, candidate)
    outputs: np.ndarray  # per direction, HIDDEN x languages
    bias: np.ndarray


def windows_of(text: bytes, width: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of `width`, the last one filled up with padding."""
    out = np.full(-(-len(text) // width) * width, _PAD, dtype=np.int16)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(-1, width)


def _fresh(languages: list[str], hidden: int) -> Model:
    rng = np.random.default_rng(11)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
    k = len(languages)
    return Model(languages, draw(2, _PAD + 1, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2, hidden, k), np.zeros(k, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def gradients(model: Model, rows: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of the windows `rows` and its gradients, by backpropagation through time."""
    n, width = rows.shape
    h3 = model.states.shape[2]
    size = h3 // 3
    # The second direction reads the window from its end; `live` is 0 at padding, where the state stays 0.
    steps = np.stack([rows.T, rows.T[::-1]], axis=1).astype(np.intp)  # place, direction, window
    live = (steps != _PAD)[..., None].astype(np.float32)
    state = np.zeros((width + 1, 2, n, size), np.float32)
    gates, inner = np.empty((width, 2, n, h3), np.float32), np.empty((width, 2, n, size), np.float32)
    sides = np.arange(2)[:, None]
    for t in range(width):
        given, held = model.inputs[sides, steps[t]], state[t] @ model.states
        gates[t, ..., : 2 * size] = _sigmoid(given[..., : 2 * size] + held[..., : 2 * size])
        inner[t] = held[..., 2 * size :]
        new = np.tanh(given[..., 2 * size :] + gates[t, ..., size : 2 * size] * inner[t])
        gates[t, ..., 2 * size :] = new
        state[t + 1] = (new + gates[t, ..., :size] * (state[t] - new)) * live[t]
    seen = np.stack([state[1:, 0], state[:0:-1, 1]], axis=1)  # both states at each place
    chance = _softmax(np.einsum("tdnh,dhk->tnk", seen, model.outputs, optimize=True) + model.bias)
    weight = live[:, 0] / live[:, 0].sum()
    loss = -float((np.log(np.maximum(chance[:, np.arange(n), label], 1e-12)) * weight[..., 0]).sum())
    error = chance
    error[:, np.arange(n), label] -= 1
    error *= weight
    d_outputs = np.einsum("tdnh,tnk->dhk", seen, error, optimize=True)
    back = np.einsum("tnk,dhk->tdnh", error, model.outputs, optimize=True)
    d_state = np.stack([back[:, 0], back[::-1, 1]], axis=1)
    d_states, d_given = np.zeros_like(model.states), np.empty_like(gates)
    carried = np.zeros((2, n, size), np.float32)
    turned = model.states.transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        update, reset, new = gates[t, ..., :size], gates[t, ..., size : 2 * size], gates[t, ..., 2 * size :]
        d = (carried + d_state[t]) * live[t]
        d_new = d * (1 - update) * (1 - new * new)
        own = d_given[t]
        own[..., :size] = d * (state[t] - new) * update * (1 - update)
        own[..., size : 2 * size] = d_new * inner[t] * reset * (1 - reset)
        own[..., 2 * size :] = d_new
        d_held = own.copy()
        d_held[..., 2 * size :] *= reset
        d_states += state[t].transpose(0, 2, 1) @ d_held
        carried = d * update + d_held @ turned
    d_inputs = np.empty_like(model.inputs)
    for side in range(2):
        symbol, own = steps[:, side].ravel(), d_given[:, side].reshape(-1, h3)
        for j in range(h3):
            d_inputs[side, :, j] = np.bincount(symbol, weights=own[:, j], minlength=_PAD + 1)
    return loss, [d_inputs, d_states, d_outputs, error.sum(axis=(0, 1))]


def train(rows: np.ndarray, label: np.ndarray, languages: list[str], *, hidden: int = HIDDEN, steps: int = STEPS) -> Model:
    """A network fitted to windows and the numbers of their languages."""
    model = _fresh(languages, hidden)
    weights = [model.inputs, model.states, model.outputs, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rng, order = np.random.default_rng(5), np.zeros(0, np.int64)
    for step in range(1, steps + 1 if len(rows) else 1):
        while len(order) < MINIBATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        part, order = order[:MINIBATCH], order[MINIBATCH:]
        _, found = gradients(model, rows[part], label[part])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        rate = RATE * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(weights, found, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


class Scorer:
    """Probabilities of windows. The gates' sigmoids are taken as tanh, with their weights halved beforehand; gates and
    candidates have arrays of their own, so that every step runs over contiguous memory."""

    def __init__(self, model: Model, block: int = BLOCK):
        self.size = size = model.states.shape[1]
        part = lambda x, a, b, by: np.ascontiguousarray(x[..., a * size : b * size] * np.float32(by))
        self.gate_inputs, self.new_inputs = part(model.inputs, 0, 2, 0.5), part(model.inputs, 2, 3, 1)
        self.gate_states, self.new_states = part(model.states, 0, 2, 0.5), part(model.states, 2, 3, 0.5)
        self.outputs, self.bias, self.block = model.outputs.transpose(0, 2, 1).copy(), model.bias, block

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the positions' probabilities of each window, a column per language."""
        return np.concatenate([self._block(rows[at : at + self.block]) for at in range(0, len(rows), self.block)])

    def _block(self, rows: np.ndarray) -> np.ndarray:
        n, width = rows.shape
        size = self.size
        places = np.ascontiguousarray(rows.T, dtype=np.intp)
        padded = (places == _PAD).any(axis=1)
        state, new, held = (np.zeros((2, n, size), np.float32) for _ in range(3))
        gate, given = (np.empty((2, n, 2 * size), np.float32) for _ in range(2))
        logits = np.empty((width, len(self.bias), n), np.float32)
        logits[:] = self.bias[:, None]
        for t in range(width):
            ends = (t, width - 1 - t)
            for side in range(2):
                np.take(self.gate_inputs[side], places[ends[side]], axis=0, out=given[side], mode="clip")
                np.take(self.new_inputs[side], places[ends[side]], axis=0, out=new[side], mode="clip")
            # One plus tanh is twice the gate: the candidate's states are halved, and so is the step below.
            np.matmul(state, self.gate_states, out=gate)
            gate += given
            np.tanh(gate, out=gate)
            gate += 1
            np.matmul(state, self.new_states, out=held)
            held *= gate[..., size:]
            new += held
            np.tanh(new, out=new)
            state -= new
            state *= 0.5
            state *= gate[..., :size]
            state += new
            for side in range(2):
                if padded[ends[side]]:
                    state[side][places[ends[side]] == _PAD] = 0
                logits[ends[side]] += self.outputs[side] @ state[side].T
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (places != _PAD)[:, None] / logits.sum(axis=1, keepdims=True)
        return logits.sum(axis=0, dtype=np.float64).T


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2


def _sample(docs: DataFrame, text_col: str, lang_col: str, rows: int, id_col: str) -> DataFrame:
    """Windows (`lang, parts`) of at most `rows` labelled texts, about as many of each language.

    The languages are counted first; a text is taken if its hash lies below its language's share. Texts are cut to
    windows where they are read, so no text moves.
    """
    known = docs.where(F.col(lang_col).isNotNull()).withColumn("_lang", F.col(lang_col).cast("string"))
    counts = known.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("_lang") == row["_lang"], F.lit(min(1.0, rows / len(counts) / row["n"]))).otherwise(share)
    dice = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    chosen = known.withColumn("turn", dice / F.nullif(share, F.lit(0.0))).where("turn < 1")

    def cut(batches):
        for batch in batches:
            parts = []
            for text in batch["text"].to_pylist():
                n = -(-len(text or b"") // WINDOW)
                starts = np.unique(np.linspace(0, n - 1, FIT_WINDOWS).astype(int)) if n else []
                parts.append([bytes(text[at * WINDOW : (at + 1) * WINDOW]) for at in starts])
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["turn"], pa.array(parts, pa.list_(pa.binary()))], ["lang", "turn", "parts"])

    texts = chosen.select(F.col("_lang").alias("lang"), "turn", F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(cut, "lang string, turn double, parts array<binary>").orderBy("turn", "lang", "parts").limit(rows)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learns from the documents whose id is not held out. The driver sees at most `rows` x FIT_WINDOWS windows."""
    learnt = docs.where(~F.coalesce(held_out(F.col(id_col)), F.lit(False)))
    found = _sample(learnt, text_col, lang_col, rows, id_col).toArrow().to_pylist()
    languages = sorted({r["lang"] for r in found if r["parts"]})
    pairs = [(languages.index(r["lang"]), part) for r in found for part in r["parts"]]
    windows = np.concatenate([windows_of(part) for _, part in pairs]) if pairs else np.zeros((0, WINDOW), np.int16)
    return train(windows, np.array([k for k, _ in pairs], dtype=np.int64), languages)


def identified(
    docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """`docs` with the predicted language of every whole text and its probability."""
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    given = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = Scorer(known)
        for batch in batches:
            chances = np.zeros((batch.num_rows, max(len(known.languages), 1)))
            asked, held, waiting = [], [], 0

            def score():
                windows = np.concatenate(held)
                row = np.repeat(asked, [len(h) for h in held])
                np.add.at(chances, row, scorer.sums(windows))

            sizes = np.ones(batch.num_rows)
            for i, text in enumerate(batch["_text"]):
                text = text.as_py()
                if not known.languages or not text or not any(map(str.isalpha, text)):
                    continue
                data = text.encode()
                sizes[i] = len(data)
                # A text longer than what is held at once is scored in parts.
                for at in range(0, len(data), WINDOW * 8 * BLOCK):
                    held.append(windows_of(data[at : at + WINDOW * 8 * BLOCK]))
                    asked.append(i)
                    waiting += len(held[-1])
                    if waiting >= 4 * BLOCK:
                        score()
                        asked, held, waiting = [], [], 0
            if held:
                score()
            chances /= sizes[:, None]
            best = chances.argmax(axis=1)
            names = [known.languages[k] if chances[i, k] > 0 else UNKNOWN for i, k in enumerate(best.tolist())]
            score_of = np.round(np.clip(chances[np.arange(len(best)), best], 0, 1), 6)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(names, pa.string()), pa.array(score_of, pa.float64())], [*kept, lang_col, score_col]
            )

    schema = T.StructType([*docs.select(kept).schema, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return given.mapInArrow(run, schema)
