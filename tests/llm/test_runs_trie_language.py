"""Periodic runs, prefix trie and language identification against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from compare import differences, duck
from trafficlens.llm import language, periodic_runs, prefix_trie
from trafficlens.llm.queries import ORACLE, REGISTRY

SMALL = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- periodic runs ---------------------------------------------------------------------------


def _longest_lyndon(x):
    out = []
    for i in range(len(x)):
        words = [x[i:j] for j in range(i + 1, len(x) + 1)]
        out.append(max(len(w) for w in words if all(w < w[k:] for k in range(1, len(w)))))
    return out


def _runs(x, min_length=6, power=4):
    """All maximal stretches, period by period; a stretch belongs to its smallest period."""
    found = {}
    for q in range(1, len(x) // power + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(min_length, power * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _pattern(rng):
    x = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 6))]
        x += unit * rng.choice([1, 1, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
    return x


def test_lyndon_arrays_equal_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 14))]
        assert periodic_runs.lyndon_array(x) == _longest_lyndon(x)


def test_runs_equal_brute_force():
    rng, met = random.Random(2), 0
    for _ in range(1500):
        x = _pattern(rng)
        want = _runs(x)
        met += len(want)
        assert periodic_runs.runs_of([b"%d" % v for v in x]) == want
    assert met > 2000


def test_odd_texts_have_defined_runs(spark):
    rows = [
        (1, None, "r"), (1, None, "r"), (2, "", "r"), (3, " \t\n\x0b\f\r", "r"), (None, "a\x0ba\fa a\na\ta", "r"),
        (4, "x" + " ab cd" * 40_000 + " y", "r"), (5, "a\u00a0b " * 12, "r"), (6, "Z " * 5, "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {
        (1, ""): [], (2, ""): [], (3, ""): [], (None, "a"): [(0, 6, 1)], (4, "x ab cd y"): [(1, 80_000, 2)],
        (5, "a\u00a0b"): [(0, 12, 1)], (6, "Z Z Z Z Z"): [],
    }
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op11_equals_brute_force(spark, tables, words):
    rng = random.Random(3)
    docs = [(i, words(rng.randint(0, 60), i)) for i in range(300)] + [(i, " ".join(map(str, _pattern(rng)))) for i in range(300, 500)]
    docs += [(900, None), (901, " \n"), (902, "a b " * 900), (903, words(4000, 9) + " ü" * 30)]
    tables.add(spark.createDataFrame(docs, "doc_id long, text string"), "documents")
    got = {r["doc_id"]: r.asDict() for r in REGISTRY["op11_periodic_runs"](spark, tables.path).collect()}
    planted = 0
    for doc_id, text in docs:
        x = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(x)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = _runs(x)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[1] * 1000 // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            "collapsed_sha256": sha(b" ".join(w for i, w in enumerate(x) if i not in dropped)),
        }
    assert planted > 20


# --- prefix trie -----------------------------------------------------------------------------


def _trie(conversations):
    """Nodes of {id: [(role, text), ...]}, every beginning listed."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    for node, who in members.items():
        leaf = all(node == tuple(conversations[c]) for c in who)
        for d in range(len(node) + 1):
            below[node[:d]][0] += leaf
            below[node[:d]][1] += (len(who) - 1) * len(node[-1][1]) if node else 0
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], *below[node],
         sha(",".join(str(c) for c in sorted(who) if tuple(conversations[c]) == node)))
        for node, who in members.items()
    )


def _nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _rows(spark, conversations):
    rows = [(c, i, role, text, "x") for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")


NAMES = {"key": "conv_id", "turn": "turn", "role": "role", "text": "text"}


def test_trie_equals_brute_force(spark):
    rng, conversations = random.Random(6), {}
    for c in range(250):
        start = conversations[rng.randrange(c)][: rng.randrange(6)] if c and rng.random() < 0.8 else []
        conversations[c] = start + [(rng.choice("ua"), "é" * rng.randrange(4)) for _ in range(rng.randint(1, 5))]
    # One first turn shared by a third, one long chain whose beginnings are conversations, ends inside edges.
    conversations.update({1000 + c: [("u", "hot"), ("a", str(c % 60))] for c in range(120)})
    chain = [("u", str(i)) for i in range(70)]
    conversations.update({2000 + d: chain[:d] for d in (70, 1, 2, 3, 5, 8, 13, 21, 34, 55, 69)})
    own = prefix_trie.conversations_of_rows(_rows(spark, conversations), **NAMES)
    assert _nodes(prefix_trie.prefix_trie(own)) == _trie(conversations)


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (None, 0, "u", "a"), (-5, 2, "u", "b"), (-5, None, "", ""),
        (7, 0, "", ""), (7, 1, "u", "a" * 100_000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: [("", ""), ("u", "a"), ("u", "a")], -5: [("", ""), ("u", "b")], 7: [("", ""), ("u", "a" * 100_000)]}
    own = prefix_trie.conversations_of_rows(table, **NAMES)
    assert _nodes(prefix_trie.prefix_trie(own)) == _trie(want)
    assert prefix_trie.prefix_trie(own.limit(0)).count() == 0
    turnless = own.selectExpr("conv_id", "slice(turns, 1, 0) as turns")
    assert _nodes(prefix_trie.prefix_trie(turnless)) == _trie({1: [], -5: [], 7: []})


def test_ids_are_hashed_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    ends = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 'a', concat('b', id % 7)) as binary) as node", "id * 37 % 3001 - 20 as conv_id")
    got = {bytes(r["node"]).decode(): r["ends_sha256"] for r in prefix_trie._hashed_ids(ends).collect()}
    want = defaultdict(list)
    for r in ends.collect():
        want[bytes(r["node"]).decode()].append(r["conv_id"])
    assert got == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}


def test_op12_rebuilds_conversations(spark, tables):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", None, "long " * 9])) for c in [*range(0, 40), *range(95, 260)] for t in range(rng.randint(1, 8))]
    tables.add(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conversations")
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    rebuilt = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    assert _nodes(REGISTRY["op12_prefix_trie"](spark, tables.path)) == _trie(rebuilt)


# --- languages -------------------------------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = language._fresh(list("abc"), 4)
    for name in ("inputs", "states", "outputs", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    rows = rng.integers(0, 256, (5, 7)).astype(np.int16)
    rows[0, 3:] = 256
    label = rng.integers(0, 3, 5)
    _, found = language.gradients(model, rows, label)
    for weights, gradient in zip((model.inputs, model.states, model.outputs, model.bias), found):
        places = np.argwhere(np.abs(gradient) > 1e-6)
        for place in map(tuple, places[rng.integers(0, len(places), 6)]):
            held, losses = weights[place], []
            for step in (1e-3, -1e-3):
                weights[place] = held + step
                losses.append(language.gradients(model, rows, label)[0])
            weights[place] = held
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(gradient[place], rel=0.02, abs=2e-5)


def _position_chances(model, row):
    """Probabilities of every position of one window, one unit after the other."""
    sides = []
    for side, symbols in enumerate((row, row[::-1])):
        state, states = np.zeros(model.states.shape[1]), []
        for symbol in symbols:
            size = len(state)
            given, held = model.inputs[side, symbol], state @ model.states[side]
            update, reset = (1 / (1 + np.exp(-(given[a : a + size] + held[a : a + size]))) for a in (0, size))
            new = np.tanh(given[2 * size :] + reset * held[2 * size :])
            state = (1 - update) * new + update * state if symbol != 256 else np.zeros(size)
            states.append(state)
        sides.append(states if not side else states[::-1])
    logits = [f @ model.outputs[0] + b @ model.outputs[1] + model.bias for f, b in zip(*sides)]
    return [np.exp(x) / np.exp(x).sum() for x, symbol in zip(logits, row) if symbol != 256]


def test_pooled_scores_equal_plain_loops(spark, documents):
    model = language._fresh(["de", "en", "fr"], 6)
    texts = {1: "Ein Satz über vieles. " * 9, 2: "x", 3: "", 4: None, 5: "123 ... \n", 6: "né", 7: "word " * 30_000, 8: "x", 9: "\U0001f600 漢"}
    table = documents([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(table, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    for i in (1, 2, 6, 8, 9):
        every = [p for row in language.windows_of(texts[i].encode()) for p in _position_chances(model, row)]
        mean = np.mean(every, axis=0)
        assert len(every) == len(texts[i].encode())
        assert got[i][0] == model.languages[int(mean.argmax())] and got[i][1] == pytest.approx(mean.max(), abs=1e-4)
    assert got[7][0] in model.languages and 0 < got[7][1] <= 1
    assert language.identified(table.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark, documents):
    model = language.fit(documents([(1, "text", None), (2, None, "en"), (3, "", "en")], "doc_id long, text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in language.identified(documents([(1, "text")]), model).collect()] == [("und", 0.0)]


def test_op13_is_right_on_held_out_texts(spark):
    found = REGISTRY["op13_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(lang) and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97


def test_labels_of_held_out_texts_are_not_used(spark, documents, words):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, words(20, i), "xx" if i in ids else "en") for i in range(400)]
    assert language.fit(documents(rows, "doc_id long, text string, lang string")).languages == ["en"]


def test_trie_query_equals_sql(spark):
    assert differences(REGISTRY["op12_prefix_trie"](spark, SMALL), duck(SMALL), ORACLE["op12_prefix_trie"]) is None
