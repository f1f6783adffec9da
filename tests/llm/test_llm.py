"""The pipeline's operators against brute force, SQL and exact round trips, on small tables."""

import hashlib
import math
import pathlib
import random
import shutil
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import differences, duck
from trafficlens.llm import ann, chat, components, decontaminate, minhash, mixing, quality, sharding, suffix_dedup, token_counts, warc
from trafficlens.llm.queries import ORACLE, REGISTRY

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- queries ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(REGISTRY[name](spark, SMALL), duck(SMALL), ORACLE[name]) is None


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in REGISTRY if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in REGISTRY


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op7_chat_formatting", "op8_sharding"])
def test_native_plans_hold_no_python(spark, name):
    plan = REGISTRY[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# --- near duplicates -------------------------------------------------------------------------


def _shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def _weighted_jaccard(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _classes(texts):
    """Smallest id of each component, all pairs compared."""
    ids, sets, up = list(texts), {d: _shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (texts[a] or "") == (texts[b] or "") or _weighted_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


def _edited(text, seed, times):
    rng, w = random.Random(seed), text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, documents, words):
    base = words(150, 1)
    texts = {i: _edited(base, i, i % 7) for i in range(120)}
    texts |= {200 + i: words(20 + i, 50 + i) for i in range(40)}
    texts |= {300: "", 301: None, 302: "   ", 303: "a b", 304: "a b", 305: "x " * 5000, 306: "x " * 5001, 307: base}
    extra = documents([(i, t, "near") for i, t in texts.items()], "doc_id long, text string, class_id string")
    assert dict(rows(minhash.near_duplicates(extra))) == _classes(texts)


def test_a_pair_short_of_the_threshold_does_not_hide_a_link(spark):
    """One text asks a component whose members are at 0.7995 but for one at 0.82, wherever that one comes."""
    halves = lambda shared, own: np.r_[np.arange(shared), 10**6 * (own + 1) + np.arange(200)].astype(np.uint32).tobytes()
    sketch, bands = bytes(200), list(range(20))
    rest = [(2 + i, 1, halves(1599, i)) for i in range(30)] + [(50, 1, halves(1640, 40))] + [(60 + i, 1, halves(1599, 50 + i)) for i in range(30)]
    members = [(0, 100, np.arange(1800).astype(np.uint32).tobytes()), *rest]
    table = spark.createDataFrame(
        [(7, 0, len(members), 1, n, c, 1, bands, sketch, h) for n, c, h in members],
        "bucket long, band int, size long, outside long, node long, component long, main long, bands array<bigint>, sketch binary, halves binary",
    )
    assert (50, 0) in rows(minhash._across(table.coalesce(1), 0.8))


def test_a_text_is_verified_with_its_centre_whatever_the_sketches_say(spark, documents, words, monkeypatch):
    """No sketch agrees in more than all coordinates: what is linked was not asked for its sketch."""
    monkeypatch.setattr(minhash, "AGREE", 1.1)
    base = words(150, 1)
    got = dict(rows(minhash.near_duplicates(documents([(1, base), (2, _edited(base, 3, 2)), (3, words(90, 7))]))))
    assert got == {1: 1, 2: 1, 3: 3}


def test_sketches_refuse_no_more_than_five_deviations():
    assert minhash.AGREE <= 0.8 - 5 * math.sqrt(0.8 * 0.2 / (minhash.BANDS * minhash.ROWS)) + 1e-9


def test_near_duplicates_of_odd_rows(spark, documents):
    got = rows(minhash.near_duplicates(documents([(1, "one two three"), (1, "one two three"), (None, "one two three"), (None, None)])))
    assert [c for d, c in got if d == 1] == [1, 1] and len(got) == 4
    assert rows(minhash.near_duplicates(documents([]))) == []


def test_dart_collisions_follow_weighted_similarity():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    one, two = minhash.signatures([(names, a), (names, b)], 4000)
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert dict(rows(components.components(links))) == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- decontamination -------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_equals_brute_force(spark, documents, words, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = {i: words(12 + 3 * i, 900 + i) for i in range(8)} | {50: "too short", 51: None, 52: ""}
    docs = {i: words(80, 700 + i) for i in range(12)}
    for i in range(8):
        before, after = words(30, i), words(40, 99 + i)
        docs[100 + i] = f"{before} {items[i]} {after}"
        docs[200 + i] = f"{before} {_edited(items[i], i, 1)} {after}".upper()
    docs |= {300: items[3], 301: None, 302: "", 303: " ".join(items[4].split()[:-1])}
    want = {}
    for d, t in docs.items():
        w = (t or "").lower().split()
        for i, x in items.items():
            n, item = len((x or "").split()), _shingles(x)
            if n >= 5 and len(w) >= 5:
                best = max(_weighted_jaccard(_shingles(" ".join(w[s : s + n])), item) for s in range(max(1, len(w) - n + 1)))
                if best >= 0.8:
                    want[d, i] = round(best, 9)
    table = documents([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.contaminated(table, bench).select("doc_id", "item_id", "similarity")
    assert {(d, i): round(s, 9) for d, i, s in rows(found)} == want and len(want) >= 9
    assert rows(decontaminate.contaminated(documents([]), bench)) == []
    assert rows(decontaminate.contaminated(table, bench.limit(0))) == []


def test_dealt_windows_are_those_of_broadcast_items(spark, documents, words, monkeypatch):
    items = spark.createDataFrame([(1, words(20, 1)), (2, words(35, 2)), (2, words(20, 1))], "item_id long, text string")
    leak = f"{words(30, 5)} {words(20, 1)} {words(9, 6)} {words(35, 2)}"
    docs = documents([(1, leak), (1, words(50, 8)), (None, leak), (2, leak), (2, leak), (3, None), (4, "")])
    whole = decontaminate.contaminated(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    dealt = decontaminate.contaminated(docs, items)
    assert Counter(dealt.collect()) == Counter(whole) and {r["doc_id"] for r in whole} == {1, 2, None}


def test_blocks_find_every_pair_within_the_radius_and_few_others(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rng.getrandbits(64) for _ in range(40)]
    near = []
    for x in items:
        for _ in range(5):
            y = x
            for bit in rng.sample(range(64), decontaminate.RADIUS):
                y ^= 1 << bit
            near.append(y)
    far = [rng.getrandbits(64) for _ in range(200)]
    theirs = spark.createDataFrame([(i, 30, 26, signed(x)) for i, x in enumerate(items)], "item_id long, n_words int, shingles long, print long")
    schema = "content long, n_words int, shingles long, print long"
    ours = spark.createDataFrame([(i, 30, 26, signed(x)) for i, x in enumerate(near + far)], schema)
    met = decontaminate._met(ours, theirs, decontaminate.RADIUS).toPandas()
    want = {(c, i) for c, y in enumerate(near + far) for i, x in enumerate(items) if (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert {(c, i) for c, i, d in zip(met["content"], met["item_id"], met["apart"]) if d <= decontaminate.RADIUS} == want
    assert len(want) >= 200 and len(met[met["content"] >= len(near)]) < 0.2 * len(far) * len(items)


def test_passages_with_moved_parts_are_found(spark, documents, words):
    items = {1: words(60, 41), 2: words(90, 42), 3: "so it is and " * 9 + words(40, 43)}
    part = lambda i, *cuts: " ".join(" ".join(items[i].split()[a:b]) for a, b in cuts)
    docs = {
        10: f"{words(50, 1)} {part(1, (30, 60), (0, 30))} {words(50, 2)}",
        11: part(1, (30, 60), (0, 30)),
        12: f"{words(7, 3)} {part(2, (60, 90), (30, 60), (0, 30))}",
        13: f"{part(3, (40, 80), (0, 40))} {words(9, 4)}",
        14: f"{words(20, 5)} {part(1, (0, 20), (40, 60))} {words(20, 6)}",
        15: f"{words(20, 7)} {items[2]} {words(20, 8)}",
    }
    want = {}
    for d, t in docs.items():
        w = t.lower().split()
        for i, x in items.items():
            n, item = len(x.split()), _shingles(x)
            best = max(_weighted_jaccard(_shingles(" ".join(w[s : s + n])), item) for s in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = rows(decontaminate.contaminated(documents(list(docs.items())), bench))
    assert {(r[0], r[1]): round(r[4], 9) for r in found} == want and {d for d, _ in want} >= {10, 11, 12, 13, 15}
    assert [r[2] for r in found if r[0] == 15] == [20]


# --- trained models --------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    scored = REGISTRY["op3_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert scored["score"].between(0, 1).all() and len(scored) == 1000
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    good, bad = both[both["quality"] == 1]["score"].to_numpy(), both[both["quality"] == 0]["score"].to_numpy()
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert auc > 0.9 and (good >= quality.THRESHOLD).mean() > 0.95


def test_quality_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0)], "doc_id long, quality int")
    docs = documents([(1, "fine words here", "a"), (2, "bad | bad | bad", "b"), (3, None, "c"), (None, "", "d")], "doc_id long, text string, score string")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert got[3] == got[None] == model.prior
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(documents([]), model).count() == 0


def test_mix_meets_its_targets(spark):
    mix = REGISTRY["op5_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    total = mix["tokens"].sum()
    for name, share in {"toxic": 0.01, "good": 0.97, "poor": 0.02}.items():
        assert abs((mix["tokens"] * mix[f"p_{name}"] * mix["rate"]).sum() / total - share) < 0.001
    assert (mix["rate"] >= 0).all() and abs(mix["copies"].mean() - mix["rate"].mean()) < 0.1


def test_rates_equal_a_local_solution(spark):
    rng = np.random.default_rng(3)
    member, tokens = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(t), m.tolist()) for t, m in zip(tokens, member)], "tokens long, memberships array<double>")
    pulls = mixing.fit_rates(table, [0.6, 0.3, 0.1])
    reached = (tokens * mixing._rates(member, pulls)) @ member / tokens.sum()
    assert np.allclose(reached, [0.6, 0.3, 0.1], atol=2e-4)


def test_rates_that_miss_a_target_say_so_and_are_the_best_found(spark):
    """No document is nearly of one domain, so the targets are out of reach; more steps never end up worse."""
    rng = np.random.default_rng(3)
    member, tokens = rng.dirichlet([5.0, 5.0, 5.0], 40), rng.integers(1, 500, 40)
    table = spark.createDataFrame([(int(t), m.tolist()) for t, m in zip(tokens, member)], "tokens long, memberships array<double>").coalesce(1)
    want, errors = np.array([0.998, 0.001, 0.001]), []
    for steps in (0, 2, 5):
        with pytest.warns(UserWarning, match="miss a target"):
            pulls = mixing.fit_rates(table, want.tolist(), steps=steps)
        errors.append(np.abs((tokens * mixing._rates(member, pulls)) @ member / tokens.sum() - want).max())
    assert errors == sorted(errors, reverse=True)


def test_mix_of_odd_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, None), (2, ""), (None, "some words"), (2, "")])
    got = mixing.mixed(docs, labels, {"good": "quality = 1", "poor": "quality = 0"}, [0.5, 0.5]).collect()
    assert len(got) == 4 and all(r["rate"] == 1 and r["copies"] == 1 for r in got)
    assert mixing.mixed(documents([]), labels, {"good": "quality = 1"}, [1.0]).count() == 0


# --- nearest neighbours ----------------------------------------------------------------------


def _brute(vectors, asked, k):
    out = {}
    for q in asked:
        scored = sorted((-float((np.array(vectors[q]) * np.array(v)).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 70])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.standard_normal(6) * rng.uniform(0.1, 3)).tolist() for i in range(300)}
    vectors |= {i: vectors[7] for i in range(300, 360)}
    odd = [(1000, None), (1001, [0.0] * 6), (1002, [math.nan] * 6), (1003, [1.0, None] + [1.0] * 4), (1004, [1.0]), (1005, [math.inf] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame([*vectors.items(), *odd, (3, vectors[3])], "vec_id long, embedding array<double>")
    found = ann.nearest(table, queries=F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard_rows=shard_rows, leaf_rows=8).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == _brute(vectors, [i for i in vectors if i % 20 == 0], 20)


def test_recall_and_small_tables(spark):
    found = REGISTRY["op4_nearest_neighbours"](spark, SMALL).toPandas()
    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    vectors = {int(i): np.asarray(v, dtype=np.float64) for i, v in zip(table["vec_id"], table["embedding"])}
    want = _brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = found.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) > 0.95
    tiny = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert rows(ann.nearest(tiny, queries=F.col("vec_id") == 0, k=20)) == [(0, 1, 1, 0.5)]
    assert ann.nearest(tiny.limit(0), queries=F.lit(True), k=3).count() == 0


# --- repeated passages -----------------------------------------------------------------------


def _without_repeats(texts):
    data = {d: (t or "").encode() for d, t in texts.items()}
    n = suffix_dedup.LENGTH
    seen = Counter(b[i : i + n] for b in data.values() for i in range(len(b) - n + 1))
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def _passages(words):
    shared, other = words(90, 1), words(70, 2)
    texts = {i: f"{words(30 + i, 10 + i)} {shared} {words(20, 60 + i)}" for i in range(12)}
    texts |= {20 + i: f"{other[i:]} {words(15, 90 + i)} {other}" for i in range(4)}
    texts |= {40: "é" * 900, 41: "ab" * 700, 42: None, 43: "", 44: "short", 45: words(300, 5), 46: words(300, 5), 47: other[:405], 48: "z" * 399}
    texts |= {50 + i: f"{words(50, 300 + i)[:350]}{shared[: 100 + 30 * i]}{words(50, 400 + i)}" for i in range(8)}
    return texts


@pytest.mark.parametrize("most, paired", [(suffix_dedup.MOST, suffix_dedup.PAIRED), (suffix_dedup.MOST, 2)])
def test_repeats_equal_brute_force(spark, documents, words, monkeypatch, most, paired):
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    texts = _passages(words)
    got = suffix_dedup.without_repeats(documents([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, n_removed int"), most=most)
    assert {r[0]: r[1:] for r in rows(got)} == _without_repeats(texts)


def test_hot_grams_are_dealt_again(spark, documents, words):
    shared = words(75, 1)[:401]
    texts = {i: f"{words(2, 10 + i)}{shared}{words(2, 60 + i)}" for i in range(7)}
    got = suffix_dedup.without_repeats(documents(list(texts.items())), most=6)
    assert {r[0]: r[1:] for r in rows(got)} == _without_repeats(texts)


def test_repeats_of_odd_rows(spark, documents, words):
    long = words(200, 1)
    got = rows(suffix_dedup.without_repeats(documents([(1, long), (1, long), (None, long), (None, None)])))
    assert sorted(r[2] for r in got) == [0, len(long), len(long), len(long)]
    assert rows(suffix_dedup.without_repeats(documents([]))) == []


def test_blind_trie_sorts():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    order, shared = suffix_dedup.BlindTrie(strings).ordered()
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [suffix_dedup.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


# --- chat ------------------------------------------------------------------------------------


def test_layouts_become_turns(spark):
    layouts = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', "messages"),
        ('{"conversations":[{"value":"a","from":"human"},{"from":"gpt","value":"b"}]}', "conversations"),
        ('{"response":"b","prompt":"a"}', "prompt_response"),
        ('{"completion":"b","prompt":"a"}', "prompt_completion"),
        ('{"question":"a","answer":"b"}', "question_answer"),
        ('{"instruction":"a","output":"b"}', "instruction"),
        ('{"instruction":"s","input":"a","output":"b"}', "instruction_input"),
        ('{"other":1}', None),
        ("not json", None),
        (None, None),
        ('{"messages":[]}', None),
    ]
    table = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(layouts)], "id int, record string")
    got = {r["id"]: r for r in chat.canonical(table, "record").collect()}
    for i, (_, layout) in enumerate(layouts):
        turns = [tuple(t) for t in got[i]["turns"]]
        assert got[i]["layout"] == layout
        assert turns == ([] if layout is None else [("system", "s")] * (layout == "instruction_input") + [("user", "a"), ("assistant", "b")])


def test_turns_are_read_back(spark):
    rng = random.Random(4)
    pieces = ["###", "#", "\\", "\\b", "\\h", "\\t", "</turn>", " </turn>\n", "### Assistant: ", ": ", "\n", "é", "😀", "a", " ", "$1"]
    odd = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    talks = [(i, [(rng.choice(["user", "assistant", odd()]), odd()) for _ in range(rng.randint(0, 6))]) for i in range(150)]
    table = spark.createDataFrame(talks, f"id int, turns {chat.TURNS}")
    made = chat.formatted(table).withColumns(
        {"back": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}
    )
    for r in made.collect():
        turns = dict(talks)[r["id"]]
        assert [tuple(t) for t in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_chat_rows_with_nulls(spark):
    talk = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", "y")], "conv_id long, turn long, role string, text string")
    records = chat.records_of_rows(talk, key="conv_id", turn="turn", role="role", text="text")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(chat.canonical(records, "record")), "conv_id").collect()}
    assert got[1]["n_turns"] == 3 and got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nx\n\nx\nuser\n\n").hexdigest() or got[1]["turns_sha256"] == hashlib.sha256(b"user\n\n\nx\n\nx\n").hexdigest()


# --- shards ----------------------------------------------------------------------------------


def _smallest_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            used, load = (used + 1, s) if load + s > middle else (used, load + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("count", [0, 3, 200])
def test_shards_are_minimax(spark, documents, count):
    rng = random.Random(count)
    texts = ["w" * rng.choice([1, 5, 40, 300]) + str(rng.randrange(count)) for _ in range(count)]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + ([(None, None, "x"), (7, texts[0] if texts else "", "y")] if count else [])
    got = sharding.shard(documents(docs, "doc_id long, text string, size string"), 8).collect()
    assert len(got) == len(docs)
    groups, order = Counter(), {}
    for d, t, _ in docs:
        t = t or ""
        groups[t] += len(t.encode()) + 1
        order[t] = min(order.get(t, (1, 0)), (0, d) if d is not None else (1, 0))
    sizes = [groups[t] for t in sorted(groups, key=lambda t: (order[t][0] == 0, order[t][1]))]
    loads, slots, by_crc = Counter(), {}, {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        by_crc.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(loads.values(), default=0) == _smallest_capacity(sizes, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 8 for s in slots)
    assert all(len(s) == 1 for s in by_crc.values())


# --- tokens ----------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, documents):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    letters = [*"abcdefgh   \n\t▁éß漢😀", "<s>", "</s>", "<0x0A>", "ing", " the", "     ", "ab" * 150]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["", None, " ", "a" * 3000, "x y" * 30_000, "\n\n", " " * 400]
    texts += [t for (t,) in duck(SMALL).execute("SELECT text FROM documents").fetchall()]
    table = documents([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(table, path, limit=4096).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert got[i or None] == (len((t or "").encode()), n, n > 4096)


# --- archives --------------------------------------------------------------------------------


def test_archives_are_read_back(spark, tmp_path):
    big = "p" * 999 + "é" + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/\r\nX: y", big), (2, "http://b/", big), (3, None, None), (4, "http://c/", ""), (5, "u", "small"), (6, "u", "small"), (9, "u", big)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "warc")
    warc.write_warc(warc.captures(table, id_col="page_id", url_col="url", payload_col="html"), path, rows_per_file=2)
    records = warc.read_warc(spark, path)
    assert records.count() == 21
    got = {warc_id(r): r for r in warc.transactions(records).collect()}
    for page, _, html in pages:
        payload = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r["answer"]["record_type"] == ("revisit" if page in (1, 2) else "response")
        assert r["request"]["record_id"] == f"<urn:page:request:{page}>" and "page-id" in r["metadata"]["fields"]
    empty = str(tmp_path / "none")
    warc.write_warc(warc.captures(table.limit(0), id_col="page_id", url_col="url", payload_col="html"), empty)
    assert warc.transactions(warc.read_warc(spark, empty)).count() == 0


def test_pages_of_one_id_or_none_stay_captures(spark, tables, tmp_path):
    big, other = "p" * 1500, "q" * 1500
    pages = [(1, "a", big), (1, "a", big), (1, "b", "x"), (1, "a", big), (2, "c", big), (None, "d", big), (None, "d", big), (None, None, None)]
    pages += [(7, "e", other), (7, "e", other), (7, "f", other), (3, "g", other), (5, "h", "alone"), (-4, "i", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_warc(warc.captures(table, id_col="page_id", url_col="url", payload_col="html"), path)
    records = warc.read_warc(spark, path)
    assert records.count() == records.select("record_id").distinct().count() == 3 * len(pages)
    found = warc.transactions(records).collect()
    want = sorted((u or "", f"page-id: {'' if p is None else p}\r\n", len(h or "")) for p, u, h in pages)
    assert sorted((r["answer"]["target_uri"], r["metadata"]["fields"], r["payload_bytes"]) for r in found) == want
    table.coalesce(1).write.parquet(f"{tables.path}/part")
    shutil.copy(next(pathlib.Path(f"{tables.path}/part").glob("*.parquet")), f"{tables.path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables.path}/pages.parquet'")
    assert differences(REGISTRY["op10_warc"](spark, tables.path), con, ORACLE["op10_warc"]) is None


def warc_id(row):
    return int(row["answer"]["record_id"].rpartition(":")[2].rstrip(">"))


def test_a_hot_group_leaves_no_shard_empty(spark, documents):
    for where in (0, 5000, 350):  # the hot group first, last and amid the others
        docs = [(where + i, "h" * 1000) for i in range(300)] + [(1000 + i, f"{i:04d}" + "s" * (100 + i % 37)) for i in range(700)]
        got = sharding.shard(documents(docs), 8).collect()
        loads = Counter()
        for r in got:
            loads[r["shard"]] += r["size"]
        rest = sorted(loads.values())[:-1]
        assert len(loads) == 8 and max(loads.values()) == 300 * 1001
        assert max(rest) < 1.5 * sum(rest) / 7


def test_even_ends_keep_the_capacity(spark):
    rng = random.Random(12)
    for _ in range(4):
        sizes = [rng.choice([1, 2, 3, 50, 200]) for _ in range(rng.randint(9, 40))]
        groups = spark.createDataFrame(list(enumerate(sizes)), "gkey long, gsize long")
        totals = sharding.RunningTotals(groups)
        capacity = _smallest_capacity(sizes, 6)
        ends = totals.even(capacity, 6)
        loads = [b - a for a, b in zip([0, *ends], ends)]
        upto = {sum(sizes[:i]) for i in range(len(sizes) + 1)}
        assert ends[-1] == sum(sizes) and set(ends) <= upto and max(loads) <= capacity and min(loads) > 0


# --- chat: what layouts may hold ---------------------------------------------------------------


def test_long_texts_nulls_and_other_fields_keep_their_turns(spark):
    import json

    big = 'é"\\' + "x" * 25_000_000
    records = [
        ({"prompt": big, "response": "b"}, "prompt_response", [("user", big), ("assistant", "b")]),
        ({"id": 5, "messages": [{"role": "user", "content": big}, {"role": "gpt", "content": None, "name": "z"}]}, "messages", [("user", big), ("assistant", "")]),
        ({"instruction": "s", "input": None, "output": "b"}, "instruction_input", [("system", "s"), ("user", ""), ("assistant", "b")]),
        ({"instruction": "s", "output": "b", "id": 1}, "instruction", [("user", "s"), ("assistant", "b")]),
        ({"prompt": 5, "completion": None}, "prompt_completion", [("user", "5"), ("assistant", "")]),
        ({"messages": "no"}, None, []),
    ]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)], "id int, record string")
    for r in chat.canonical(table, "record").collect():
        _, layout, turns = records[r["id"]]
        assert r["layout"] == layout and [tuple(t) for t in r["turns"]] == turns
