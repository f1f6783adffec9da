"""Stages of the pipeline against plain Python, with odd rows; rows that share an id."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import minhash, mixing, quality, suffix_dedup
from trafficlens.llm.parameters import DOMAINS, MIX

SCHEMA = "doc_id long, text string, _row string, score double, class_id string"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def corpus(spark, tables, words):
    """Good and poor texts with their labels, near copies, a benchmark passage, and odd rows."""
    rng = random.Random(1)
    good = {i: words(80, i) for i in range(120)}
    poor = {i: "click here now " * 40 + words(3, i) for i in range(200, 260)}
    texts = {**good, **poor}
    labels = [(i, 1, 0) for i in good] + [(i, 0, int(i % 9 == 0)) for i in poor]
    passage = words(60, 999)
    rows = [(i, t, "r", 0.5, "x") for i, t in texts.items()]
    near = good[5].split()
    near[3] = "changed"
    rows += [
        (5, " ".join(near), "r", 0.5, "x"), (300, good[6], "r", 0.5, "x"), (7, good[8], "r", 0.5, "x"), (None, good[9], None, None, None),
        (None, words(90, 77), "r", 1.0, None), (10, f"{words(30, 5)} {passage} {words(30, 6)}", "r", 0.1, "y"), (11, good[11], "r", 0.5, "x"),
    ]
    rng.shuffle(rows)
    tables.add(spark.createDataFrame(rows, SCHEMA), "documents")
    tables.add(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels")
    tables.add(spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string"), "benchmark")
    return tables


def docs_of(spark, corpus):
    return spark.read.parquet(f"{corpus.path}/documents.parquet")


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    both, total = sum((x & y).values()), sum((x | y).values())
    return (a or "") == (b or "") or bool(total) and both / total >= 0.8


def test_quality_keeps_rows_of_its_score(spark, corpus):
    docs = docs_of(spark, corpus)
    kept = corpus_pipeline.quality_classifier(spark, docs, corpus.path)
    model = quality.fit(docs, spark.read.parquet(f"{corpus.path}/labels.parquet"))
    scored = quality.scored(docs.select("text"), model).distinct().collect()
    fine = {r["text"] for r in scored if r["score"] >= quality.THRESHOLD}
    assert kept.schema == docs.schema and bag(kept) == bag(docs.where(F.col("text").isin(sorted(fine))))


def test_votes_equal_plain_loops(spark, corpus):
    """Cosine-weighted votes of the nearest labelled texts, one document after the other."""
    docs = docs_of(spark, corpus)
    model = quality.fit(docs, spark.read.parquet(f"{corpus.path}/labels.parquet"))
    hasher = quality.Hasher()
    for r in quality.scored(docs.select("text"), model).distinct().collect():
        place, count, _ = hasher.counts(r["text"])
        vector = model.vector(place, count) if place.size else None
        size = float((vector @ vector) ** 0.5) if place.size else 0.0
        want = model.prior
        if size > 1e-9:
            votes = sorted(((float(vector @ v) / size, float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
            total = sum(max(c, 0) for c, _ in votes)
            want = sum(max(c, 0) * y for c, y in votes) / total if total > 0 else want
        assert r["score"] == pytest.approx(want, abs=1e-4)


def test_one_row_of_each_class_stays(spark, corpus):
    docs = docs_of(spark, corpus)
    given = [tuple(r) for r in docs.collect()]
    kept = corpus_pipeline.near_dedup(spark, docs, corpus.path)
    left = [tuple(r) for r in kept.collect()]
    assert kept.schema == docs.schema and not Counter(left) - Counter(given)
    for i, one in enumerate(given):
        assert sum(alike(one[1], other[1]) for other in left) == 1, one[0]


def test_clean_rows_of_a_contaminated_id_stay(spark, corpus):
    docs = docs_of(spark, corpus)
    kept = corpus_pipeline.decontamination(spark, docs, corpus.path)
    passage = spark.read.parquet(f"{corpus.path}/benchmark.parquet").where("item_id = 1").first()["text"]
    assert kept.schema == docs.schema and bag(kept) == bag(docs.where(~F.coalesce(F.contains("text", F.lit(passage)), F.lit(False))))
    assert kept.where("doc_id = 10").count() == 1


def test_mix_takes_rows_as_often_as_their_rate_says(spark, corpus):
    docs = docs_of(spark, corpus)
    taken = corpus_pipeline.mix(spark, docs, corpus.path)
    labels = spark.read.parquet(f"{corpus.path}/labels.parquet")
    copies = Counter()
    names = {c: f"g_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    for r in mixing.mixed(docs.withColumnsRenamed(names), labels, DOMAINS, [MIX[d] for d in DOMAINS]).collect():
        copies[(r["doc_id"], r["text"], r["g__row"], r["g_score"], r["g_class_id"])] += r["copies"]
    assert taken.schema == docs.schema and bag(taken) == +copies


def test_run_applies_the_stages_in_turn(spark, corpus):
    docs = docs_of(spark, corpus)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus.path)
    result = corpus_pipeline.run(spark, corpus.path)
    columns = ["size", "text_crc32", "shard", "slot"]  # of rows with one id and size any may come first
    assert bag(result.select(columns[:2])) == bag(docs.select(columns[:2])) and result.columns == docs.columns
    assert bag(result.select("shard", "slot")) == bag(docs.select("shard", "slot"))


def test_empty_tables_go_through(spark, tables):
    tables.add(spark.createDataFrame([], SCHEMA), "documents")
    tables.add(spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    tables.add(spark.createDataFrame([], "item_id long, text string"), "benchmark")
    assert corpus_pipeline.run(spark, tables.path).count() == 0


# --- rows that share an id ---------------------------------------------------------------------


def test_near_copies_of_the_second_text_of_an_id(spark, documents, words):
    a, b, c = words(100, 1), words(100, 2), words(100, 3)
    near = b.replace(b.split()[50], "other", 1)
    rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (None, a), (None, words(90, 4)), (4, ""), (None, None)]
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(documents(rows)).collect()]
    assert Counter(d for d, _ in got) == Counter(d for d, _ in rows)
    classes = {}
    for d, k in got:
        classes.setdefault(k, Counter())[d] += 1
    want = [Counter([1, None]), Counter([1, 2]), Counter([3, 3]), Counter([None]), Counter([4, None])]
    assert sorted(classes.values(), key=repr) == sorted(want, key=repr)
    assert {k for k, members in classes.items() if set(members) == {3}} == {3} and 4 in classes


def test_bytes_of_both_texts_of_an_id(spark, documents):
    import hashlib

    rng = random.Random(3)
    part = "".join(rng.choice("abcdef ") for _ in range(500))
    texts = [(1, "x" * 20 + part), (1, part + "".join(rng.choice("ghij") for _ in range(300))), (2, part), (None, "short"), (None, part[:450])]
    got = Counter(tuple(r) for r in suffix_dedup.without_repeats(documents(texts)).collect())
    want = Counter()
    for d, t in texts:
        left = t.replace(part, "").replace(part[:450], "") if t != "short" else t
        want[(d, len(t), len(t) - len(left), int(len(left) < len(t)), hashlib.sha256(left.encode()).hexdigest())] += 1
    assert got == want
