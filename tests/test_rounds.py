"""Chains linked in rounds, intervals of mixed lengths, sets of rows compared by digest."""

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import audit, lookup, periods


def chain(secs, period):
    start, out = None, {}
    for s in sorted(secs):
        start = s if start is None or s >= start + period else start
        out[s] = start
    return out


@pytest.mark.parametrize("block, fan, period", [(10, 8, 10), (40, 5, 10), (None, None, 10), (600, None, 600)])
def test_chains_equal_a_loop(spark, block, fan, period):
    rng = random.Random(period + (fan or 0))
    span = 40 * period
    secs = {k: rng.sample(range(-span // 3, span), span // every) for k, every in (("a", 2), ("b", 9), (None, 40))}
    # Blocks a long way apart, the first and the last second there can be.
    secs["c"] = [0, 10, 20, 30, 39, 49, 10**6, 2 * 10**9, -2 * 10**9, 253_402_300_799, -62_135_596_800]
    table = spark.createDataFrame([(k, s) for k, v in secs.items() for s in v], "k string, sec long")
    found = periods.anchored_periods(table, period, keys=["k"], block_secs=block, fan=fan)
    got = {(r.k, r.sec): r.period_start_sec for r in found.collect()}
    assert got == {(k, s): start for k, v in secs.items() for s, start in chain(v, period).items()}


def test_no_group_holds_a_whole_key(spark):
    """A key over 4,000 blocks of one period: no group of blocks is longer than `fan`."""
    fan = 64
    secs = random.Random(1).sample(range(40_000), 30_000)
    found = periods.anchored_periods(spark.createDataFrame([(s,) for s in secs], "sec long"), 10, block_secs=10, fan=fan)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_above" in plan and "SinglePartition" not in plan
    assert {r.sec: r.period_start_sec for r in found.collect()} == chain(secs, 10)
    blocks = spark.createDataFrame([(s,) for s in secs], "sec long").select(F.floor(F.col("sec") / 10).alias("b")).distinct()
    assert blocks.groupBy(F.floor(F.col("b") / fan)).count().agg(F.max("count")).first()[0] <= fan


def test_covers_are_short_and_exact(spark):
    rng = random.Random(4)
    spans = [(0, 0), (5, 4), (-1, 1), (15, 16), (0, 16**5 - 1), (-(10**9), 10**9), (-62_135_596_800, 253_402_300_799)]
    spans += [(a, a + rng.choice([0, 1, 30, 5000, 10**6])) for a in (rng.randrange(-(10**6), 10**9) for _ in range(200))]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, start_sec long, end_sec long")
    blocks = {}
    for r in lookup.interval_cover(table).collect():
        size = 16 ** r["_level"]
        blocks.setdefault(r["i"], []).append((r["_block"] * size, (r["_block"] + 1) * size - 1))
    for i, (a, b) in enumerate(spans):
        found = sorted(blocks.get(i, []))
        if b < a:
            assert not found
            continue
        assert found[0][0] == a and found[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(found, found[1:]))
        levels = len(f"{b - a + 1:x}")
        assert len(found) <= 30 * levels


def test_mixed_intervals_equal_brute_force(spark):
    rng = random.Random(5)
    events = [(i, rng.choice("ab"), rng.randrange(10**6)) for i in range(3000)] + [(-1, None, 7)]
    spans = [(i, rng.choice("ab"), a, a + rng.choice([0, 3, 900, 10**5, 10**6])) for i, a in enumerate(rng.sample(range(10**6), 60))]
    spans += [(90, "a", 0, 10**6), (91, None, 0, 100), (92, "a", 5, 1)]
    log = spark.createDataFrame(events, "e long, k string, s long").select("e", "k", F.timestamp_seconds("s").alias("ts"))
    intervals = spark.createDataFrame(spans, "i long, k string, start_sec long, end_sec long")
    got = lookup.fetch_intervals_mixed(log, intervals, keys=["k"]).select("i", "e").collect()
    want = [(i, e) for i, k, a, b in spans for e, of, s in events if k == of and a <= s <= b]
    assert sorted(map(tuple, got)) == sorted(want)
    assert lookup.fetch_intervals_mixed(log, intervals.limit(0), keys=["k"]).count() == 0


def test_sets_of_rows_are_compared_each_as_often_as_it_occurs(spark):
    rows = [(i % 7, f"v{i % 50}", None if i % 3 else i) for i in range(2000)] + [(7, None, None)] * 3
    table = spark.createDataFrame(rows, "g long, a string, b long")
    shuffled = table.repartition(5).orderBy(F.rand(3))
    differences = lambda other: {r.g for r in audit.multiset_differences(table, other, ["a", "b"], by=[F.col("g").alias("g")]).collect() if not r.same}
    assert differences(shuffled) == set()
    assert differences(shuffled.union(table.where("g = 2").limit(1))) == {2}  # doubled
    assert differences(table.where("g <> 7").union(spark.createDataFrame(rows[-2:], table.schema))) == {7}  # lost
    changed = table.withColumn("b", F.when((F.col("g") == 4) & (F.col("a") == "v4"), F.lit(1)).otherwise(F.col("b")))
    assert differences(changed) == {4}
    # Moving a value to the next column, or swapping two rows' values, is no equal set.
    swapped = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], table.schema)
    crossed = spark.createDataFrame([(0, "x", 2), (0, "y", 1)], table.schema)
    assert [r.same for r in audit.multiset_differences(swapped, crossed, ["a", "b"]).collect()] == [False]
    assert audit.multiset_differences(table.limit(0), table.limit(0), ["a", "b"]).collect()[0].same


def test_loads_that_change_or_come_again(spark, tmp_path):
    """Kept rollups equal one over all rows, whatever loads are repeated, replaced or emptied."""
    from trafficlens.operators import stats
    from trafficlens.sources.rollup_table import RollupTable

    rng = random.Random(6)
    made = [(rng.randrange(3 * 86_400), rng.choice("ab"), rng.choice(["GET", "PUT"]), i) for i in range(600)]
    log = spark.createDataFrame(made, "s long, host string, method string, i long").select(
        "host", F.timestamp_seconds("s").alias("ts"), "method", F.lit("/x").alias("section"), F.lit("1.1").alias("version"),
        F.lit(200).alias("status"), F.col("i").alias("bytes"), "i",
    )
    kept = RollupTable(spark, str(tmp_path / "kept"), levels=(60, 3600, 86_400), keys=["host"], dims=["method"])
    day = F.floor(F.unix_seconds("ts") / 86_400)

    def check(whole):
        for secs in kept.levels:
            want = stats.rollup(stats.partials(whole, keys=["host"]), secs, keys=["host"], dims=["method"])
            want = want.select("host", F.timestamp_seconds("sec"), "method", "n", "bytes_in", "bytes_out", "first_ts")
            assert sorted(map(tuple, kept.table(secs).collect())) == sorted(map(tuple, want.collect()))

    kept.load("one", log.where("i < 200"))
    kept.load("two", log.where("i >= 200"))
    kept.load("one", log.where("i < 200"))
    check(log)
    kept.load("two", log.where((F.col("i") >= 200) & (day == 1)))
    check(log.where((F.col("i") < 200) | (day == 1)))
    kept.load("one", log.limit(0))
    check(log.where((F.col("i") >= 200) & (day == 1)))
    with pytest.raises(ValueError):
        RollupTable(spark, str(tmp_path), levels=(60, 90))
