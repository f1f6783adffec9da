import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import fixed
from trafficlens.functions.clock import parse_datetime
from trafficlens.operators import gauge, lookup, periods, stats
from trafficlens.operators.scan import scan
from trafficlens.plans.report import period_report

EPOCH = datetime(1970, 1, 1)


def at(sec):
    return EPOCH + timedelta(seconds=sec)


def log_at(spark, secs, **constant):
    df = spark.createDataFrame([(s,) for s in secs], "sec long").select(F.timestamp_seconds("sec").alias("ts"))
    return df.withColumns({k: F.lit(v) for k, v in constant.items()})


# --- running scan ----------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(), (10,), (3, 4), (2, 2, 2)])
def test_scan_against_a_loop(spark, blocks):
    rng = random.Random(3)
    rows = [
        (k, p, rng.randint(1, 9), rng.choice([None, 1, 2]))
        for k in ["a", "b", None]
        for p in rng.sample(range(-40, 60), 30)
    ]
    df = spark.createDataFrame(rows, "k string, p long, n long, v int")
    out = scan(df, "p", keys=["k"], totals={"total": F.col("n")}, lasts={"last": F.col("v")},
               nexts={"next": F.col("v")}, blocks=blocks)
    got = {(r.k, r.p): (r.total, r.last, r.next) for r in out.collect()}
    want = {}
    for k in ["a", "b", None]:
        own = sorted([r for r in rows if r[0] == k], key=lambda r: r[1])
        for i, (_, p, _, _) in enumerate(own):
            before = [r[3] for r in own[:i] if r[3] is not None]
            after = [r[3] for r in own[i + 1 :] if r[3] is not None]
            want[k, p] = (sum(r[2] for r in own[:i]), before[-1] if before else None, after[0] if after else None)
    assert got == want


# --- periods ---------------------------------------------------------------------------------


def chained(secs, period):
    """Period start per second, one after the other."""
    out, start = {}, None
    for s in sorted(set(secs)):
        if start is None or s >= start + period:
            start = s
        out[s] = start
    return out


@pytest.mark.parametrize("period, block", [(10, 10), (10, 16), (7, 50), (1, 5), (60, 64), (10, None)])
@pytest.mark.parametrize("density", [0.02, 0.3, 1.0])
def test_anchored_periods_against_a_loop(spark, period, block, density):
    rng = random.Random(f"{period}{block}{density}")
    rows = [(k, s) for k in ("a", "b") for s in range(1000, 1600) if rng.random() < density or s == 1000]
    df = spark.createDataFrame(rows, "k string, sec long")
    out = periods.anchored_periods(df, period, keys=["k"], block_secs=block)
    got = {(r.k, r.sec): r.period_start_sec for r in out.collect()}
    want = {(k, s): p for k in ("a", "b") for s, p in chained([s for q, s in rows if q == k], period).items()}
    assert got == want


def test_anchored_periods_skip_whole_blocks(spark):
    secs = [0, 9, 10, 95, 1000, 1009, 1010, 5000]
    df = spark.createDataFrame([(s,) for s in secs], "sec long")
    out = periods.anchored_periods(df, 10, block_secs=10)
    assert {r.sec: r.period_start_sec for r in out.collect()} == chained(secs, 10)


def test_anchored_rows_keep_every_row(spark):
    secs = [0, 0, 0, 5, 12, 12, 40] * 3
    out = periods.with_anchored_period(log_at(spark, secs), 10)
    got = sorted((r.ts, r.period_start, r.period_end) for r in out.collect())
    starts = chained(secs, 10)
    assert got == sorted((at(s), at(starts[s]), at(starts[s] + 9)) for s in secs)


def test_two_lengths_each_see_every_row_once(spark):
    log = log_at(spark, [100 + i * 200 // 1000 for i in range(10)], section="/a", method="GET", version="1.1",
                 status=200, bytes=1)
    out = stats.multi_period_stats(log, [1, 3])
    per_length = {r.period_secs: r.n for r in out.groupBy("period_secs").agg(F.sum("n").alias("n")).collect()}
    assert per_length == {1: 10, 3: 10}


@pytest.mark.parametrize("bad", [0, -1])
def test_periods_must_be_positive(spark, bad):
    log = log_at(spark, [1], section="/a", method="GET", version="1.1", status=200, bytes=1)
    for call in (
        lambda: periods.with_fixed_period(log, bad),
        lambda: periods.anchored_periods(log.select(F.lit(1).cast("long").alias("sec")), bad),
        lambda: stats.in_fixed_periods(stats.partials(log), bad),
        lambda: stats.multi_period_stats(log, [10, bad]),
        lambda: gauge.traffic_crossings(log, bad, 10.0),
    ):
        with pytest.raises(ValueError):
            call()


def test_fixed_period_origin(spark):
    out = periods.with_fixed_period(log_at(spark, [0, 2, 3, 12]), 10, origin=3).orderBy("ts").collect()
    assert [(r.period_start, r.period_end) for r in out] == [
        (at(-7), at(2)), (at(-7), at(2)), (at(3), at(12)), (at(3), at(12)),
    ]


def test_densify_long_silence(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 100_000, 2), ("b", 50, 3)], "k string, s long, n long").select(
        "k", F.timestamp_seconds("s").alias("period_start"), "n"
    )
    out = periods.densify(df, 10, ["n"], keys=["k"])
    assert out.groupBy("k").agg(F.count("*"), F.sum("n")).orderBy("k").collect() == [("a", 10_001, 3), ("b", 1, 3)]
    assert out.select("period_start").distinct().count() == 10_001


def test_custom_computations(spark):
    log = log_at(spark, range(0, 95)).withColumn("bytes", F.unix_seconds("ts"))
    native = periods.apply_per_period(log, 10, lambda g: g.agg(F.max("bytes").alias("top")))
    assert {r.period_start: r.top for r in native.collect()} == {at(p): min(p + 9, 94) for p in range(0, 95, 10)}

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("top", T.LongType())])
    out = periods.apply_per_period_pandas(
        log.repartition(5), 10,
        lambda pdf: pd.DataFrame({"n": [len(pdf)], "top": [pdf["bytes"].max()]}),
        lambda pdf: pd.DataFrame({"n": [pdf["n"].sum()], "top": [pdf["top"].max()]}),
        schema, spread=3,
    )
    got = {r.period_start: (r.n, r.top) for r in out.collect()}
    assert got == {at(p): (min(10, 95 - p), min(p + 9, 94)) for p in range(0, 95, 10)}


# --- statistics ------------------------------------------------------------------------------


def test_golden_report(log_of):
    placed = stats.in_anchored_periods(log_of(fixed.REPORT_LINES), 10)
    lines = period_report(placed, 10).orderBy("period_start", "line_no").collect()
    assert "".join(r.line + "\n" for r in lines) == fixed.REPORT


def test_report_leaves_out_empty_lists(log_of):
    placed = stats.in_anchored_periods(
        log_of(['h - u [02/Nov/2020:10:00:00 +0000] "GET /x HTTP/1.0" 200 5']), 10
    )
    lines = [r.line for r in period_report(placed, 10).orderBy("line_no").collect()]
    assert "Count per section:" not in lines and "Count per method:" in lines


def test_lists_hold_ten_entries_by_count_then_text(log_of):
    lines = [
        f'h - u [02/Nov/2020:10:00:00 +0000] "GET /s{i:02d}/x HTTP/1.0" 200 5' for i in range(15) for _ in range(1 + (i == 3))
    ]
    top = stats.top_per_dimension(stats.in_fixed_periods(stats.partials(log_of(lines)), 10))
    got = [r.value for r in top.where("dim = 'section'").orderBy("rank").collect()]
    assert got == ["/s03", *[f"/s{i:02d}" for i in range(14, 5, -1)]]


def test_exploded_sets_equal_grouping_sets(log_of):
    placed = stats.in_fixed_periods(stats.partials(log_of(fixed.REPORT_LINES)), 4)
    a = stats.all_dimensions(placed).select("period_start_sec", "dim", "value", "n", "bytes_in", "bytes_out", "first_ts")
    b = stats.exploded_dimensions(placed, ["period_start_sec"])
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_out_of_range_status_keeps_the_period(log_of):
    log = log_of(['h - u [02/Nov/2020:10:00:00 +0000] "GET /x HTTP/1.0" 999 5'])
    placed = stats.in_fixed_periods(stats.partials(log), 10)
    assert [(r.category, r.n) for r in stats.count_per(placed, "category").collect()] == [("OutOfRange", 1)]


def test_byte_alarm_fires_once(spark):
    log = log_at(spark, [0, 1, 10, 20, 30], section="/a", method="GET", version="1.1", status=200, bytes=100)
    (row,) = stats.byte_alarm(log, 10, 300).collect()
    assert (row.period_start, row.total_lines, row.total_bytes) == (at(10), 3, 300)
    assert stats.byte_alarm(log, 10, 501).count() == 0


# --- gauge -----------------------------------------------------------------------------------


def test_golden_alerts(log_of):
    crossed = gauge.traffic_crossings(log_of(fixed.GAUGE_LINES), 120, fixed.GAUGE_THRESHOLD, anchored=True)
    lines = gauge.alerts(crossed, fixed.GAUGE_THRESHOLD).orderBy("bucket_ts").collect()
    assert "".join(r.line + "\n" for r in lines) == fixed.GAUGE_ALERTS


def simulate(secs, period, threshold, starts=None):
    """The gauge event by event, over periods in order; `crossed` as (up, position, average, sec)."""
    secs = sorted(secs)
    by_period = {}
    for s in secs:
        by_period.setdefault(starts[s] if starts else s - s % period, []).append(s)
    on, out = False, []
    for _, events in sorted(by_period.items()):
        seconds = sorted(set(events))
        cum = 0
        for i, s in enumerate(seconds[:-1]):
            hits = events.count(s)
            cum += hits
            avg = cum / (i + 1)
            if avg > threshold and not on:
                on = True
                position = cum - hits + int(threshold)
                out.append((True, position, avg, events[position]))
            elif avg < threshold and on:
                on = False
                out.append((False, cum, avg, events[cum]))
    return out


@pytest.mark.parametrize("anchored", [False, True])
def test_gauge_against_a_loop(spark, anchored):
    rng = random.Random(11)
    secs = [s for s in range(0, 1500) for _ in range(rng.choice([0, 0, 1, 2, 3, 6]) if s // 100 % 3 else rng.choice([0, 5]))]
    starts = chained(secs, 20) if anchored else None
    crossed = gauge.traffic_crossings(log_at(spark, secs), 20, 2.5, anchored=anchored)
    got = [(r.is_up, r.position, r.average, r.crossed_ts) for r in crossed.orderBy("bucket").collect()]
    want = [(u, p, a, at(s)) for u, p, a, s in simulate(secs, 20, 2.5, starts)]
    assert len(want) > 20 and got == want


def test_state_stays_on_the_threshold(spark):
    secs = [0] * 4 + [1] * 0 + [2] * 2 + [3] * 3 + [4]  # averages 4, 3, 3 and an unjudged second
    states = gauge.gauge(log_at(spark, secs), 100, 3.0).orderBy("bucket").collect()
    assert [(r.average, r.is_high) for r in states] == [(4.0, True), (3.0, True), (3.0, True), (2.5, True)]
    flushed = gauge.gauge(log_at(spark, secs), 100, 3.0, flush_last=True).orderBy("bucket").collect()
    assert flushed[-1].is_high is False


def test_silent_seconds_can_count(spark):
    secs = [0] * 6 + [5] * 2 + [6]
    dense = gauge.gauge(log_at(spark, secs), 100, 3.0, densify=True).orderBy("bucket").collect()
    assert [(r.bucket, r.hits, r.buckets) for r in dense] == [
        (0, 6, 1), (1, 0, 2), (2, 0, 3), (3, 0, 4), (4, 0, 5), (5, 2, 6), (6, 1, 7),
    ]
    down = [r for r in gauge.crossings(gauge.gauge(log_at(spark, secs), 100, 3.0, densify=True), 3.0).collect() if not r.is_up]
    assert [(r.bucket, r.position, r.crossed_ts) for r in down] == [(2, 6, at(5))]


def test_gauge_per_key(spark):
    log = log_at(spark, [0] * 5 + [1], k="a").unionByName(log_at(spark, [0] * 9 + [1], k="b"))
    crossed = gauge.traffic_crossings(log, 60, 7.0, keys=["k"]).collect()
    assert [(r.k, r.position) for r in crossed] == [("b", 7)]


# --- lookups ---------------------------------------------------------------------------------

BASE = int((datetime(2020, 11, 10, 16) - EPOCH).total_seconds())
FORTY_ONE = [BASE] + [BASE + s for s in range(1, 5) for _ in range(10)]


def test_next_timestamp(spark):
    log = log_at(spark, FORTY_ONE)
    probes = log_at(spark, [BASE - 5, BASE + 3, BASE + 4]).withColumnRenamed("ts", "probe_ts")
    got = {r.probe_ts: r.next_sec for r in lookup.next_after(probes, log, probe_ts="probe_ts").collect()}
    assert got == {at(BASE - 5): BASE, at(BASE + 3): BASE + 4, at(BASE + 4): -1}
    assert lookup.first_timestamp(log).first()[0] == BASE * 1000
    assert lookup.first_timestamp(log.where("false")).first()[0] == -1


def test_interval_is_inclusive(spark):
    log = log_at(spark, FORTY_ONE)
    sizes = []
    for s in range(5):
        moment = F.timestamp_seconds(F.lit(BASE + s))
        sizes.append(lookup.fetch_interval(log, moment, moment).count())
    assert sizes == [1, 10, 10, 10, 10]
    spans = spark.createDataFrame([(i, BASE + i, BASE + 2 * i) for i in range(3)], "i int, start_sec long, end_sec long")
    got = lookup.fetch_intervals(log, spans, block_secs=2).groupBy("i").count().orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 20), (2, 30)]


def test_extent_of_a_second(spark):
    out = lookup.second_extent(log_at(spark, FORTY_ONE)).orderBy("sec").collect()
    assert [(r.first_index, r.last_index) for r in out] == [(0, 0), (1, 10), (11, 20), (21, 30), (31, 40)]


def test_nearest_takes_the_earlier_on_a_tie(spark):
    log = spark.sql("select timestamp_millis(1000 + 2 * id) ts from range(4)")
    probes = spark.sql("select timestamp_millis(999 + id) probe_ts, 999 + id p from range(11)")
    got = {r.p: r.nearest_at for r in lookup.nearest(probes, log, probe_ts="probe_ts", resolution="millisecond").collect()}
    assert got == {999: 1000, 1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, 1004: 1004, 1005: 1004, 1006: 1006,
                   1007: 1006, 1008: 1006, 1009: 1006}


@pytest.mark.parametrize("resolution, scale", [("second", 1), ("microsecond", 1)])
def test_nearest_against_a_loop(spark, resolution, scale):
    rng = random.Random(5)
    span = 400_000
    events = [rng.randrange(span) for _ in range(60)] * 2
    probes = [rng.randrange(-1000, span + 1000) for _ in range(300)]
    make = "timestamp_seconds" if resolution == "second" else "timestamp_micros"
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], "v long").selectExpr(
        "v", f"{make}(v) {name}"
    )
    out = lookup.nearest(frame(probes, "probe_ts"), frame(events, "ts"), probe_ts="probe_ts", resolution=resolution)
    got = sorted((r.v, r.nearest_at) for r in out.collect())
    assert got == sorted((p, min(sorted(set(events)), key=lambda e: abs(e - p))) for p in probes)


def test_retention_follows_the_longest_period(spark):
    log = log_at(spark, [0, 10, 50, 100])
    assert sorted(r.ts for r in lookup.retention_tail(log, [10, 50]).collect()) == [at(50), at(100)]


def test_batches_append_in_time_order(spark):
    late, early = log_at(spark, [5, 9]), log_at(spark, [7, 1])
    assert [r.ts for r in lookup.append_batches(late, early).collect()] == [at(1), at(5), at(7), at(9)]


def test_month_forms_are_one_moment(spark):
    df = spark.createDataFrame([("10/November/2020:16:00:00 +0000",), ("10/11/2020:16:00:00 +0000",)], "t string")
    assert {r[0] for r in df.select(parse_datetime("t")).collect()} == {at(BASE)}
