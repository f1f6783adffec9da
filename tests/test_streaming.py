import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.functions.clf import parse_clf
from trafficlens.operators import gauge, stats
from trafficlens.operators.gauge import hits_per_bucket
from trafficlens.plans.report import period_report
from trafficlens.sources import text_log
from trafficlens.streaming import gauge as stream_gauge
from trafficlens.streaming import stats as stream_stats

START = datetime(2020, 11, 10, 16)
LAST = START + timedelta(seconds=100_000)  # a row far ahead closes everything before it


def line(sec, i=0, method="GET"):
    when = (START + timedelta(seconds=sec)).strftime("%d/%b/%Y:%H:%M:%S +0000")
    return f'h - u [{when}] "{method} /s{i % 3}/x HTTP/1.1" {200 + 100 * (i % 4)} {i}'


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}.tmp")
    with open(hidden, "w") as f:
        f.write("".join(text + "\n" for text in lines))
    os.rename(hidden, os.path.join(folder, name))


def traffic(seed, seconds):
    rng = random.Random(seed)
    secs = [s for s in range(seconds) for _ in range(rng.choice([0, 1, 2, 7]) if s // 40 % 2 else rng.choice([0, 1]))]
    return [line(s, i, rng.choice(["GET", "PUT"])) for i, s in enumerate(secs)]


def batch_log(spark, path):
    return text_log.good_rows(text_log.read_log(spark, str(path))).where(F.col("ts") < F.lit(LAST))


def feed(spark, tmp_path, lines, parts, start):
    """Run `start` to the end of the data after each of `parts` files and after a closing one."""
    landing = tmp_path / "in"
    size = -(-len(lines) // parts)
    for n in range(parts + 1):
        put(landing, f"{n}.log", lines[n * size : (n + 1) * size] if n < parts else [line(100_000)])
        start(parse_clf(text_log.stream_lines(spark, str(landing)))).awaitTermination()


def test_statistics_of_stream_equal_batch(spark, tmp_path):
    lines = traffic(1, 200)

    def start(parsed):
        closed = stream_stats.period_stats_stream(parsed, 10, delay="5 seconds")
        return stream_stats.start_stats(closed, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)

    feed(spark, tmp_path, lines, 3, start)
    columns = ["period_start", "from_ts", "n", "rate", "bytes_in", "bytes_out"]
    placed = stats.in_fixed_periods(stats.partials(batch_log(spark, tmp_path / "in")), 10)
    want = sorted(map(tuple, stats.period_stats(placed, 10).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == want


def test_report_of_stream_equals_batch(spark, tmp_path):
    lines = traffic(2, 60)

    def start(parsed):
        return stream_stats.start_report(
            parsed, 10, str(tmp_path / "out"), str(tmp_path / "check"), delay="5 seconds", availableNow=True
        )

    feed(spark, tmp_path, lines, 2, start)
    placed = stats.in_fixed_periods(stats.partials(batch_log(spark, tmp_path / "in")), 10)
    columns = ["period_start", "line_no", "line"]
    want = sorted(map(tuple, period_report(placed, 10).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == want


def test_late_rows_are_dropped(spark, tmp_path):
    closed = lambda parsed: stream_stats.start_stats(
        stream_stats.period_stats_stream(parsed, 10, delay="5 seconds"),
        str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True,
    )
    for n, lines in enumerate([[line(1), line(2)], [line(100)], [line(3), line(101)], [line(100_000)]]):
        put(tmp_path / "in", f"{n}.log", lines)
        closed(parse_clf(text_log.stream_lines(spark, str(tmp_path / "in")))).awaitTermination()
    got = {r.period_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {START: 2, START + timedelta(seconds=100): 2}


@pytest.mark.parametrize("anchored", [False, True])
def test_alerts_of_stream_equal_batch(spark, tmp_path, anchored):
    lines = traffic(4, 240)

    def start(parsed):
        return stream_gauge.start_gauge(
            parsed, 30, 2.0, str(tmp_path / "out"), str(tmp_path / "check"), delay="5 seconds", anchored=anchored,
            availableNow=True,
        )

    feed(spark, tmp_path, lines, 3, start)
    crossed = gauge.traffic_crossings(batch_log(spark, tmp_path / "in"), 30, 2.0, anchored=anchored)
    want = sorted(map(tuple, gauge.alerts(crossed, 2.0).collect()))
    assert len(want) > 4
    got = spark.read.parquet(str(tmp_path / "out" / "alerts")).select("bucket_ts", "line")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("cut", [1, 2])
def test_judging_in_steps_with_every_step_run_twice(spark, tmp_path, cut):
    """Steps of any size, keys of their own pace, each step repeated from the same state."""
    rng = random.Random(9)
    rows = [(k, s) for k in ("a", "b") for s in range(150) for _ in range(rng.choice([0, 0, 1, 4]))]
    log = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    hits = hits_per_bucket(log, threshold=1.5, keys=["k"])
    want = gauge.traffic_crossings(log, 20, 1.5, keys=["k"])
    state, got = None, []
    edges = [0, 7, 60, 61, 150] if cut == 1 else [0, 75, 150]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        fresh = hits.where((F.col("bucket") >= lo) & (F.col("bucket") < hi))
        if n == 1:
            fresh = fresh.where("k = 'a'").unionByName(fresh.where("k = 'b' and bucket < 0"))
        for _ in range(2):
            states = stream_gauge.judge(state, fresh, 20, 1.5, keys=["k"])
            step = gauge.crossings(states.where("is_new"), 1.5, keys=["k"]).collect()
            path = str(tmp_path / f"state{n}")
            stream_gauge.open_state(states, keys=["k"]).write.mode("overwrite").parquet(path)
        got += [tuple(r) for r in step]
        state = spark.read.parquet(path)
    gap = (edges[1], edges[2])
    expected = sorted(map(tuple, want.where("k = 'a'").collect()))
    assert sorted(r for r in got if r[0] == "a") == expected
    rest = log.where(f"k = 'b' and not (unix_seconds(ts) >= {gap[0]} and unix_seconds(ts) < {gap[1]})")
    assert sorted(r for r in got if r[0] == "b") == sorted(
        map(tuple, gauge.traffic_crossings(rest, 20, 1.5, keys=["k"]).collect())
    )
