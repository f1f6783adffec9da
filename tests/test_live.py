"""The continuous job: whatever the order of files and tasks, its outputs are those of the batch operators."""

import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.clf import parse_clf
from trafficlens.operators import gauge, periods, stats
from trafficlens.plans.report import period_report
from trafficlens.sources import text_log
from trafficlens.streaming.live import Computation, LiveJob, Settings

START = datetime(2020, 11, 10, 16, tzinfo=timezone.utc)
SHORT = Settings(stats_period=10, gauge_period=30, threshold=2.0)


def line(sec, i=0, method="GET", host="h"):
    when = (START + timedelta(seconds=sec)).strftime("%d/%b/%Y:%H:%M:%S +0000")
    return f'{host} - u [{when}] "{method} /s{i % 3}/x HTTP/1.1" {200 + 100 * (i % 4)} {i}'


def traffic(seed, seconds, hosts=("h",)):
    rng = random.Random(seed)
    secs = [s for s in range(seconds) for _ in range(rng.choice([0, 1, 2, 7]) if s // 40 % 2 else rng.choice([0, 0, 1]))]
    return [(s, line(s, i, rng.choice(["GET", "PUT"]), rng.choice(hosts))) for i, s in enumerate(secs)]


def put(folder, number, lines):
    """A complete file; files are read in the order of their numbers."""
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{number}.tmp")
    with open(hidden, "w") as f:
        f.write("".join(text + "\n" for text in lines))
    os.utime(hidden, (1_600_000_000 + number, 1_600_000_000 + number))
    os.rename(hidden, os.path.join(folder, f"{number:05d}.log"))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def good(spark, folder):
    return text_log.good_rows(text_log.read_log(spark, str(folder)))


class Replayed(LiveJob):
    def publish(self, batch, batch_id):
        super().publish(batch, batch_id)
        super().publish(batch, batch_id)


def expected(log, settings, keys=(), **options):
    lines = stats.in_anchored_periods(log, settings.stats_period, keys=keys) if settings.anchored else (
        stats.in_fixed_periods(stats.partials(log, keys=keys), settings.stats_period)
    )
    crossed = gauge.traffic_crossings(
        log, settings.gauge_period, settings.threshold, keys=keys, anchored=settings.anchored,
        bucket_secs=settings.bucket_secs, **options,
    )
    return (
        period_report(lines, settings.stats_period, keys=keys),
        stats.period_stats(lines, settings.stats_period, keys=keys),
        gauge.alerts(crossed, settings.threshold, keys=keys),
    )


@pytest.mark.parametrize("anchored", [False, True])
def test_flushed_job_equals_batch_for_every_key(spark, tmp_path, anchored):
    """Files of uneven length, every batch run twice; keys of their own pace, one of them silent for long."""
    settings = Settings(stats_period=10, gauge_period=30, threshold=2.0, bucket_secs=1, anchored=anchored)
    lines = traffic(1, 300, ("a", "b")) + [(s, line(s, s, host="c")) for s in (*range(0, 9), *range(250, 270))]
    lines.sort(key=lambda x: x[0])
    for n, (lo, hi) in enumerate([(0, 150), (150, 153), (153, 300)]):
        put(tmp_path / "in", n, [text for s, text in lines if lo <= s < hi] + [f"broken {n}"])
    job = Replayed(spark, str(tmp_path / "job"), settings=settings, delay_secs=5, keys=["host"])
    job.start(str(tmp_path / "in"), max_files=1, availableNow=True).awaitTermination()
    before = [rows(t) for t in (job.report(), job.stats(), job.alerts())]
    report, facts, alerts = expected(good(spark, tmp_path / "in"), settings, ["host"])
    job.flush()
    assert rows(job.report(), *report.columns) == rows(report)
    assert rows(job.stats(), *facts.columns) == rows(facts)
    assert rows(job.alerts(), *alerts.columns) == rows(alerts) and alerts.count() > 4
    assert rows(job.rejects().select("line", "reason")) == [(f"broken {n}", "structure") for n in range(3)]
    assert job.late().count() == 0
    if anchored:
        return
    # A job that goes on takes no notice of the flush, and its outputs replace those of the flush.
    put(tmp_path / "in", 9, [line(s, s, host="a") for s in range(296, 330)])
    job.start(str(tmp_path / "in"), max_files=1, availableNow=True).awaitTermination()
    assert all(set(old) <= set(rows(new)) for old, new in zip(before, (job.report(), job.stats(), job.alerts())))
    job.flush()
    _, facts, alerts = expected(good(spark, tmp_path / "in"), settings, ["host"])
    assert rows(job.stats(), *facts.columns) == rows(facts)
    assert rows(job.alerts(), *alerts.columns) == rows(alerts)


def test_a_large_first_file_loses_nothing(spark, tmp_path):
    """Several tasks parse one file, and end in any order; with one file a batch every row counts all the same."""
    landing = tmp_path / "in"
    put(landing, 0, [line(s, i) for s in range(60) for i in range(700)])
    for n in range(1, 4):
        put(landing, n, [line(60 * n + s, s) for s in range(60)])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT, delay_secs=0)
        job.start(str(landing), max_files=1, availableNow=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(os.listdir(f"{job.path}/parsed/batch_id=0/kind=good")) > 8
    job.flush()
    assert job.stats().agg(F.sum("n")).first()[0] == 60 * 700 + 180 and job.late().count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    landing = tmp_path / "in"
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT, delay_secs=5)
    for n, lines in enumerate([[line(1), line(2)], [line(100)], [line(3), line(94), line(95), line(101)], [line(0), "x"]]):
        put(landing, n, lines)
        job.start(str(landing), availableNow=True).awaitTermination()
    assert sorted(r.line for r in job.late().collect()) == [line(0), line(3), line(94)]
    assert {r.reason for r in job.late().collect()} == {"late"}
    job.flush()
    assert sorted(rows(job.stats(), F.unix_seconds("period_start") - int(START.timestamp()), "n")) == [(0, 2), (90, 1), (100, 2)]
    assert job.good().count() + job.late().count() == 8 and job.rejects().count() == 1


def test_nothing_yet(spark, tmp_path):
    """Batches of rejects only, and a flush before there is anything."""
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT)
    job.flush()
    put(tmp_path / "in", 0, ["broken"])
    job.start(str(tmp_path / "in"), availableNow=True).awaitTermination()
    job.flush()
    assert job.stats().count() == job.alerts().count() == job.late().count() == 0 and job.rejects().count() == 1


def test_texts_of_batches(spark, tmp_path):
    put(tmp_path / "in", 0, [text for _, text in traffic(3, 90)])
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT, text=True)
    job.start(str(tmp_path / "in"), availableNow=True).awaitTermination()
    for sink, order in (("report", ["period_start", "line_no"]), ("alerts", ["bucket_ts"])):
        folder = tmp_path / "job" / "text" / sink / "batch_id=0"
        texts = "".join((folder / name).read_text() for name in sorted(os.listdir(folder)) if name.startswith("part-"))
        assert texts.splitlines() == [r.line for r in getattr(job, sink)().orderBy(*order).collect()] != []


def test_another_threshold_and_period_while_running(spark, tmp_path):
    """Buckets judged in batch 2 and later are judged by the new threshold; the state lives on."""
    lines = traffic(0, 240)
    for n, (lo, hi) in enumerate([(0, 90), (90, 130), (130, 200), (200, 240)]):
        put(tmp_path / "in", n, [text for s, text in lines if lo <= s < hi])
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT, delay_secs=0)
    job.change(2, threshold=1.3)
    with pytest.raises(ValueError):
        job.change(3, gauge_period=60)
    job.start(str(tmp_path / "in"), max_files=1, availableNow=True).awaitTermination()
    job.flush()
    log = good(spark, tmp_path / "in")
    secs = [r.s for r in log.select((F.unix_seconds("ts") - int(START.timestamp())).alias("s")).collect()]
    hits = {s: secs.count(s) for s in sorted(set(secs))}
    # The newest second of batches 0 and 1 and its bucket: held back, judged by the batch after.
    last = max(s for s in hits if s < 130)
    held = max(s for s in hits if s < last)
    want, high, cum, n = [], False, 0, 0
    order = list(hits)
    for s, nxt in zip(order, [*order[1:], None]):
        cum, n = (hits[s], 1) if not n or s // 30 != before // 30 else (cum + hits[s], n + 1)
        before, limit = s, 2.0 if s < held else 1.3
        if nxt is not None and nxt // 30 == s // 30 and cum / n != limit and (cum / n > limit) != high:
            high = not high
            want.append((s, "High Traffic" if high else "Traffic is back to normal", f"{cum / n:.2f}"))
    got = [(r.s, r.line) for r in job.alerts().select((F.unix_seconds("bucket_ts") - int(START.timestamp())).alias("s"), "line").orderBy("s").collect()]
    assert len(got) == len(want) > 3
    for (s, text), (at, message, average) in zip(got, want):
        assert s == at and message in text and f"avg: {average}" in text
        assert f"({1.3 if s >= held else 2.0:.2f} req" in text


def test_anchored_periods_of_another_length_follow_the_open_one(spark, tmp_path):
    settings = Settings(stats_period=10, gauge_period=30, threshold=2.0, anchored=True)
    put(tmp_path / "in", 0, [line(s) for s in (0, 4, 11, 13)])
    put(tmp_path / "in", 1, [line(s) for s in (15, 19, 22, 30, 41, 48)])
    job = LiveJob(spark, str(tmp_path / "job"), settings=settings, delay_secs=0)
    job.change(1, stats_period=20)
    job.start(str(tmp_path / "in"), max_files=1, availableNow=True).awaitTermination()
    job.flush()
    got = rows(job.stats(), F.unix_seconds("period_start") - int(START.timestamp()), F.unix_seconds("period_end") - int(START.timestamp()), "n")
    assert sorted(got) == [(0, 9, 2), (11, 20, 4), (22, 41, 3), (48, 67, 1)]


def test_silent_keys_leave_the_state(spark, tmp_path):
    """Ten thousand keys met once each, and two that go on: only those and the high ones stay."""
    landing, steady = tmp_path / "in", [line(s, s, host="steady") for s in range(400)]
    once = [line(i % 50, i, host=f"k{i}") for i in range(10_000)]
    loud = [line(20, i, host="loud") for i in range(50)] + [line(21, host="loud")]
    for n, part in enumerate([steady[:50] + once + loud, steady[50:200], steady[200:400]]):
        put(landing, n, part)
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT, delay_secs=5, keys=["host"])
    job.start(str(landing), max_files=1, availableNow=True).awaitTermination()
    slot = f"{job.path}/state/slot=0"
    sizes = {name: spark.read.parquet(f"{slot}/{name}").select("host").distinct().count() for name in ("seconds", "periods", "times")}
    assert all(n == 1 for n in sizes.values())
    assert {r.host for r in spark.read.parquet(f"{slot}/judged").collect()} == {"steady", "loud"}
    job.flush()
    _, facts, alerts = expected(good(spark, landing), SHORT, ["host"])
    assert rows(job.stats(), *facts.columns) == rows(facts) and rows(job.alerts(), *alerts.columns) == rows(alerts)


def test_own_computation_per_key_and_period(spark, tmp_path):
    lines = traffic(7, 120, ("a", "b"))
    for n in range(2):
        put(tmp_path / "in", n, [text for s, text in lines if s // 60 == n])
    schema = T.StructType([T.StructField("bins", T.ArrayType(T.LongType()))])

    def partial(pdf):
        return pd.DataFrame({"bins": [[int((pdf["bytes"] % 5 == b).sum()) for b in range(5)]]})

    def merge(pdf):
        return pd.DataFrame({"bins": [[int(sum(x)) for x in zip(*pdf["bins"])]]})

    one = Computation("bins", 15, partial, merge, schema, columns=["bytes"])
    job = Replayed(spark, str(tmp_path / "job"), settings=SHORT, delay_secs=5, keys=["host"], computations=[one], sinks=())
    job.start(str(tmp_path / "in"), max_files=1, availableNow=True).awaitTermination()
    job.flush()
    log = good(spark, tmp_path / "in").select("host", "ts", "bytes")
    want = periods.apply_per_period_pandas(log, 15, partial, merge, schema, keys=["host"])
    assert rows(job.computed("bins"), *want.columns) == rows(want) != []


def test_a_state_of_another_job_is_refused(spark, tmp_path):
    put(tmp_path / "in", 0, [line(1)])
    job = LiveJob(spark, str(tmp_path / "job"), settings=SHORT)
    job.start(str(tmp_path / "in"), availableNow=True).awaitTermination()
    batch = parse_clf(spark.createDataFrame([(line(2), "f")], "line string, file string"))
    with pytest.raises(RuntimeError):
        job.publish(batch, 7)
