"""Points that green queries over one file do not show."""

import os
import time
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.operators import gauge, lookup, periods, stats
from trafficlens.plans import queries
from trafficlens.plans.report import period_report
from trafficlens.sources import text_log
from trafficlens.streaming.live import LiveJob, Settings


def _log(spark, seconds, **columns):
    rows = spark.createDataFrame([(int(s),) for s in seconds], "s long")
    return rows.select(F.timestamp_seconds("s").alias("ts"), *[c.alias(n) for n, c in columns.items()])


def test_start_position_does_not_depend_on_the_drivers_zone(spark, tmp_path, monkeypatch):
    landing = tmp_path / "in"
    landing.mkdir()
    for name, stamp in (("old", "2024-01-01T10:00:00"), ("new", "2024-01-01T12:00:00")):
        (landing / name).write_text(f"{name}\n")
        at = datetime.fromisoformat(stamp).replace(tzinfo=timezone.utc).timestamp()
        os.utime(landing / name, (at, at))
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        lines = text_log.stream_lines(spark, str(landing), start_from=datetime(2024, 1, 1, 11))
    finally:
        monkeypatch.undo()
        time.tzset()
    out = str(tmp_path / "out")
    lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert [r.line for r in spark.read.parquet(out).collect()] == ["new"]


def test_flushed_alerts_name_a_time(spark):
    log = _log(spark, [0] * 9 + [1] * 9 + [10])
    crossed = gauge.traffic_crossings(log, 10, 3.0, flush_last=True)
    lines = [r.line for r in gauge.alerts(crossed, 3.0).orderBy("bucket_ts").collect()]
    assert lines and not any("null" in line for line in lines)


def test_arrival_order_over_files(spark, tmp_path):
    spark.range(3).select(F.lit("small").alias("f"), "id").coalesce(1).write.parquet(f"{tmp_path}/t/n=1")
    spark.range(3, 40_000).select(F.lit("x" * 50).alias("f"), "id").coalesce(1).write.parquet(f"{tmp_path}/t/n=2")
    batch = spark.read.parquet(f"{tmp_path}/t").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    ids = [r.id for r in lookup.append_batches(batch, batch, arrival=["n", "id"]).select("id").collect()]
    assert ids == [*range(40_000)] * 2


def test_pandas_computation_per_key_and_anchored_period(spark):
    """A histogram turned into its median bin, per key: no native aggregate says that."""
    log = _log(spark, [3, 4, 5, 20, 21, 40], host=F.when(F.col("s") == 4, "b").otherwise("a"), bytes=F.col("s") % 4)
    schema = T.StructType([T.StructField("bins", T.ArrayType(T.LongType()))])

    def partial(pdf):
        return pd.DataFrame({"bins": [[int((pdf["bytes"] == b).sum()) for b in range(4)]]})

    def merge(pdf):
        return pd.DataFrame({"bins": [[int(sum(x)) for x in zip(*pdf["bins"])]]})

    out = periods.apply_per_period_pandas(log, 10, partial, merge, schema, keys=["host"], anchored=True)
    got = {(r.host, int(r.period_start.replace(tzinfo=timezone.utc).timestamp())): list(r.bins) for r in out.collect()}
    assert got == {("a", 3): [0, 1, 0, 1], ("b", 4): [1, 0, 0, 0], ("a", 20): [1, 1, 0, 0], ("a", 40): [1, 0, 0, 0]}


def test_chains_over_long_periods(spark):
    week = 7 * 86_400
    seconds = sorted({(i * 7919) % (30 * 86_400) for i in range(3000)})
    rows = spark.createDataFrame([(s,) for s in seconds], "sec long")
    start, want = None, {}
    for s in seconds:
        start = s if start is None or s >= start + week else start
        want[s] = start
    assert {r.sec: r.period_start_sec for r in periods.anchored_periods(rows, week).collect()} == want


def test_live_job_parses_once_and_keeps_rejects(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for i in range(3):
        lines = [f'h - u [02/Nov/2020:10:0{i}:{s:02d} +0000] "GET /x HTTP/1.0" 200 5' for s in range(30)] + [f"broken {i}"]
        (landing / f"f{i}").write_text("\n".join(lines) + "\n")
        os.utime(landing / f"f{i}", (1_600_000_000 + i, 1_600_000_000 + i))
    job = LiveJob(spark, str(tmp_path / "job"), settings=Settings(stats_period=10))
    job.start(str(landing), max_files=1, availableNow=True).awaitTermination()
    assert sorted((r.line, r.reason) for r in job.rejects().collect()) == [(f"broken {i}", "structure") for i in range(3)]
    assert job.report().select("period_start").distinct().count() >= 6
    job.start(str(landing), max_files=1, availableNow=True).awaitTermination()  # nothing is read twice
    assert job.rejects().count() == 3


def test_live_queries_land_files_in_log_order_and_equal_batch(spark, monkeypatch):
    landed = []
    start = LiveJob.start
    monkeypatch.setattr(LiveJob, "start", lambda job, landing, **more: landed.append(landing) or start(job, landing, **more))
    job = queries._live(spark, "/root/testdata/sf0.001", "live-test")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landed[0])
    times = {r.path: r.modificationTime for r in files.select("path", "modificationTime").collect()}
    parsed = text_log.read_log(spark, landed[0])
    log = text_log.good_rows(parsed)
    spans = parsed.where("ts is not null").groupBy("file").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).collect()
    spans = sorted(spans, key=lambda r: times[r.file])
    assert len(spans) == queries.LANDING_FILES and all(a.last < b.first for a, b in zip(spans, spans[1:]))

    lines = lambda df: sorted(tuple(r) for r in df.collect())
    assert lines(job.rejects().select("line", "reason")) == lines(text_log.rejected_lines(parsed).select("line", "reason")) != []

    period, closed = queries.STATS_PERIOD, F.lit(spans[-1].last) - F.make_dt_interval(secs=F.lit(queries.STREAM_DELAY_SECS))
    ours = job.report().select("period_start", "line_no", "line")
    batch = period_report(stats.in_fixed_periods(stats.partials(log), period), period)
    ended = F.col("period_start") + F.make_dt_interval(secs=F.lit(period)) <= closed
    want = lines(batch.where(ended).select("period_start", "line_no", "line"))
    assert lines(ours) == want != []
