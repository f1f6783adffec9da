import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import fixed
from trafficlens.plans.job import analyse
from trafficlens.session import shared_dir
from trafficlens.sources import text_log

LINE = '127.0.0.1 - u{i} [10/11/2020:16:00:{s:02d} +0000] "GET /a/{i} HTTP/2.0" 200 {i}'


def line(i):
    return LINE.format(i=i, s=i % 60)


def put(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}.tmp")
    with open(hidden, "wb") as f:
        f.write(data)
    os.rename(hidden, os.path.join(folder, name))


def test_lines_end_at_line_feeds_only(spark, tmp_path):
    put(tmp_path, "a.log", b"one\r\n\n\r\ntwo\rthree\nfour\r\r\nlast \xff line")
    got = sorted(r.line for r in text_log.read_lines(spark, str(tmp_path)).collect())
    assert got == sorted(["one", "", "two\rthree", "four\r", "last � line"])


def test_bad_lines_are_set_aside_with_their_file(spark, tmp_path):
    put(tmp_path, "a.log", f"{line(1)}\nbad\n\n{line(2)}\r\n".encode())
    parsed = text_log.read_log(spark, str(tmp_path))
    assert sorted(r.bytes for r in text_log.good_rows(parsed).collect()) == [1, 2]
    (bad,) = text_log.rejected_lines(parsed).collect()
    assert (bad.line, bad.reason) == ("bad", "structure") and bad.file.endswith("a.log")
    assert [tuple(r) for r in text_log.rejects_by_reason(parsed).collect()] == [("structure", 1)]


def test_table_round_trip_and_pruning(spark, tmp_path):
    put(tmp_path / "in", "a.log", "\n".join(line(i) for i in range(50)).encode())
    table = str(tmp_path / "table")
    good = text_log.good_rows(text_log.read_log(spark, str(tmp_path / "in")))
    text_log.write_access_log(good, table)
    back = text_log.read_access_log(spark, table)
    assert sorted(map(tuple, back.drop("log_date").collect())) == sorted(map(tuple, good.collect()))
    pruned = text_log.start_at(back, F.lit(datetime(2020, 11, 10, 16, 0, 30)))
    plan = pruned.select("method")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "resource" not in plan.split("ReadSchema")[1]
    assert pruned.count() == 20


def test_text_sink_keeps_order(spark, tmp_path):
    lines = spark.range(100).select(F.col("id").alias("n"), F.col("id").cast("string").alias("line"))
    text_log.write_text(lines.repartition(7), str(tmp_path / "out"), order=["n"])
    names = sorted(n for n in os.listdir(tmp_path / "out") if n.startswith("part"))
    got = [text for n in names for text in open(tmp_path / "out" / n).read().split()]
    assert got == [str(i) for i in range(100)]


def test_shared_folder_is_the_session_s(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == named.rstrip("/")


def test_whole_job(spark, tmp_path):
    put(tmp_path / "in", "a.log", "\n".join(fixed.REPORT_LINES + ["junk"]).encode())
    put(tmp_path / "in", "b.log", "\r\n".join(fixed.GAUGE_LINES).encode())
    done = analyse(spark, str(tmp_path / "in"), threshold=fixed.GAUGE_THRESHOLD)
    done.write(str(tmp_path / "out"))
    text = lambda what: "".join(
        open(tmp_path / "out" / what / n).read()
        for n in sorted(os.listdir(tmp_path / "out" / what))
        if n.startswith("part")
    )
    assert text("alerts") == fixed.GAUGE_ALERTS
    assert text("report").startswith(fixed.REPORT)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()] == [("structure", 1)]
    assert [(r.line, r.reason) for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == [("junk", "structure")]
    with pytest.raises(ValueError):
        analyse(spark, str(tmp_path / "in"), stats_period=0)


# --- streams ---------------------------------------------------------------------------------


def run(lines, out, check, **trigger):
    writer = lines.writeStream.format("parquet").option("checkpointLocation", str(check))
    writer.trigger(availableNow=True).start(str(out)).awaitTermination()


def test_every_file_is_read_once_as_it_arrives(spark, tmp_path):
    landing, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    total = 0
    for n in range(4):
        put(landing, f"{n}.log", "".join(line(i) + "\n" for i in range(n * 250, (n + 1) * 250)).encode())
        run(text_log.stream_lines(spark, str(landing)), out, check)
        total += 250
        rows = spark.read.parquet(str(out))
        assert (rows.count(), rows.select("line").distinct().count()) == (total, total)


def test_readout_can_be_throttled(spark, tmp_path):
    for n in range(3):
        put(tmp_path / "in", f"{n}.log", f"{line(n)}\n".encode())
    stream = text_log.stream_lines(spark, str(tmp_path / "in"), max_files=1)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    started = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
    started.awaitTermination()
    assert [p["numInputRows"] for p in started.recentProgress if p["numInputRows"]] == [1, 1, 1]
    by_size = text_log.stream_lines(spark, str(tmp_path / "in"), max_bytes=1)
    run(by_size, tmp_path / "out2", tmp_path / "check2")
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


def test_start_from_the_tail(spark, tmp_path):
    put(tmp_path / "in", "old.log", b"old\n")
    put(tmp_path / "in", "new.log", b"new\n")
    now = datetime.now(timezone.utc)
    past = (now - timedelta(days=1)).timestamp()
    os.utime(tmp_path / "in" / "old.log", (past, past))
    since = (now - timedelta(hours=1)).replace(tzinfo=None)
    run(text_log.stream_lines(spark, str(tmp_path / "in"), start_from=since), tmp_path / "out", tmp_path / "check")
    assert [r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new"]
