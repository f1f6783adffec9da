"""Continuous period statistics with Structured Streaming."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.functions.clock import epoch_second
from trafficlens.operators.stats import exploded_dimensions, partials
from trafficlens.plans.report import report_lines
from trafficlens.schema import require_positive
from trafficlens.sources.text_log import good_rows


def _windowed(parsed: DataFrame, period_secs: int, delay: str, origin: int, keys: Sequence[str]) -> DataFrame:
    require_positive("period_secs", period_secs)
    rows = partials(good_rows(parsed), keys=keys).withWatermark("first_ts", delay)
    length = f"{int(period_secs)} seconds"
    return rows.withColumn("window", F.window("first_ts", length, startTime=f"{int(origin)} seconds"))


def period_stats_stream(
    parsed: DataFrame, period_secs: int, *, delay: str = "10 seconds", origin: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per closed period (append mode); rows later than `delay` no longer count."""
    placed = _windowed(parsed, period_secs, delay, origin, keys)
    return placed.groupBy(*keys, "window").agg(
        F.sum("n").alias("n"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
        F.min("first_ts").alias("from_ts"),
    ).select(
        *keys,
        F.col("window.start").alias("period_start"),
        "from_ts",
        "n",
        (F.col("n") / F.lit(period_secs)).alias("rate"),
        "bytes_in",
        "bytes_out",
    )


def start_stats(stats: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write closed periods to Parquet under `path`, exactly once per period."""
    writer = stats.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).format("parquet").start(path)


def start_report(
    parsed: DataFrame, period_secs: int, path: str, checkpoint: str, *,
    delay: str = "10 seconds", origin: int = 0, keys: Sequence[str] = (), **trigger,
) -> StreamingQuery:
    """Write the text report of every closed period under `path/batch_id=N`.

    All groups of a period close in the same batch. A batch that is run again overwrites its own
    folder, so no report appears twice.
    """
    placed = _windowed(parsed, period_secs, delay, origin, keys)
    counted = exploded_dimensions(placed, ["window"], keys=keys)

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("period_start_sec", epoch_second(F.col("window.start"))).drop("window")
        lines = report_lines(rows, period_secs, keys=keys)
        lines.orderBy(*keys, "period_start", "line_no").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = counted.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(publish).start()
