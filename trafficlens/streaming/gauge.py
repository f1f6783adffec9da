"""Continuous high-traffic gauge.

The stream counts rows per timestamp in closed buckets. Each batch then runs the batch gauge over
the buckets of the period still open, kept in a state table, plus the new ones. The state table has
at most one period's buckets per key and the gauge's state at the start of that period.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.operators.gauge import (
    alerts,
    bucket_counts,
    crossings,
    in_gauge_periods,
    running_average,
    traffic_state,
)
from trafficlens.operators.scan import DAY_SECS, match
from trafficlens.schema import require_positive
from trafficlens.sources.text_log import good_rows

_HITS = ["bucket", "hits", "first_ts", "limit_ts"]


def closed_buckets(
    parsed: DataFrame, bucket_secs: int = 1, *, delay: str = "10 seconds", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per timestamp of buckets the watermark has passed (append mode)."""
    rows = good_rows(parsed).withWatermark("ts", delay)
    # The timestamp is carried as a number so that only the window decides when a group closes.
    return rows.groupBy(
        *keys, F.window("ts", f"{int(bucket_secs)} seconds"), F.unix_micros("ts").alias("ts_micros")
    ).agg(F.count("*").alias("_n")).select(*keys, "window", "ts_micros", "_n")


def judge(
    state: DataFrame | None, new_hits: DataFrame, period_secs: int, threshold: float, *,
    bucket_secs: int = 1, keys: Sequence[str] = (), anchored: bool = False,
) -> DataFrame:
    """Average and state of the buckets in `state` and `new_hits`.

    `is_new` marks buckets not judged before: known ones were, except the last of each key.
    """
    fresh = new_hits.select(*keys, *_HITS)
    if state is None:
        rows = fresh.withColumns({"initial": F.lit(False), "is_new": F.lit(True)})
    else:
        known = state.groupBy(*keys).agg(F.max("initial").alias("_initial"), F.max("bucket").alias("_seen"))
        rows = _per_key(state.select(*keys, *_HITS).unionByName(fresh), known, keys).select(
            *keys,
            *_HITS,
            F.coalesce("_initial", F.lit(False)).alias("initial"),
            F.coalesce(F.col("bucket") >= F.col("_seen"), F.lit(True)).alias("is_new"),
        )
    placed = in_gauge_periods(rows, period_secs, keys=keys, anchored=anchored)
    averages = running_average(placed, bucket_secs=bucket_secs, keys=keys)
    return traffic_state(averages, threshold, keys=keys, block_secs=max(DAY_SECS, 1000 * bucket_secs))


def open_state(states: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The buckets of each key's newest period, with the state the gauge had at its start."""
    newest = (
        states.groupBy(*keys, "period_start_sec")
        .agg(F.min_by("was_high", "bucket").alias("_start"))
        .groupBy(*keys)
        .agg(F.max("period_start_sec").alias("_open"), F.max_by("_start", "period_start_sec").alias("_start"))
    )
    kept = _per_key(states, newest, keys).where(F.col("period_start_sec") == F.col("_open"))
    return kept.select(*keys, *_HITS, F.col("_start").alias("initial"))


def _per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the one row per key of `per_key` (a single row without keys) to `rows`."""
    if keys:
        return match(rows, per_key, keys, "left")
    one = F.lit(1)
    single = F.broadcast(per_key.withColumn("_one", one))  # exactly one row
    return match(rows.withColumn("_one", one), single, ["_one"], "left").drop("_one")


def start_gauge(
    parsed: DataFrame, period_secs: int, threshold: float, path: str, checkpoint: str, *,
    bucket_secs: int = 1, delay: str = "10 seconds", keys: Sequence[str] = (), anchored: bool = False, **trigger,
) -> StreamingQuery:
    """Write alerts under `path/alerts/batch_id=N`; state lives in two alternating folders.

    Batch N reads the folder of N-1 and overwrites the other one and its own alerts, so running a
    batch again after a failure gives the same files.
    """
    require_positive("period_secs", period_secs)
    slot = lambda batch_id: f"{path}/state/slot={batch_id % 2}"

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Kept because several branches start here: the stateful stream must run once per batch.
        per_ts = batch.select(*keys, F.timestamp_micros("ts_micros").alias("ts"), "_n")
        hits = bucket_counts(per_ts, bucket_secs=bucket_secs, threshold=threshold, keys=keys).persist()
        states = None
        try:
            if batch_id and hits.isEmpty():  # nothing has closed: the state goes on as it is
                spark.read.parquet(slot(batch_id - 1)).write.mode("overwrite").parquet(slot(batch_id))
                return
            state = spark.read.parquet(slot(batch_id - 1)) if batch_id else None
            states = judge(
                state, hits, period_secs, threshold, bucket_secs=bucket_secs, keys=keys, anchored=anchored
            ).persist()
            crossed = crossings(states.where("is_new"), threshold, keys=keys)
            alerts(crossed, threshold, keys=keys).write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
            open_state(states, keys=keys).write.mode("overwrite").parquet(slot(batch_id))
        finally:
            for kept in (states, hits):
                if kept is not None:
                    kept.unpersist()

    writer = (
        closed_buckets(parsed, bucket_secs, delay=delay, keys=keys)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(publish).start()
