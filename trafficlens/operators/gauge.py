"""High-traffic gauge: when the running average of requests crosses a threshold.

Within a period the average after each occupied bucket is all hits so far over occupied buckets so
far. Above the threshold the state turns on, below it turns off, on the threshold it stays; it
lives on from period to period. A bucket is judged when the next one of its period begins, so the
last bucket of a period is not (unless `flush_last`).
"""

from collections.abc import Sequence
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.clock import epoch_second, floor_to, from_epoch
from trafficlens.functions.render import alert_text, gauge_name
from trafficlens.operators.periods import anchored_periods
from trafficlens.operators.scan import DAY_SECS, match, scan
from trafficlens.schema import require_positive


def hits_per_bucket(
    log: DataFrame, *, bucket_secs: int = 1, threshold: float = 0.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Occupied buckets: `bucket, hits, first_ts, limit_ts`.

    `limit_ts` is the time of the bucket's event number floor(threshold), counting from 0. It only
    depends on the number of rows per timestamp, so rows are counted per timestamp first and no
    bucket is ever sorted row by row.
    """
    per_ts = log.groupBy(*keys, "ts").agg(F.count("*").alias("_n"))
    return bucket_counts(per_ts, bucket_secs=bucket_secs, threshold=threshold, keys=keys)


def bucket_counts(
    per_ts: DataFrame, *, bucket_secs: int = 1, threshold: float = 0.0, keys: Sequence[str] = ()
) -> DataFrame:
    """`hits_per_bucket` from rows already counted per timestamp (`ts`, `_n`)."""
    require_positive("bucket_secs", bucket_secs)
    bucket = floor_to(epoch_second(F.col("ts")), bucket_secs)
    so_far = Window.partitionBy(*keys, "bucket").orderBy("ts")
    counted = per_ts.withColumn("bucket", bucket).withColumn("_cum", F.sum("_n").over(so_far))
    return counted.groupBy(*keys, "bucket").agg(
        F.sum("_n").alias("hits"),
        F.min("ts").alias("first_ts"),
        F.min(F.when(F.col("_cum") > floor(threshold), F.col("ts"))).alias("limit_ts"),
    )


def in_gauge_periods(
    hits: DataFrame, period_secs: int, *, keys: Sequence[str] = (), anchored: bool = False, origin: int = 0
) -> DataFrame:
    """Add `period_start_sec`, on a grid or anchored on the data."""
    require_positive("period_secs", period_secs)
    if not anchored:
        return hits.withColumn("period_start_sec", floor_to(F.col("bucket"), period_secs, origin))
    starts = anchored_periods(
        hits.select(*keys, F.col("bucket").alias("sec")), period_secs, keys=keys
    ).withColumnRenamed("sec", "bucket")
    return match(hits, starts, [*keys, "bucket"])


def running_average(
    placed: DataFrame, *, bucket_secs: int = 1, keys: Sequence[str] = (), densify: bool = False
) -> DataFrame:
    """Add `buckets`, `cum` and `average` so far in the period, and what the next bucket brings.

    With `densify`, silent buckets between two occupied ones count as buckets of no hits.
    """
    period = Window.partitionBy(*keys, "period_start_sec").orderBy("bucket")
    upcoming = placed.withColumns(
        {"next_bucket": F.lead("bucket").over(period), "next_first_ts": F.lead("first_ts").over(period)}
    )
    if densify:
        upcoming = _with_silent(upcoming, bucket_secs)
    so_far = period.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return upcoming.withColumns(
        {"buckets": F.row_number().over(period).cast("long"), "cum": F.sum("hits").over(so_far)}
    ).withColumn("average", F.col("cum") / F.col("buckets"))


def _with_silent(upcoming: DataFrame, bucket_secs: int) -> DataFrame:
    """Fill up to the next occupied bucket of the same period, a period's worth of rows at most."""
    last = F.coalesce(F.col("next_bucket") - bucket_secs, F.col("bucket"))
    filled = upcoming.withColumn("_at", F.explode(F.sequence(F.col("bucket"), last, F.lit(bucket_secs).cast("long"))))
    real = F.col("_at") == F.col("bucket")
    return filled.withColumns(
        {
            "hits": F.when(real, F.col("hits")).otherwise(F.lit(0).cast("long")),
            "first_ts": F.when(real, F.col("first_ts")),
            "limit_ts": F.when(real, F.col("limit_ts")),
            "bucket": F.col("_at"),
        }
    ).drop("_at")


def traffic_state(
    averages: DataFrame, threshold: float, *, keys: Sequence[str] = (), flush_last: bool = False,
    initial: bool = False, block_secs: int = DAY_SECS,
) -> DataFrame:
    """Add `is_high` after each bucket and `was_high` before it.

    `initial` is the state before the first bucket; a column `initial` of `averages` (constant per
    key) is taken instead when there is one.
    """
    judged = F.lit(True) if flush_last else F.col("next_bucket").isNotNull()
    sign = F.when(judged & (F.col("average") > threshold), F.lit(True)).when(
        judged & (F.col("average") < threshold), F.lit(False)
    )
    signed = averages.withColumn("_sign", sign)
    before = scan(signed, "bucket", keys=keys, lasts={"_before": F.col("_sign")}, blocks=(block_secs,))
    start = F.col("initial") if "initial" in averages.columns else F.lit(initial)
    was_high = F.coalesce(F.col("_before"), start)
    return before.withColumns(
        {"was_high": was_high, "is_high": F.coalesce(F.col("_sign"), was_high)}
    ).drop("_sign", "_before")


def crossings(states: DataFrame, threshold: float, *, keys: Sequence[str] = ()) -> DataFrame:
    """State changes: position in the period's events, average, and the time it happened.

    Going up, the position is the event that exceeds the threshold within the bucket; going down,
    the first event of the next bucket. A period's last bucket, judged only with `flush_last`, has no
    next one: its own first event stands in.
    """
    before_bucket = F.col("cum") - F.col("hits")
    up = F.col("is_high")
    return states.where(F.col("is_high") != F.col("was_high")).select(
        *keys,
        "period_start_sec",
        "bucket",
        up.alias("is_up"),
        F.when(up, before_bucket + floor(threshold)).otherwise(F.col("cum")).alias("position"),
        "average",
        F.when(up, F.col("limit_ts")).otherwise(F.coalesce("next_first_ts", "first_ts")).alias("crossed_ts"),
    )


def gauge(
    log: DataFrame, period_secs: int, threshold: float, *, bucket_secs: int = 1, keys: Sequence[str] = (),
    anchored: bool = False, origin: int = 0, densify: bool = False, flush_last: bool = False,
) -> DataFrame:
    """All buckets of the log with average and state."""
    hits = hits_per_bucket(log, bucket_secs=bucket_secs, threshold=threshold, keys=keys)
    placed = in_gauge_periods(hits, period_secs, keys=keys, anchored=anchored, origin=origin)
    averages = running_average(placed, bucket_secs=bucket_secs, keys=keys, densify=densify)
    return traffic_state(
        averages, threshold, keys=keys, flush_last=flush_last, block_secs=max(DAY_SECS, 1000 * bucket_secs)
    )


def traffic_crossings(log: DataFrame, period_secs: int, threshold: float, *, keys: Sequence[str] = (), **options) -> DataFrame:
    return crossings(gauge(log, period_secs, threshold, keys=keys, **options), threshold, keys=keys)


def alerts(crossed: DataFrame, threshold: float, *, keys: Sequence[str] = ()) -> DataFrame:
    """Crossings as alert lines, with their bucket to order them by."""
    return crossed.select(
        *keys,
        from_epoch(F.col("bucket")).alias("bucket_ts"),
        alert_text(
            gauge_name(threshold), F.col("is_up"), F.col("position"), F.col("average"), F.col("crossed_ts")
        ).alias("line"),
    )
