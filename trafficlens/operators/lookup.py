"""Time lookups over the log: intervals, neighbours in time, positions, retention."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import epoch_second
from trafficlens.operators.scan import DAY_SECS, match, scan
from trafficlens.schema import require_positive
from trafficlens.session import written

# Ticks per second of the supported resolutions and rows per block for each (see `scan`).
RESOLUTIONS = {
    "second": (F.unix_seconds, (DAY_SECS,)),
    "millisecond": (F.unix_millis, (DAY_SECS, 65_536)),
    "microsecond": (F.unix_micros, (DAY_SECS, 65_536, 65_536)),
}


def fetch_interval(log: DataFrame, start: Column, end: Column, *, ts: str = "ts") -> DataFrame:
    """Rows from `start` to `end`, both inclusive at one second resolution.

    Written as plain bounds on `ts`, so they reach the file scan and prune it.
    """
    same_type = log.schema[ts].dataType
    first = F.date_trunc("second", start).cast(same_type)
    after = (F.date_trunc("second", end) + F.expr("interval 1 second")).cast(same_type)
    return log.where((F.col(ts) >= first) & (F.col(ts) < after))


def fetch_intervals(
    log: DataFrame, intervals: DataFrame, *, ts: str = "ts", keys: Sequence[str] = (),
    block_secs: int = 3600,
) -> DataFrame:
    """Rows of `log` inside each of many `intervals` (`start_sec`, `end_sec`, inclusive).

    Intervals are laid out on blocks of time so that rows meet them by equality; choose `block_secs` near
    the usual length of an interval. Spark splits a block that holds much of the log at run time.
    """
    require_positive("block_secs", block_secs)
    block = lambda sec: F.floor(sec / block_secs).cast("long")
    spread = intervals.select(
        "*", F.explode(F.sequence(block(F.col("start_sec")), block(F.col("end_sec")))).alias("_block")
    )
    rows = log.withColumn("_sec", epoch_second(F.col(ts))).withColumn("_block", block(F.col("_sec")))
    joined = match(rows, spread, [*keys, "_block"])
    return joined.where(F.col("_sec").between(F.col("start_sec"), F.col("end_sec"))).drop("_sec", "_block")


# Seconds of a block grow by this factor from level to level.
_FAN = 16
# Levels up to a block that holds all time there is.
_LEVELS = 11


def interval_cover(intervals: DataFrame) -> DataFrame:
    """Each interval (`start_sec`, `end_sec`, inclusive) as blocks `_level, _block`: disjoint, of _FAN ** level seconds
    each, aligned, and together exactly the interval; at most 2 x (_FAN - 1) of a level, however long it is.

    An interval that ends before it starts gets none.
    """
    size = lambda level: F.pow(F.lit(float(_FAN)), level).cast("long")
    up = lambda sec, level: -F.floor(-sec / size(level)).cast("long")
    down = lambda sec, level: F.floor(sec / size(level)).cast("long")
    start, stop, level = F.col("start_sec"), F.col("end_sec") + 1, F.col("_level")
    leveled = intervals.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))))
    # Whole blocks of this level, less those that make up whole blocks of the next one.
    leveled = leveled.withColumns({"_from": up(start, level), "_to": down(stop, level)}).where("_from < _to")
    above_from, above_to = up(start, level + 1) * _FAN, down(stop, level + 1) * _FAN
    whole = (above_from >= above_to) | (level == _LEVELS - 1)
    leveled = leveled.withColumns(
        {"_left": F.when(whole, F.col("_to")).otherwise(above_from), "_right": F.when(whole, F.col("_to")).otherwise(above_to)}
    )
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    blocks = F.concat(run(F.col("_from"), F.col("_left")), run(F.col("_right"), F.col("_to")))
    return leveled.withColumn("_block", F.explode(blocks)).drop("_from", "_to", "_left", "_right")


def fetch_intervals_mixed(log: DataFrame, intervals: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """`fetch_intervals` for intervals of very different lengths, from a second to the whole log.

    An interval is laid out on a number of blocks that grows with the logarithm of its length, and a log row meets
    one block per level that occurs, so that rows and intervals still meet by equality. The levels in use, eleven at
    most, are looked up first. Blocks make up exactly the interval: what meets belongs to it.
    """
    cover = written(interval_cover(intervals), "interval-cover")
    levels = sorted(r["_level"] for r in cover.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    rows = log.withColumn("_sec", epoch_second(F.col(ts)))
    at = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col("_sec") / _FAN**n).cast("long").alias("_block")) for n in levels])
    rows = rows.select("*", F.inline(at)).drop("_sec")
    return match(rows, cover, [*keys, "_level", "_block"]).drop("_level", "_block")


def first_timestamp(log: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """First timestamp as epoch milliseconds, -1 for an empty log (per key there is none then)."""
    found = log.groupBy(*keys).agg(F.min(ts).alias("_ts"))
    return found.select(*keys, F.coalesce(F.unix_millis("_ts"), F.lit(-1).cast("long")).alias("first_millis"))


_EVENT, _PROBE = 1, 2


def _neighbours(probes: DataFrame, log: DataFrame, probe_ts: str, ts: str, keys: Sequence[str], resolution: str):
    """Per distinct probe position: is there an event, the one before, the one after."""
    tick, blocks = RESOLUTIONS[resolution]
    place = lambda df, column, kind: df.select(*keys, tick(F.col(column)).alias("at"), F.lit(kind).alias("kind"))
    positions = place(log, ts, _EVENT).unionByName(place(probes, probe_ts, _PROBE))
    distinct = positions.groupBy(*keys, "at").agg(F.bit_or("kind").alias("kind"))
    has = lambda kind: F.col("kind").bitwiseAND(F.lit(kind)) != 0
    event_at = F.when(has(_EVENT), F.col("at"))
    around = scan(distinct, "at", keys=keys, lasts={"before": event_at}, nexts={"after": event_at}, blocks=blocks)
    return around.where(has(_PROBE)).withColumn("event", has(_EVENT)), tick


def next_after(
    probes: DataFrame, log: DataFrame, *, probe_ts: str = "ts", ts: str = "ts", keys: Sequence[str] = ()
) -> DataFrame:
    """Probes with `next_sec`, the first occupied second strictly after the probe's, or -1."""
    found, _ = _neighbours(probes, log, probe_ts, ts, keys, "second")
    answer = found.select(*keys, F.col("at").alias("_at"), F.coalesce("after", F.lit(-1).cast("long")).alias("next_sec"))
    return _answer(probes, answer, epoch_second(F.col(probe_ts)), keys)


def nearest(
    probes: DataFrame, log: DataFrame, *, probe_ts: str = "ts", ts: str = "ts", keys: Sequence[str] = (),
    resolution: str = "second",
) -> DataFrame:
    """Probes with `nearest_at`, the event time closest to the probe; the earlier one on a tie.

    In ticks of `resolution` since 1970; null only when there is no event for the key. Answers are
    found once per distinct probe position.
    """
    found, tick = _neighbours(probes, log, probe_ts, ts, keys, resolution)
    at, before, after = F.col("at"), F.col("before"), F.col("after")
    closest = (
        F.when(F.col("event"), at)
        .when(before.isNull(), after)
        .when(after.isNull(), before)
        .when(at - before <= after - at, before)
        .otherwise(after)
    )
    answer = found.select(*keys, at.alias("_at"), closest.alias("nearest_at"))
    return _answer(probes, answer, tick(F.col(probe_ts)), keys)


def _answer(probes: DataFrame, answer: DataFrame, position: Column, keys: Sequence[str]) -> DataFrame:
    """Give the answer per position back to every probe. There is one answer per position; Spark splits the
    probes of a position that holds many of them at run time."""
    return match(probes.withColumn("_at", position), answer, [*keys, "_at"]).drop("_at")


def second_extent(log: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """First and last position in time order of the rows of each second, from counts alone."""
    per_second = log.groupBy(*keys, epoch_second(F.col(ts)).alias("sec")).agg(F.count("*").alias("n"))
    placed = scan(per_second, "sec", keys=keys, totals={"first_index": F.col("n")})
    return placed.withColumn("last_index", F.col("first_index") + F.col("n") - 1)


def retention_tail(log: DataFrame, lengths: Sequence[int], *, ts: str = "ts") -> DataFrame:
    """Rows still needed when the longest of the period `lengths` rules what is kept."""
    for length in lengths:
        require_positive("period_secs", length)
    newest = log.agg(F.max(ts)).scalar()
    return log.where(F.col(ts) >= newest - F.make_dt_interval(secs=F.lit(max(lengths))))


def append_batches(*batches: DataFrame, order: Sequence[str] = ("ts",), arrival: Sequence[str] = ()) -> DataFrame:
    """All rows of all batches in time order; of one time, rows of an earlier batch come first.

    Within a batch rows of one time are in the order of `arrival`: columns that tell when a row arrived,
    such as a sequence number, or a file's time, path and block start. A table does not remember it;
    without these columns the order of such rows is open. A range partitioned sort, in which `arrival` also
    lets Spark divide a moment that holds a large share of the rows among several partitions.
    """
    combined = batches[0].withColumn("_batch", F.lit(0))
    for i, batch in enumerate(batches[1:], 1):
        combined = combined.unionByName(batch.withColumn("_batch", F.lit(i)))
    return combined.orderBy(*order, "_batch", *arrival).drop("_batch")
