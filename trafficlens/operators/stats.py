"""Traffic statistics per period.

Every function takes rows in the partial form of `partials` or `second_partials`: a raw log row is
the partial of itself. Counts and sums are plain sums over partials, so the same code serves raw
rows, per-second rollups and already assigned periods, and Spark combines on the map side.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions import derive
from trafficlens.functions.clock import epoch_second, floor_to, from_epoch
from trafficlens.operators.periods import anchored_periods, with_period_lengths
from trafficlens.operators.scan import DAY_SECS, match, scan, whole_row
from trafficlens.schema import require_positive

DIMENSIONS = ["section", "method", "version", "category"]
MEASURES = ["n", "bytes_in", "bytes_out", "first_ts"]

# Fixed value: entries per list in a report.
TOP = 10


def partials(log: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Raw access-log rows as partial statistics, one row each (narrow, no shuffle)."""
    return log.select(
        *keys,
        epoch_second(F.col("ts")).alias("sec"),
        "section",
        "method",
        "version",
        derive.status_category(F.col("status")).alias("category"),
        F.lit(1).cast("long").alias("n"),
        derive.in_bytes(F.col("method"), F.col("bytes")).alias("bytes_in"),
        derive.out_bytes(F.col("method"), F.col("bytes")).alias("bytes_out"),
        F.col("ts").alias("first_ts"),
    )


def _measures() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
        F.min("first_ts").alias("first_ts"),
    ]


def rollup(parts: DataFrame, secs: int, *, keys: Sequence[str] = (), dims: Sequence[str] = ()) -> DataFrame:
    """Merge partials into cells of `secs` seconds; feed the result to a longer rollup."""
    require_positive("secs", secs)
    cell = parts.withColumn("sec", floor_to(F.col("sec"), secs))
    return cell.groupBy(*keys, "sec", *dims).agg(*_measures())


def in_fixed_periods(parts: DataFrame, period_secs: int, *, origin: int = 0) -> DataFrame:
    """Add `period_start_sec` on a grid."""
    require_positive("period_secs", period_secs)
    return parts.withColumn("period_start_sec", floor_to(F.col("sec"), period_secs, origin))


def in_anchored_periods(
    log: DataFrame, period_secs: int, *, keys: Sequence[str] = (), dims: Sequence[str] = DIMENSIONS,
    block_secs: int | None = None,
) -> DataFrame:
    """Per-second partials of `log` with the `period_start_sec` of their data-anchored period.

    The log is folded to seconds before it meets the periods, so a busy second is no join hot spot.
    """
    seconds = rollup(partials(log, keys=keys), 1, keys=keys, dims=dims)
    occupied = seconds.groupBy(*keys, "sec").agg(whole_row(seconds).alias("_whole"))
    occupied = occupied.where(F.col("_whole").isNotNull()).select(*keys, "sec")
    periods = anchored_periods(occupied, period_secs, keys=keys, block_secs=block_secs)
    return match(seconds, periods, [*keys, "sec"])


def period_stats(placed: DataFrame, period_secs: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per period: bounds, count, rate over the period length, bytes in, out and total."""
    facts = placed.groupBy(*keys, "period_start_sec").agg(*_measures())
    return facts.select(
        *keys,
        from_epoch(F.col("period_start_sec")).alias("period_start"),
        from_epoch(F.col("period_start_sec") + (period_secs - 1)).alias("period_end"),
        F.col("first_ts").alias("from_ts"),
        "n",
        (F.col("n") / F.lit(period_secs)).alias("rate"),
        "bytes_in",
        "bytes_out",
        (F.col("bytes_in") + F.col("bytes_out")).alias("bytes_total"),
    )


def count_per(placed: DataFrame, dim: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per period and value of one dimension; rows without a value are left out."""
    return (
        placed.where(F.col(dim).isNotNull())
        .groupBy(*keys, from_epoch(F.col("period_start_sec")).alias("period_start"), dim)
        .agg(F.sum("n").alias("n"))
    )


def all_dimensions(placed: DataFrame, *, keys: Sequence[str] = (), folded: bool = False) -> DataFrame:
    """Period facts and the counts of all four dimensions in one pass over `placed`.

    `dim` is null on the facts row, else the dimension the row counts and `value` its value. Bytes
    and first timestamp are those of the row's group. Grouping sets repeat every row five times, so rows are folded
    to one per period and combination of values first, unless they are `folded` already.
    """
    base = [*keys, "period_start_sec"]
    if not folded:
        placed = placed.groupBy(*base, *DIMENSIONS).agg(*_measures())
    sets = [base, *[[*base, d] for d in DIMENSIONS]]
    grouped = placed.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*base, *DIMENSIONS]]
    ).agg(F.grouping_id().alias("_gid"), *_measures())
    return _label_sets(grouped, base).where(F.col("dim").isNull() | F.col("value").isNotNull())


def _label_sets(grouped: DataFrame, base: Sequence[str]) -> DataFrame:
    """Turn the grouping id (a bit per dimension left out, first dimension highest) into a name."""
    width = len(DIMENSIONS)
    all_out = 2**width - 1
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(DIMENSIONS):
        only = F.col("_gid") == all_out - 2 ** (width - 1 - i)
        dim = F.when(only, F.lit(name)).otherwise(dim)
        value = F.when(only, F.col(name)).otherwise(value)
    return grouped.select(*base, dim.alias("dim"), value.alias("value"), *MEASURES)


def exploded_dimensions(placed: DataFrame, period: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """`all_dimensions` for a stream: one row per set first, then an ordinary group-by."""
    none = F.lit(None).cast("string")
    entry = lambda dim, value: F.struct(dim.alias("dim"), value.alias("value"))
    sets = F.array(entry(none, none), *[entry(F.lit(d), F.col(d)) for d in DIMENSIONS])
    rows = placed.select(*keys, *period, *MEASURES, F.inline(sets))
    counted = rows.where(F.col("dim").isNull() | F.col("value").isNotNull())
    return counted.groupBy(*keys, *period, "dim", "value").agg(*_measures())


def dimension_counts(placed: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per period, dimension and value."""
    return all_dimensions(placed, keys=keys).where(F.col("dim").isNotNull()).select(
        *keys, from_epoch(F.col("period_start_sec")).alias("period_start"), "dim", "value", "n"
    )


def ranked(counts: DataFrame, period: Sequence[str], *, keys: Sequence[str] = (), top: int = TOP) -> DataFrame:
    """Keep the `top` values per period and dimension, count then value descending, with `rank`.

    Spark limits each map task to `top` rows per group before the shuffle.
    """
    order = Window.partitionBy(*keys, *period, "dim").orderBy(F.desc("n"), F.desc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_per_dimension(placed: DataFrame, *, keys: Sequence[str] = (), top: int = TOP) -> DataFrame:
    return ranked(dimension_counts(placed, keys=keys), ["period_start"], keys=keys, top=top)


def multi_period_stats(
    log: DataFrame, lengths: Sequence[int], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Statistics for several period lengths from one scan: fold to the common divisor first."""
    for length in lengths:
        require_positive("period_secs", length)
    common = _common_divisor(lengths)
    placed = with_period_lengths(rollup(partials(log, keys=keys), common, keys=keys), lengths)
    return placed.groupBy(*keys, "period_secs", "period_start_sec").agg(*_measures()).select(
        *keys,
        "period_secs",
        from_epoch(F.col("period_start_sec")).alias("period_start"),
        "n",
        (F.col("n") / F.col("period_secs")).alias("rate"),
        "bytes_in",
        "bytes_out",
    )


def _common_divisor(lengths: Sequence[int]) -> int:
    from math import gcd

    return gcd(*[int(n) for n in lengths])


def byte_alarm(
    log: DataFrame, period_secs: int, limit: int, *, keys: Sequence[str] = ()
) -> DataFrame:
    """The first period in which bytes cumulated over all periods reach `limit` (one row per key)."""
    placed = in_fixed_periods(partials(log, keys=keys), period_secs)
    per_period = placed.groupBy(*keys, "period_start_sec").agg(
        F.sum("n").alias("lines"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes")
    )
    running = scan(
        per_period,
        "period_start_sec",
        keys=keys,
        totals={"lines_before": F.col("lines"), "bytes_before": F.col("bytes")},
        blocks=(max(DAY_SECS, 1000 * period_secs),),
    )
    reached = running.select(
        *keys,
        "period_start_sec",
        (F.col("lines_before") + F.col("lines")).alias("total_lines"),
        (F.col("bytes_before") + F.col("bytes")).alias("total_bytes"),
    ).where(F.col("total_bytes") >= F.lit(limit))
    first = reached.groupBy(*keys).agg(
        F.min_by(F.struct("period_start_sec", "total_lines", "total_bytes"), "period_start_sec").alias("f")
    )
    return first.where(F.col("f").isNotNull()).select(
        *keys,
        from_epoch(F.col("f.period_start_sec")).alias("period_start"),
        F.col("f.total_lines").alias("total_lines"),
        F.col("f.total_bytes").alias("total_bytes"),
    )
