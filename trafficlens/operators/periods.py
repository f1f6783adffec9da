"""Assigning log rows to periods: fixed grid, several lengths at once, anchored on the data."""

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.clock import epoch_second, floor_to, from_epoch
from trafficlens.operators.scan import DAY_SECS, match, scan
from trafficlens.schema import require_positive


# The helpers below run inside tasks; sent by value they need no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A second before any log row: a new period may start at once.
_NEVER = -(2**62)
# Seconds from the first to the last timestamp there can be (years 1 to 9999), rounded up.
_SPAN_SECS = 2**39
# Rows of a group in which functions of blocks are put together, about.
FAN_ROWS = 2**21


def with_fixed_period(rows: DataFrame, period_secs: int, *, ts: str = "ts", origin: int = 0) -> DataFrame:
    """Add `period_start` and `period_end` (both inclusive) on a grid of `period_secs`."""
    require_positive("period_secs", period_secs)
    start = floor_to(epoch_second(F.col(ts)), period_secs, origin)
    return rows.withColumns(
        {"period_start": from_epoch(start), "period_end": from_epoch(start + (period_secs - 1))}
    )


def with_period_lengths(rows: DataFrame, lengths: Sequence[int], *, sec: str = "sec") -> DataFrame:
    """Each row once per period length, shortest first, with `period_secs` and `period_start_sec`.

    Meant for partial aggregates: exploding raw rows would multiply the log by the lengths.
    """
    for length in lengths:
        require_positive("period_secs", length)
    lengths = sorted(set(lengths))
    per_length = [
        F.struct(F.lit(n).alias("period_secs"), floor_to(F.col(sec), n).alias("period_start_sec"))
        for n in lengths
    ]
    return rows.select("*", F.inline(F.array(*per_length)))


def occupied_seconds(rows: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and second that has at least one log row."""
    return rows.select(*keys, epoch_second(F.col(ts)).alias("sec")).distinct()


def anchored_periods(
    seconds: DataFrame, period_secs: int, *, keys: Sequence[str] = (), block_secs: int | None = None,
    fan: int | None = None,
) -> DataFrame:
    """Give every occupied second its data-anchored period: `keys, sec, period_start_sec`.

    A period starts at the first occupied second after the one before has ended, so every start
    depends on all earlier ones. The chain is cut at block edges. All it can carry over an edge is
    the second from which a new period may start, so:

    1. each block reports, per second a chain may enter it by, where that chain leaves it: a monotone
       step function of at most `period_secs` + 1 steps;
    2. the functions of `fan` neighbouring blocks are composed to that of a larger block, and so on up to
       a block that holds any time there is;
    3. from there down, each block hands its entry on through the blocks it consists of;
    4. each block of seconds, now knowing its entry, assigns its seconds.

    A group holds the seconds of one block or `fan` functions, about FAN_ROWS rows, however long the log of a key
    is; the number of shuffles depends on the block length only.
    """
    require_positive("period_secs", period_secs)
    period = int(period_secs)
    block = int(block_secs or max(DAY_SECS, 32 * period))
    if block < period:
        raise ValueError("block_secs must not be shorter than the period")
    fan = int(fan or min(max(FAN_ROWS // (period + 1), 2), 4096))
    require_positive("fan - 1", fan - 1)
    # Blocks are numbered from before the first timestamp there can be, so that one of the top level holds all.
    first = -(-_SPAN_SECS // 2 // block)
    levels, size = 1, fan
    while size < 2 * first + 2:
        levels, size = levels + 1, size * fan
    group, above = [*keys, "_block"], [*keys, "_above"]
    number = F.floor(F.col("sec") / block).cast("long") + first
    marked = seconds.select(*keys, "sec", number.alias("_block"))
    key_fields = [marked.schema[k] for k in keys]
    fields = lambda *names: T.StructType([*key_fields, *[T.StructField(n, T.LongType()) for n in names]])

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        secs = np.sort(pdf["sec"].to_numpy())
        free_at = _chain_exits(secs, period)
        edge = (int(pdf["_block"].iloc[0]) - first) * block + period
        return _frame(pdf, group, **_steps(secs, free_at, edge))

    def functions(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
        pdf = pdf.sort_values(["_block", "entry"], kind="stable")
        blocks, starts = np.unique(pdf["_block"].to_numpy(), return_index=True)
        entry, free_at = np.split(pdf["entry"].to_numpy(), starts[1:]), np.split(pdf["free_at"].to_numpy(), starts[1:])
        return list(zip(blocks.tolist(), entry, free_at))

    def composer(level: int):
        def compose(pdf: pd.DataFrame) -> pd.DataFrame:
            number = int(pdf["_above"].iloc[0])
            edge = (number * fan ** (level + 1) - first) * block + period
            entries = exits = np.zeros(0, dtype="int64")
            for _, entry, free_at in functions(pdf):
                # What has come in so far goes on; later seconds may be the first to be met.
                exits = _through(entry, free_at, exits)
                later = entry > entries[-1] if len(entries) and entries[-1] < edge else np.full(len(entry), not len(entries))
                entries, exits = np.append(entries, entry[later]), np.append(exits, free_at[later])
            return _frame(pdf, keys, _block=number, **_steps(entries, exits, edge))

        return compose

    def link(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({n: [] for n in [*keys, "_block", "free_at"]})
        now = int(carried["free_at"].iloc[0]) if len(carried) else _NEVER
        blocks, entered = [], []
        for number, entry, free_at in functions(pdf):
            blocks.append(number)
            entered.append(now)
            now = int(_through(entry, free_at, np.array([now]))[0])
        return _frame(pdf, keys, _block=blocks, free_at=entered)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        secs = np.sort(pdf["sec"].to_numpy())
        starts = _chain_starts(secs, int(pdf["free_at"].iloc[0]), period)
        return _frame(pdf, keys, sec=secs, period_start_sec=starts)

    up = lambda df: df.withColumn("_above", F.floor(F.col("_block") / fan).cast("long"))
    parts = [up(marked.groupBy(*group).applyInPandas(report, fields("_block", "entry", "free_at")))]
    for level in range(levels - 1):
        composed = parts[-1].groupBy(*above).applyInPandas(composer(level), fields("_block", "entry", "free_at"))
        parts.append(up(composed))
    carried = None
    for functions_of in reversed(parts):
        of_blocks, out = functions_of.groupBy(*above), fields("_block", "free_at")
        if carried is None:  # every chain begins at the top
            nothing = pd.DataFrame({"free_at": []})
            carried = of_blocks.applyInPandas(lambda pdf: link(pdf, nothing), out)
        else:
            entered = carried.withColumnRenamed("_block", "_above")
            carried = of_blocks.cogroup(entered.groupBy(*above)).applyInPandas(link, out)
    return match(marked, carried, group).groupBy(*group).applyInPandas(assign, fields("sec", "period_start_sec"))


def _steps(entries: np.ndarray, exits: np.ndarray, edge: int) -> dict[str, np.ndarray]:
    """The step function for chains that enter up to `edge`. Of neighbours with the same exit the last one stands
    for all: lookups take the first entry not before the carried second."""
    last = min(int(np.searchsorted(entries, edge)), len(entries) - 1)
    entries, exits = entries[: last + 1], exits[: last + 1]
    keep = np.append(exits[1:] != exits[:-1], True)
    return {"entry": entries[keep], "free_at": exits[keep]}


def _through(entry: np.ndarray, free_at: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Where chains that carry `now` leave a block; those beyond its last entry pass unchanged."""
    at = np.searchsorted(entry, now)
    return np.where(at < len(entry), free_at[np.minimum(at, len(entry) - 1)], now)


def _frame(pdf: pd.DataFrame, constant: Sequence[str], **columns) -> pd.DataFrame:
    return pd.DataFrame({**{k: pdf[k].iloc[0] for k in constant}, **columns})


def _chain_exits(secs: np.ndarray, period: int) -> np.ndarray:
    """Per second, when the last period of the chain starting there ends, within the block.

    Each second points to the one that opens the next period; pointers are doubled until all have left.
    """
    count = len(secs)
    last = np.arange(count)
    jump = np.append(np.searchsorted(secs, secs + period), count)
    while (ahead := jump[last] < count).any():
        last = np.where(ahead, jump[last], last)
        # A doubled pointer that leaves the block is walked in single steps by the rounds that follow.
        doubled = jump[jump]
        jump = np.where(doubled < count, doubled, jump)
    return secs[last] + period


def _chain_starts(secs: np.ndarray, free_at: int, period: int) -> np.ndarray:
    """Period start of each second when a new period may start from `free_at` on."""
    starts = np.empty(len(secs), dtype="int64")
    at = int(np.searchsorted(secs, free_at))
    starts[:at] = free_at - period
    while at < len(secs):
        end = int(np.searchsorted(secs, secs[at] + period))
        starts[at:end] = secs[at]
        at = end
    return starts


def with_anchored_period(
    rows: DataFrame,
    period_secs: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    block_secs: int | None = None,
) -> DataFrame:
    """Add `period_start` and `period_end` of the data-anchored period to every log row.

    The log joins its own occupied seconds, one row each; Spark splits the rows of a second that holds
    much of the log at run time.
    """
    periods = anchored_periods(
        occupied_seconds(rows, ts=ts, keys=keys), period_secs, keys=keys, block_secs=block_secs
    ).withColumnRenamed("sec", "_sec")
    start = F.col("period_start_sec")
    return match(rows.withColumn("_sec", epoch_second(F.col(ts))), periods, [*keys, "_sec"]).select(
        *rows.columns,
        from_epoch(start).alias("period_start"),
        from_epoch(start + (period_secs - 1)).alias("period_end"),
    )


def densify(
    stats: DataFrame, period_secs: int, zeros: Sequence[str], *, keys: Sequence[str] = (), start: str = "period_start"
) -> DataFrame:
    """Add the silent periods between the first and the last one on a grid of `period_secs`.

    Columns in `zeros` are 0 there, all others null. A gap is filled in runs of 4,096 periods so
    that no row ever holds a long silence as one array.
    """
    run = 4096
    sec = epoch_second(F.col(start))
    ahead = scan(stats.withColumn("_sec", sec), "_sec", keys=keys, nexts={"_next": F.col("_sec")},
                 blocks=(max(DAY_SECS, 1000 * period_secs),))
    steps = F.coalesce((F.col("_next") - F.col("_sec")) / period_secs, F.lit(1)).cast("long")
    runs = ahead.withColumn("_steps", steps).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_steps") - 1) / run))).alias("_run")
    )
    last = F.least(F.col("_steps") - 1, F.col("_run") * run + (run - 1))
    filled = runs.select("*", F.explode(F.sequence(F.col("_run") * run, last)).alias("_step"))
    real = F.col("_step") == 0

    def column(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name == start:
            return from_epoch(F.col("_sec") + F.col("_step") * period_secs).cast(stats.schema[name].dataType).alias(name)
        value = F.when(real, F.col(name))
        return (value.otherwise(F.lit(0)) if name in zeros else value).alias(name)

    return filled.select(*[column(name) for name in stats.columns])


def apply_per_period(
    rows: DataFrame,
    period_secs: int,
    fn: Callable[[GroupedData], DataFrame],
    *,
    keys: Sequence[str] = (),
    anchored: bool = False,
    ts: str = "ts",
) -> DataFrame:
    """User-defined periodic computation as native aggregates: `fn` gets the rows grouped by period."""
    place = (
        with_anchored_period(rows, period_secs, ts=ts, keys=keys)
        if anchored
        else with_fixed_period(rows, period_secs, ts=ts)
    )
    return fn(place.groupBy(*keys, "period_start", "period_end"))


def apply_per_period_pandas(
    rows: DataFrame,
    period_secs: int,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType,
    *,
    keys: Sequence[str] = (),
    anchored: bool = False,
    ts: str = "ts",
    spread: int = 64,
) -> DataFrame:
    """User-defined periodic computation in pandas, for what native aggregates cannot say.

    A period may hold any share of the log, so it is never handed over whole. `partial` turns a
    batch of rows of one period into rows of `schema`; `merge` folds several such results of one
    period into one of the same schema, and must not care how they are grouped. Merging goes by
    `spread` parts of a period first and then by period. Rows are sorted by period within their
    partition, so that a batch holds few periods however the log is ordered.
    """
    partials = period_partials(rows, period_secs, partial, schema, keys=keys, anchored=anchored, ts=ts)
    return merged_partials(partials, merge, schema, keys=keys, spread=spread)


def period_partials(
    rows: DataFrame, period_secs: int, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, *,
    keys: Sequence[str] = (), anchored: bool = False, ts: str = "ts",
) -> DataFrame:
    """`keys, period_start, period_end` and the columns of `schema`: `partial` of each batch's rows of a period."""
    placed = (
        with_anchored_period(rows, period_secs, ts=ts, keys=keys)
        if anchored
        else with_fixed_period(rows, period_secs, ts=ts)
    )
    bounds = [*keys, "period_start", "period_end"]
    out = T.StructType([*[placed.schema[c] for c in bounds], *schema.fields])

    def by_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [
                partial(group.drop(columns=["period_start", "period_end"])).assign(**dict(zip(bounds, place)))
                for place, group in batch.groupby(bounds, sort=False, dropna=False)
            ]
            if parts:
                yield pd.concat(parts)[[*bounds, *schema.names]]

    return placed.sortWithinPartitions(*bounds).mapInPandas(by_batch, out)


def merged_partials(
    partials: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, *,
    keys: Sequence[str] = (), spread: int = 64,
) -> DataFrame:
    """One result per key and period of partials, which may themselves be results: by parts of a period first."""
    bounds = [*keys, "period_start", "period_end"]
    out = T.StructType([*[partials.schema[c] for c in bounds], *schema.fields])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge(pdf[schema.names])
        return merged.assign(**{c: pdf[c].iloc[0] for c in bounds})[[*bounds, *schema.names]]

    spread_out = partials.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(spread)))
    folded = spread_out.groupBy(*bounds, "_part").applyInPandas(fold, out)
    return folded.groupBy(*bounds).applyInPandas(fold, out)
