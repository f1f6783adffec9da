"""The whole analysis of a landing folder, continuously and in one pass.

One stream parses lines; every batch goes to all sinks: malformed lines, late rows, report, statistics, alerts and
user-defined computations. There is one clock for all of them, the newest timestamp met less a delay. It moves
between batches only, so neither the order of files within a batch nor that of tasks decides anything:

- rows of a second behind the clock of the batch before are late: they are kept in a table of their own;
- all other rows count, whatever file or task they come from;
- a second, bucket or period is closed once the clock has passed its end.

State is what is still open, held in tables of two alternating folders. Batch N reads the folder of N - 1 and
overwrites the other one and its own outputs, so running a batch again gives the same files. Kept are:

- `seconds`: partial statistics per second the clock has not passed;
- `periods`: partial statistics of open periods, which tell where the next anchored period may start;
- `times`: rows per timestamp of open buckets and of the bucket held back until its successor comes;
- `judged`: per key the gauge's place in its period and its state.

Outputs are tables by batch: `parsed` (good, rejected and late lines), `closed` (statistics of closed periods, from
which report lines and statistics are read), `alerts`, `computed`; with `text`, report and alerts as text too.

A key that has been silent for longer than its periods leaves all of them, unless the gauge left it high.
"""

import dataclasses
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trafficlens.functions.clf import parse_clf
from trafficlens.functions.clock import epoch_second, floor_to
from trafficlens.operators.gauge import alerts, bucket_counts, crossings, running_average, traffic_state
from trafficlens.operators.periods import anchored_periods, merged_partials, period_partials
from trafficlens.operators.scan import DAY_SECS, match
from trafficlens.operators.stats import DIMENSIONS, MEASURES, all_dimensions, partials, period_stats, rollup
from trafficlens.plans.report import report_lines
from trafficlens.schema import GAUGE_PERIOD_SECS, GAUGE_THRESHOLD, STATS_PERIOD_SECS, require_positive
from trafficlens.sources.text_log import LineParser, stream_lines, write_text

# Beyond every timestamp: the clock of a flush.
_END = 2**50
GOOD, REJECTED, LATE = "good", "rejected", "late"
STATS, GAUGE = "stats", "gauge"
_NOT_GOOD = ("line", "file", "reject_reason")


@dataclass(frozen=True)
class Settings:
    """What the job computes; `job.change` sets other values from a batch on.

    Anchored periods go on as they were begun, and the next one takes the new length. On a grid the lengths are fixed.
    """

    stats_period: int = STATS_PERIOD_SECS
    gauge_period: int = GAUGE_PERIOD_SECS
    threshold: float = GAUGE_THRESHOLD
    bucket_secs: int = 1
    anchored: bool = False

    def __post_init__(self):
        for name in ("stats_period", "gauge_period", "bucket_secs"):
            require_positive(name, getattr(self, name))


@dataclass(frozen=True)
class Computation:
    """A user-defined computation per period of a grid: see `periods.apply_per_period_pandas`."""

    name: str
    period_secs: int
    partial: Callable[[pd.DataFrame], pd.DataFrame]
    merge: Callable[[pd.DataFrame], pd.DataFrame]
    schema: T.StructType
    columns: Sequence[str] = ()  # what `partial` needs besides `ts` and the keys


@dataclass
class LiveJob:
    """Folders of a continuous job under one path, its stream and its tables."""

    spark: SparkSession
    path: str
    parser: LineParser = parse_clf
    settings: Settings = field(default_factory=Settings)
    delay_secs: int = 10
    keys: Sequence[str] = ()
    computations: Sequence[Computation] = ()
    sinks: Sequence[str] = (STATS, GAUGE)  # what to compute beside `computations`; lines are always sorted out
    text: bool = False

    # --- running -----------------------------------------------------------------------------

    def start(
        self, landing: str, *, max_files: int | None = None, max_bytes: int | None = None, start_from=None, **trigger
    ) -> StreamingQuery:
        """Follow the landing folder. With `text`, reports and alerts are written as text files too."""
        lines = stream_lines(self.spark, landing, start_from=start_from, max_files=max_files, max_bytes=max_bytes)
        return self.start_parsed(self.parser(lines), **trigger)

    def start_parsed(self, parsed: DataFrame, **trigger) -> StreamingQuery:
        writer = parsed.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(self.publish)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def change(self, from_batch: int, **values) -> None:
        """Other settings from a batch on; all values not named stay as they are before that batch."""
        new = dataclasses.replace(self._settings_at(from_batch), **values)
        fixed = ("anchored", "bucket_secs") if new.anchored else ("anchored", "bucket_secs", "stats_period", "gauge_period")
        for name in fixed:
            if getattr(new, name) != getattr(self.settings, name):
                raise ValueError(f"{name} cannot change while the job runs{'' if new.anchored else ' on a grid'}")
        row = self.spark.createDataFrame([(from_batch, json.dumps(dataclasses.asdict(new)))], "from_batch long, value string")
        row.write.mode("overwrite").parquet(f"{self.path}/settings/change={from_batch}")

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """One batch to all sinks."""
        before = self._state(batch_id - 1) if batch_id else None
        past = before["clock"] if before else -_END
        # The one pass over the text. Rows behind the clock of the batch before are set aside.
        sec = epoch_second(F.col("ts"))
        kind = F.when(F.col("reject_reason").isNotNull(), F.lit(REJECTED)).when(sec < past, F.lit(LATE)).otherwise(F.lit(GOOD))
        parsed = f"{self.path}/parsed/batch_id={batch_id}"
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(parsed)
        rows = self._table(parsed, batch.schema, GOOD).drop(*_NOT_GOOD)
        newest = rows.agg(F.max(sec)).first()[0]
        clock = max(past, -_END if newest is None else newest - int(self.delay_secs))
        self._advance(before, rows, clock, batch_id, f"{self.path}/state/slot={batch_id % 2}", f"batch_id={batch_id}")

    def flush(self, *, flush_last: bool = False) -> None:
        """Close everything that is open, as at the end of the input, from the stored state.

        The state itself stays as it is: a job that goes on takes no notice, and what it writes replaces the flush.
        With `flush_last` the gauge judges the last bucket of every open period too.
        """
        batch_id = self.last_batch()
        if batch_id is None:
            return
        before = self._state(batch_id)
        self._advance(before, self.good().limit(0), _END, batch_id, f"{self.path}/state/final", f"final={batch_id}", flush_last=flush_last)

    # --- tables ------------------------------------------------------------------------------

    def last_batch(self) -> int | None:
        """The newest batch whose state is whole."""
        try:
            return self.spark.read.parquet(f"{self.path}/state/slot=*/clock").agg(F.max("batch_id")).first()[0]
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise

    def rejects(self) -> DataFrame:
        """Lines set aside as malformed: `line, reason, file`."""
        return self._parsed(REJECTED).select("line", F.col("reject_reason").alias("reason"), "file")

    def late(self) -> DataFrame:
        """Good lines that came too late: `line, reason, file` and the parsed columns."""
        rows = self._parsed(LATE)
        return rows.select("line", F.lit(LATE).alias("reason"), "file", *[c for c in rows.columns if c not in _NOT_GOOD])

    def good(self) -> DataFrame:
        """All rows that were counted."""
        return self._parsed(GOOD).drop(*_NOT_GOOD)

    def closed(self) -> DataFrame:
        """Partial statistics of all closed periods, per value of every dimension: what report and statistics are of."""
        return self._output("closed")

    def report(self) -> DataFrame:
        """Report lines of closed periods."""
        return self._lines(self.closed(), self._history(self.last_batch() or 0))

    def stats(self) -> DataFrame:
        """One row per closed period."""
        closed = self.closed()
        of = lambda secs: period_stats(closed.where(F.col("period_secs") == secs), secs, keys=self.keys)
        return _union([of(secs) for secs in _lengths(self._history(self.last_batch() or 0))])

    def _lines(self, closed: DataFrame, history: list[Settings]) -> DataFrame:
        of = lambda secs: all_dimensions(closed.where(F.col("period_secs") == secs), keys=self.keys, folded=True)
        return _union([report_lines(of(secs), secs, keys=self.keys) for secs in _lengths(history)])

    def alerts(self) -> DataFrame:
        return self._output("alerts")

    def computed(self, name: str) -> DataFrame:
        return self._output(f"computed/{name}")

    def _parsed(self, kind: str) -> DataFrame:
        schema = self.parser(self.spark.createDataFrame([], "line string, file string")).schema
        return self._table(f"{self.path}/parsed", schema, kind)

    def _table(self, path: str, schema: T.StructType, kind: str) -> DataFrame:
        whole = T.StructType([*schema, T.StructField("kind", T.StringType())])
        return self.spark.read.schema(whole).parquet(path).where(F.col("kind") == kind).select(*schema.names)

    def _output(self, sink: str) -> DataFrame:
        """What batches have written, with what the latest flush has closed beyond them."""
        out = self.spark.read.parquet(f"{self.path}/{sink}/batches").drop("batch_id")
        try:
            final = self.spark.read.parquet(f"{self.path}/{sink}/flushed/final={self.last_batch()}")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return out
            raise
        return out.unionByName(final)

    # --- one step ----------------------------------------------------------------------------

    def _settings_at(self, batch_id: int) -> Settings:
        history = self._history(batch_id)
        return history[-1]

    def _history(self, batch_id: int) -> list[Settings]:
        """Settings up to a batch, the latest last: a row per change, so a handful."""
        try:
            table = self.spark.read.parquet(f"{self.path}/settings")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return [self.settings]
            raise
        rows = table.where(F.col("from_batch") <= batch_id).orderBy("from_batch").collect()
        return [self.settings, *[Settings(**json.loads(r["value"])) for r in rows]]

    def _state(self, batch_id: int) -> dict:
        """Tables of what was open after a batch; the number `clock` of that batch goes with them."""
        slot = f"{self.path}/state/slot={batch_id % 2}"
        row = self.spark.read.parquet(f"{slot}/clock").first()
        if row["batch_id"] != batch_id:
            raise RuntimeError(f"the state of batch {batch_id} is not there: a checkpoint and a job's path belong together")
        return {"clock": row["clock"], "slot": slot}

    def _kept(self, before: dict | None, name: str) -> DataFrame | None:
        return None if before is None else self.spark.read.parquet(f"{before['slot']}/{name}")

    def _advance(self, before, rows, clock, batch_id, slot, folder, *, flush_last=False) -> None:
        history = self._history(batch_id)
        settings = history[-1]

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{slot}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{slot}/{name}")

        def emit(df: DataFrame, sink: str) -> None:
            under = "batches" if folder.startswith("batch_id") else "flushed"
            df.write.mode("overwrite").parquet(f"{self.path}/{sink}/{under}/{folder}")

        emit.text = lambda df, sink, order: write_text(df, f"{self.path}/text/{sink}/{folder}", order=[*self.keys, *order])
        if STATS in self.sinks:
            self._statistics(before, rows, clock, history, keep, emit)
        if GAUGE in self.sinks:
            self._gauge(before, rows, clock, settings, keep, emit, flush_last)
        for one in self.computations:
            self._compute(one, before, rows, clock, keep, emit)
        now = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(clock).cast("long").alias("clock"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{slot}/clock")

    def _statistics(self, before, rows, clock, history, keep, emit) -> None:
        keys, settings = list(self.keys), history[-1]
        cell = [*keys, "sec", *DIMENSIONS]
        seconds = rollup(partials(rows, keys=keys), 1, keys=keys, dims=DIMENSIONS)
        if before:
            waiting = self._kept(before, "seconds").where(F.col("sec") >= before["clock"])
            seconds = rollup(waiting.select(*cell, *MEASURES).unionByName(seconds), 1, keys=keys, dims=DIMENSIONS)
        seconds = keep(seconds, "seconds")
        closed = seconds.where(F.col("sec") < clock)

        place = [*keys, "period_start_sec", "period_secs"]
        open_periods = None
        if before:
            open_periods = self._kept(before, "periods").where(F.col("period_start_sec") + F.col("period_secs") > before["clock"])
        length = F.lit(int(settings.stats_period)).cast("long")
        if not settings.anchored:
            placed = closed.withColumns({"period_start_sec": floor_to(F.col("sec"), settings.stats_period), "period_secs": length})
        else:
            placed = _continued(closed, "sec", open_periods, settings.stats_period, keys)
        placed = placed.select(*place, *DIMENSIONS, *MEASURES)
        if open_periods is not None:
            placed = open_periods.select(*place, *DIMENSIONS, *MEASURES).unionByName(placed)
        sums = {m: F.min(m) if m == "first_ts" else F.sum(m) for m in MEASURES}
        merged = placed.groupBy(*place, *DIMENSIONS).agg(*[c.alias(m) for m, c in sums.items()])
        done = keep(merged, "periods").where(F.col("period_start_sec") + F.col("period_secs") <= clock)

        emit(done, "closed")
        if self.text:
            emit.text(self._lines(done, history), "report", ["period_start", "line_no"])

    def _gauge(self, before, rows, clock, settings, keep, emit, flush_last) -> None:
        keys, bucket_secs = list(self.keys), int(settings.bucket_secs)
        bucket = floor_to(epoch_second(F.col("ts")), bucket_secs)
        times = rows.groupBy(*keys, "ts").agg(F.count("*").alias("_n"))
        known = None
        if before:
            known = _gauge_state(self._kept(before, "judged"), keys, before["clock"], bucket_secs)
            waiting = _beside(self._kept(before, "times").withColumn("_bucket", bucket), known.select(*keys, "kept_from"), keys)
            waiting = waiting.where((F.col("_bucket") + bucket_secs > before["clock"]) | (F.col("_bucket") >= F.col("kept_from")))
            times = waiting.select(*keys, "ts", "_n").unionByName(times).groupBy(*keys, "ts").agg(F.sum("_n").alias("_n"))
        closed = keep(times, "times").where(bucket + bucket_secs <= clock)

        hits = bucket_counts(closed, bucket_secs=bucket_secs, threshold=settings.threshold, keys=keys)
        if not settings.anchored:
            length = F.lit(int(settings.gauge_period)).cast("long")
            placed = hits.withColumns({"period_start_sec": floor_to(F.col("bucket"), settings.gauge_period), "period_secs": length})
        else:
            placed = _continued(hits, "bucket", known, settings.gauge_period, keys)
        averages = running_average(placed, bucket_secs=bucket_secs, keys=keys)
        if known is None:
            averages = averages.withColumn("initial", F.lit(False))
        else:
            # Buckets judged before are known by their number and sum alone.
            carried = known.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("period_start_sec", "buckets", "cum", "is_high")])
            same = F.col("_period_start_sec") == F.col("period_start_sec")
            averages = _beside(averages, carried, keys).withColumns(
                {
                    "buckets": F.col("buckets") + F.when(same, F.col("_buckets")).otherwise(F.lit(0)),
                    "cum": F.col("cum") + F.when(same, F.col("_cum")).otherwise(F.lit(0)),
                    "initial": F.coalesce("_is_high", F.lit(False)),
                }
            )
            averages = averages.withColumn("average", F.col("cum") / F.col("buckets"))
            averages = averages.drop("_period_start_sec", "_buckets", "_cum", "_is_high")
        states = traffic_state(
            averages, settings.threshold, keys=keys, flush_last=flush_last, block_secs=max(DAY_SECS, 1000 * bucket_secs)
        )
        if known is not None:
            # Silent keys stay known: a row before any new bucket, which newer rows stand in for.
            old = known.select(*keys, (F.col("kept_from") - 1).alias("bucket"), "period_start_sec", "period_secs",
                               (F.col("buckets") + 1).alias("buckets"), "cum", F.lit(0).cast("long").alias("hits"),
                               F.col("is_high"), F.col("is_high").alias("was_high"))
            states = states.unionByName(old, allowMissingColumns=True)
        judged = keep(states, "judged")
        crossed = crossings(judged, settings.threshold, keys=keys)
        lines = alerts(crossed, settings.threshold, keys=keys)
        emit(lines, "alerts")
        if self.text:
            emit.text(lines, "alerts", ["bucket_ts"])

    def _compute(self, one, before, rows, clock, keep, emit) -> None:
        keys = list(self.keys)
        rows = rows.select(*dict.fromkeys([*keys, "ts", *one.columns]))
        parts = period_partials(rows, one.period_secs, one.partial, one.schema, keys=keys)
        if before:
            open_parts = self._kept(before, f"computed-{one.name}").where(epoch_second(F.col("period_end")) >= before["clock"])
            parts = open_parts.unionByName(parts)
        merged = keep(merged_partials(parts, one.merge, one.schema, keys=keys), f"computed-{one.name}")
        emit(merged.where(epoch_second(F.col("period_end")) < clock), f"computed/{one.name}")


def _lengths(history: Sequence[Settings]) -> list[int]:
    return sorted({s.stats_period for s in history})


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _beside(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the one row per key of `per_key` (at most a single row without keys) to `rows`."""
    if keys:
        return match(rows, per_key, keys, "left")
    one = F.lit(1)
    single = F.broadcast(per_key.withColumn("_one", one))  # at most one row
    return match(rows.withColumn("_one", one), single, ["_one"], "left").drop("_one")


def _continued(rows: DataFrame, position: str, known: DataFrame | None, period_secs: int, keys: Sequence[str]) -> DataFrame:
    """Add anchored periods to `rows`, going on from the open period of each key: what lies before its end belongs to
    it, and a new chain starts with the first position after."""
    length = F.lit(int(period_secs)).cast("long")
    if known is not None:
        ends = F.col("period_start_sec") + F.col("period_secs")
        newest = known.groupBy(*keys).agg(F.max_by(F.struct("period_start_sec", "period_secs"), ends).alias("_open"))
        rows = _beside(rows, newest, keys)
        start, secs = F.col("_open.period_start_sec"), F.col("_open.period_secs")
        inside = F.coalesce(F.col(position) < start + secs, F.lit(False))
        within = rows.where(inside).withColumns({"period_start_sec": start, "period_secs": secs}).drop("_open")
        rows = rows.where(~inside).drop("_open")
    chain = anchored_periods(rows.select(*keys, F.col(position).alias("sec")).distinct(), period_secs, keys=keys)
    new = match(rows, chain.withColumnRenamed("sec", position), [*keys, position]).withColumn("period_secs", length)
    return new if known is None else within.unionByName(new)


def _gauge_state(judged: DataFrame, keys: Sequence[str], clock: int, bucket_secs: int) -> DataFrame:
    """Per key the gauge's place after the batch that wrote `judged`: its newest period with the number and hits of the
    buckets judged there, the state, and the bucket that is held back (`kept_from`). Keys whose period is over are
    known only while their state is high."""
    last = judged.groupBy(*keys).agg(
        F.max_by(
            F.struct("bucket", "period_start_sec", "period_secs", (F.col("buckets") - 1).alias("buckets"),
                     (F.col("cum") - F.col("hits")).alias("cum"), "is_high"),
            "bucket",
        ).alias("_l")
    )
    known = last.where(F.col("_l").isNotNull()).select(*keys, "_l.*")
    over = F.col("period_start_sec") + F.col("period_secs") + (bucket_secs - 1) <= clock
    known = known.where(F.col("is_high") | ~over)
    # Of a period that is over no bucket is held back; any bucket to come lies behind the closed ones.
    first_open = F.lit(clock - bucket_secs + 1).cast("long")
    return known.withColumn("kept_from", F.when(over, first_open).otherwise(F.col("bucket"))).drop("bucket")
