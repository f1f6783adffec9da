"""Named queries over the given tables, one per operator. Each takes (spark, sf_dir).

Events lie minutes apart, so periods and buckets are hours and days here instead of seconds.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions import clf, derive, render
from trafficlens.functions.clock import display_datetime, from_epoch, naive
from trafficlens.operators import audit, gauge, lookup, periods, stats
from trafficlens.plans import report
from trafficlens.plans.derived import access_log, load_events, log_lines
from trafficlens.schema import ACCESS_LOG
from trafficlens.session import prepare, shared_path, written
from trafficlens.sources import text_log
from trafficlens.sources.rollup_table import RollupTable
from trafficlens.streaming import gauge as stream_gauge
from trafficlens.streaming.live import Computation, LiveJob, Settings
from trafficlens.streaming import stats as stream_stats

HOUR, DAY = 3600, 86_400
STATS_PERIOD = HOUR
ANCHORED_PERIOD = 600
GAUGE = {"period_secs": DAY, "threshold": 14.0, "bucket_secs": HOUR}
PERIOD_LENGTHS = [600, 1800, 7200]
BYTE_LIMIT = 2_000_000
INTERVAL = ("2024-01-10 06:30:00", "2024-01-12 11:59:59")
START_FROM = "2024-01-15 00:00:00"
STREAM_DELAY_SECS = 600
LATE_EVERY = 40
AUDIT = {"lost": 10, "changed": 500, "doubled": 900}
MIXED = 12
HISTOGRAM = {"width": 1000, "bins": 64}

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _naive_times(fn(prepare(spark), sf_dir))

    REGISTRY[fn.__name__] = run
    return run


def _naive_times(df: DataFrame) -> DataFrame:
    """Results carry timestamps without a zone."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: naive(F.col(name)) for name in zoned}) if zoned else df


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log(load_events(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clf.parse_clf(log_lines(load_events(spark, sf_dir)))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_fixed_periods(stats.partials(_log(spark, sf_dir)), STATS_PERIOD)


# --- parsing ---------------------------------------------------------------------------------


@query
def parse_clf(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed.where(F.col("reject_reason").isNull()).drop("line", "reject_reason")


def _write_log_files(spark, sf_dir, label):
    """The derived log as text files: some carriage returns, some blank lines."""
    lines = log_lines(load_events(spark, sf_dir))
    event = F.col("event_id")
    raw = F.concat(
        F.col("line"),
        F.when(event % 2 == 0, F.lit("\r")).otherwise(F.lit("")),
        F.when(event % 10 == 0, F.lit("\n")).otherwise(F.lit("")),
    )
    path = shared_path(spark, label)
    lines.select(raw.alias("value")).write.mode("overwrite").text(path)
    return path


@query
def access_log_read(spark, sf_dir):
    path = _write_log_files(spark, sf_dir, "log-files")
    return text_log.good_rows(text_log.read_log(spark, path))


@query
def access_log_table(spark, sf_dir):
    """Parsed once into a table by day, read back from it."""
    path = shared_path(spark, "log-table")
    text_log.write_access_log(text_log.good_rows(_parsed(spark, sf_dir)), path)
    by_day = text_log.read_access_log(spark, path).groupBy("log_date")
    return by_day.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("ts").alias("last_ts"))


@query
def section_of(spark, sf_dir):
    log = _log(spark, sf_dir).drop("section")
    return log.select("event_id", "resource", clf.section().alias("section"))


@query
def status_category(spark, sf_dir):
    log = _log(spark, sf_dir)
    # Every third status is moved out of 100-599 so that the last category is met too.
    status = F.when(F.col("event_id") % 3 == 0, F.col("status") + 600).otherwise(F.col("status"))
    return log.select("event_id", status.alias("status"), derive.status_category(status).alias("category"))


@query
def rejects_by_reason(spark, sf_dir):
    return text_log.rejects_by_reason(_parsed(spark, sf_dir))


@query
def rejected_lines(spark, sf_dir):
    return text_log.rejected_lines(_parsed(spark, sf_dir))


@query
def custom_parser(spark, sf_dir):
    """Another line format: `time|user|type|value`, every fiftieth line without a time."""
    events = load_events(spark, sf_dir)
    time = F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    value = F.floor(F.col("value") * 100).cast("long").cast("string")
    lines = events.select(
        "event_id", F.concat_ws("|", time, F.col("user_id").cast("string"), "event_type", value).alias("line")
    )

    def pipe_separated(line):
        part = lambda i: F.split_part(line, F.lit("|"), F.lit(i))
        return F.struct(
            part(1).try_cast("timestamp").alias("ts"),
            part(2).cast("long").alias("user_id"),
            part(3).alias("event_type"),
            part(4).cast("long").alias("cents"),
        )

    return text_log.good_rows(text_log.line_parser(pipe_separated)(lines))


# --- rendering -------------------------------------------------------------------------------


@query
def render_clf(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "event_id", render.clf_line().alias("line"), display_datetime(F.col("ts")).alias("display_ts")
    )


@query
def roundtrip_audit(spark, sf_dir):
    """How many parsed lines are rendered back unchanged, and do all of them parse to the same nine fields."""
    first = _parsed(spark, sf_dir).where(F.col("reject_reason").isNull())
    rendered = first.select(
        F.col("line").alias("original"), F.struct(*ACCESS_LOG.names).alias("before"), render.clf_line().alias("line")
    )
    again = clf.parse_clf(rendered)
    after = F.struct(*ACCESS_LOG.names)
    return again.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("original") == F.col("line")).alias("unchanged"),
        F.count_if(F.col("original") != F.col("line")).alias("changed"),
        F.count_if(F.col("reject_reason").isNotNull() | ~F.col("before").eqNullSafe(after)).alias("lost"),
    )


@query
def roundtrip_multiset(spark, sf_dir):
    """Rendered and parsed again, is every day's set of rows the same? One row is changed, one lost, one doubled."""
    first = _parsed(spark, sf_dir).where(F.col("reject_reason").isNull())
    rendered = first.select("event_id", render.clf_line().alias("line"))
    event = F.col("event_id")
    again = text_log.good_rows(clf.parse_clf(rendered.where(event != AUDIT["lost"])))
    again = again.withColumn("bytes", F.when(event == AUDIT["changed"], F.col("bytes") + 1).otherwise(F.col("bytes")))
    again = again.select("*", F.explode(F.when(event == AUDIT["doubled"], F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")
    return audit.multiset_differences(first, again, ACCESS_LOG.names, by=[F.to_date("ts").alias("day")])


@query
def size_text(spark, sf_dir):
    """Sizes over all units: bytes of an event raised by powers of 1024."""
    size = F.col("bytes") * F.pow(F.lit(1024.0), F.col("event_id") % 7)
    return _log(spark, sf_dir).select("event_id", render.human_size(size).alias("size_text"))


# --- statistics per period -------------------------------------------------------------------


@query
def period_stats(spark, sf_dir):
    return stats.period_stats(_hourly(spark, sf_dir), STATS_PERIOD)


@query
def tumbling_stats(spark, sf_dir):
    """The window function of Spark, on a grid shifted by ten minutes."""
    window = F.window("ts", f"{STATS_PERIOD} seconds", startTime="600 seconds")
    grouped = _log(spark, sf_dir).groupBy(window).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return grouped.select(F.col("window.start").alias("period_start"), "n", "bytes")


@query
def multi_period_stats(spark, sf_dir):
    return stats.multi_period_stats(_log(spark, sf_dir), PERIOD_LENGTHS)


@query
def rollup_partials(spark, sf_dir):
    """Minutes rolled up to ten minutes and those to two hours; the source is read once per level."""
    log = stats.partials(_log(spark, sf_dir))
    tens = stats.rollup(stats.rollup(log, 60), 600)
    longer = stats.rollup(tens, 7200)
    labelled = lambda df, secs: df.select(
        F.lit(secs).alias("period_secs"), from_epoch(F.col("sec")).alias("period_start"), "n", "bytes_in", "bytes_out"
    )
    return labelled(tens, 600).unionByName(labelled(longer, 7200))


@query
def rollup_tables(spark, sf_dir):
    """Kept rollups: the rows in time, loaded twice as after a failure, then those that came late."""
    log = _log(spark, sf_dir)
    late = (F.col("ts") < F.lit(START_FROM).cast("timestamp")) & (F.col("event_id") % LATE_EVERY == 0)
    kept = RollupTable(spark, shared_path(spark, "rollups"), levels=(600, HOUR, DAY), dims=["method"])
    for name, rows in (("in-time", log.where(~late)), ("in-time", log.where(~late)), ("late", log.where(late))):
        kept.load(name, rows)
    labelled = lambda secs: kept.table(secs).select(
        F.lit(secs).alias("period_secs"), "period_start", "method", "n", "bytes_in", "bytes_out", F.col("first_ts").alias("from_ts")
    )
    return labelled(600).unionByName(labelled(HOUR)).unionByName(labelled(DAY))


@query
def bytes_in_out(spark, sf_dir):
    return stats.period_stats(_hourly(spark, sf_dir), STATS_PERIOD).select(
        "period_start", "bytes_in", "bytes_out", "bytes_total"
    )


@query
def count_per_section(spark, sf_dir):
    return stats.count_per(_hourly(spark, sf_dir), "section")


@query
def count_per_method(spark, sf_dir):
    return stats.count_per(_hourly(spark, sf_dir), "method")


@query
def count_per_version(spark, sf_dir):
    return stats.count_per(_hourly(spark, sf_dir), "version")


@query
def count_per_status_category(spark, sf_dir):
    return stats.count_per(_hourly(spark, sf_dir), "category")


@query
def dimension_counts(spark, sf_dir):
    return stats.dimension_counts(_hourly(spark, sf_dir))


@query
def top10_per_dimension(spark, sf_dir):
    """Top users as section: more values than the list takes."""
    placed = stats.in_fixed_periods(
        stats.partials(_log(spark, sf_dir).withColumn("section", F.col("auth_user"))), DAY
    )
    return stats.top_per_dimension(placed)


@query
def custom_period_fn(spark, sf_dir):
    return periods.apply_per_period(
        _log(spark, sf_dir),
        DAY,
        lambda grouped: grouped.agg(
            F.count_distinct("host").alias("hosts"), F.max("bytes").alias("largest"), F.count("*").alias("n")
        ),
    )


@query
def custom_period_pandas(spark, sf_dir):
    """Pandas escape hatch: rows and largest response per period, in parts that are merged."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("largest", T.LongType())])

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)], "largest": [pdf["bytes"].max()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [pdf["n"].sum()], "largest": [pdf["largest"].max()]})

    log = _log(spark, sf_dir).select("ts", "bytes")
    return periods.apply_per_period_pandas(log, DAY, partial, merge, schema)


@query
def byte_alarm(spark, sf_dir):
    return stats.byte_alarm(_log(spark, sf_dir), HOUR, BYTE_LIMIT)


@query
def period_totals_densified(spark, sf_dir):
    """Counts per ten minutes, silent ones included."""
    placed = stats.in_fixed_periods(stats.partials(_log(spark, sf_dir)), 600)
    counted = stats.period_stats(placed, 600).select("period_start", "n")
    return periods.densify(counted, 600, ["n"])


@query
def anchored_periods(spark, sf_dir):
    placed = stats.in_anchored_periods(_log(spark, sf_dir), ANCHORED_PERIOD, dims=())
    return stats.period_stats(placed, ANCHORED_PERIOD)


@query
def anchored_rows(spark, sf_dir):
    """Every log row with the bounds of its data-anchored period."""
    log = _log(spark, sf_dir).select("event_id", "ts")
    return periods.with_anchored_period(log, ANCHORED_PERIOD)


@query
def period_report(spark, sf_dir):
    return report.period_report(_hourly(spark, sf_dir), STATS_PERIOD)


# --- gauge -----------------------------------------------------------------------------------


@query
def hits_per_second(spark, sf_dir):
    """Hits per occupied second."""
    hits = gauge.hits_per_bucket(_log(spark, sf_dir))
    return hits.select(from_epoch(F.col("bucket")).alias("second"), "hits")


@query
def running_avg_rate(spark, sf_dir):
    hits = gauge.hits_per_bucket(_log(spark, sf_dir), bucket_secs=HOUR, threshold=GAUGE["threshold"])
    averages = gauge.running_average(gauge.in_gauge_periods(hits, DAY), bucket_secs=HOUR)
    return averages.select(from_epoch(F.col("bucket")).alias("bucket_ts"), "hits", "cum", "buckets", "average")


@query
def running_avg_densified(spark, sf_dir):
    """The same over ten-minute buckets, silent ones in the divisor."""
    hits = gauge.hits_per_bucket(_log(spark, sf_dir), bucket_secs=600)
    averages = gauge.running_average(gauge.in_gauge_periods(hits, DAY), bucket_secs=600, densify=True)
    return averages.select(from_epoch(F.col("bucket")).alias("bucket_ts"), "hits", "cum", "buckets", "average")


@query
def traffic_state(spark, sf_dir):
    states = gauge.gauge(_log(spark, sf_dir), **GAUGE)
    return states.select(from_epoch(F.col("bucket")).alias("bucket_ts"), "average", "was_high", "is_high")


@query
def traffic_crossings(spark, sf_dir):
    crossed = gauge.traffic_crossings(_log(spark, sf_dir), **GAUGE)
    return crossed.select(
        from_epoch(F.col("bucket")).alias("bucket_ts"), "is_up", "position", "average", "crossed_ts"
    )


@query
def traffic_crossings_by_method(spark, sf_dir):
    """One gauge per HTTP method."""
    crossed = gauge.traffic_crossings(_log(spark, sf_dir), DAY, 2.0, bucket_secs=HOUR, keys=["method"])
    return crossed.select(
        "method", from_epoch(F.col("bucket")).alias("bucket_ts"), "is_up", "position", "average", "crossed_ts"
    )


@query
def traffic_alert_text(spark, sf_dir):
    crossed = gauge.traffic_crossings(_log(spark, sf_dir), **GAUGE)
    return gauge.alerts(crossed, GAUGE["threshold"])


# --- lookups ---------------------------------------------------------------------------------


@query
def interval_fetch(spark, sf_dir):
    start, end = (F.to_timestamp_ntz(F.lit(t)) for t in INTERVAL)
    fetched = lookup.fetch_interval(load_events(spark, sf_dir), start, end)
    return access_log(fetched).select("event_id", "ts", "host", "resource")


@query
def interval_join(spark, sf_dir):
    """Rows within an hour of the first error event of each day."""
    log = _log(spark, sf_dir)
    errors = log.where(F.col("resource").startswith("/error"))
    start = F.min(F.unix_seconds("ts"))
    intervals = errors.groupBy(F.to_date("ts").alias("day")).agg(
        start.alias("start_sec"), (start + (HOUR - 1)).alias("end_sec")
    )
    fetched = lookup.fetch_intervals(log.select("event_id", "ts"), intervals)
    return fetched.select("day", "event_id", "ts")


@query
def interval_join_mixed(spark, sf_dir):
    """What lies within 4^0 to 4^11 seconds (48 days) of the first error event of each day: every length each day."""
    log = _log(spark, sf_dir)
    errors = log.where(F.col("resource").startswith("/error"))
    firsts = errors.groupBy(F.to_date("ts").alias("day")).agg(F.min(F.unix_seconds("ts")).alias("start_sec"))
    length = F.pow(F.lit(4.0), F.col("power")).cast("long")
    intervals = firsts.withColumn("power", F.explode(F.sequence(F.lit(0), F.lit(MIXED - 1))))
    intervals = intervals.withColumn("end_sec", F.col("start_sec") + length - 1)
    fetched = lookup.fetch_intervals_mixed(log.select("event_id", "ts", "bytes"), intervals)
    return fetched.groupBy("day", "power").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query
def first_ts(spark, sf_dir):
    return lookup.first_timestamp(_log(spark, sf_dir))


def _probes(log: DataFrame) -> DataFrame:
    """A probe time per event, up to ten minutes off it."""
    away = F.make_dt_interval(secs=F.substring("auth_user", 2, 10).cast("int") * 7 % 600)
    return log.select("event_id", (F.col("ts") + away).alias("probe_ts"))


@query
def next_ts_after(spark, sf_dir):
    log = _log(spark, sf_dir)
    return lookup.next_after(_probes(log), log.select("ts"), probe_ts="probe_ts")


@query
def nearest_event(spark, sf_dir):
    log = _log(spark, sf_dir)
    found = lookup.nearest(_probes(log), log.select("ts"), probe_ts="probe_ts")
    return found.select("event_id", "probe_ts", from_epoch(F.col("nearest_at")).alias("nearest_ts"))


@query
def second_extent(spark, sf_dir):
    return lookup.second_extent(_log(spark, sf_dir))


@query
def retention_tail(spark, sf_dir):
    return lookup.retention_tail(_log(spark, sf_dir).select("event_id", "ts"), [600, HOUR, 2 * DAY])


@query
def append_batches(spark, sf_dir):
    """The event log and one made of orders, in time order."""
    log = _log(spark, sf_dir).select(F.lit("events").alias("source"), F.col("event_id").alias("id"), "ts", "bytes")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("orders").alias("source"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
    )
    return lookup.append_batches(log, orders, arrival=["id"])


@query
def start_position(spark, sf_dir):
    events = text_log.start_at(load_events(spark, sf_dir), F.to_timestamp_ntz(F.lit(START_FROM)))
    return access_log(events).select("event_id", "ts", "bytes")


# --- streams run to the end of the given data ------------------------------------------------


@query
def stream_period_stats(spark, sf_dir):
    path = _write_log_files(spark, sf_dir, "stream-in")
    out = shared_path(spark, "stream-stats")
    parsed = clf.parse_clf(text_log.stream_lines(spark, path))
    closed = stream_stats.period_stats_stream(parsed, STATS_PERIOD, delay=f"{STREAM_DELAY_SECS} seconds")
    stream_stats.start_stats(closed, f"{out}/rows", f"{out}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{out}/rows")


@query
def stream_alerts(spark, sf_dir):
    path = _write_log_files(spark, sf_dir, "gauge-in")
    out = shared_path(spark, "stream-gauge")
    parsed = clf.parse_clf(text_log.stream_lines(spark, path))
    stream_gauge.start_gauge(
        parsed, path=out, checkpoint=f"{out}/checkpoint", delay=f"{STREAM_DELAY_SECS} seconds",
        availableNow=True, **GAUGE,
    ).awaitTermination()
    return spark.read.parquet(f"{out}/alerts").select("bucket_ts", "line")


LANDING_FILES = 8


def _land_in_order(lines: DataFrame, landing: str) -> None:
    """One file per range of `ts`, written one after the other: streams take files by modification time."""
    ranges = lines.repartitionByRange(LANDING_FILES, "ts").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "landing-ranges")
    spark, newest = lines.sparkSession, None
    for part in range(LANDING_FILES):
        one = ranges.where(F.col("part") == part).coalesce(1).sortWithinPartitions("ts")
        one.select(F.col("line").alias("value")).write.mode("append").text(f"{landing}/range={part}")
    listed = spark.read.format("binaryFile").load(landing).select("range", "modificationTime").orderBy("range").collect()
    for row in listed:
        if newest is not None and row["modificationTime"] <= newest:
            raise RuntimeError("files of the landing folder are not in order of time: its clock is too coarse")
        newest = row["modificationTime"]


LIVE = Settings(stats_period=STATS_PERIOD, gauge_period=GAUGE["period_secs"], threshold=GAUGE["threshold"], bucket_secs=HOUR)


def _live(spark, sf_dir, label, job=LiveJob, **options):
    """A live job over the derived log, landed as files in time order and read one at a time."""
    landing, out = shared_path(spark, f"{label}-in"), shared_path(spark, label)
    events = load_events(spark, sf_dir)
    _land_in_order(log_lines(events).join(events.select("event_id", "ts"), "event_id"), landing)
    live = job(spark, out, **{"settings": LIVE, "delay_secs": STREAM_DELAY_SECS, **options})
    live.start(landing, max_files=1, availableNow=True).awaitTermination()
    return live


@query
def stream_rejects(spark, sf_dir):
    """Lines a continuous job has set aside."""
    return _live(spark, sf_dir, "live-rejects", sinks=()).rejects().select("line", "reason")


@query
def stream_job(spark, sf_dir):
    """All that the continuous job writes, from one pass: report lines, alerts, number of rejects per reason."""
    job = _live(spark, sf_dir, "live-job")
    rejects = job.rejects().groupBy("reason").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("timestamp")
    out = lambda df, sink, at, no, line: df.select(F.lit(sink).alias("sink"), at.alias("at"), no.alias("line_no"), line.alias("line"))
    line = F.col("line")
    return (
        out(job.report(), "report", F.col("period_start"), F.col("line_no"), line)
        .unionByName(out(job.alerts(), "alert", F.col("bucket_ts"), F.lit(1), line))
        .unionByName(out(rejects, "rejects", none, F.lit(1), F.concat("reason", F.lit(": "), F.col("n").cast("string"))))
    )


class _Replayed(LiveJob):
    """Every batch is run again, as after a failure that came when its outputs had been written."""

    def publish(self, batch, batch_id):
        super().publish(batch, batch_id)
        super().publish(batch, batch_id)


@query
def stream_anchored_stats(spark, sf_dir):
    """Data-anchored statistics from a stream; open periods go on from batch to batch."""
    anchored = Settings(stats_period=ANCHORED_PERIOD, gauge_period=DAY, bucket_secs=HOUR, anchored=True)
    return _live(spark, sf_dir, "live-anchored", _Replayed, settings=anchored, sinks=["stats"]).stats()


@query
def stream_flushed(spark, sf_dir):
    """The statistics of every hour: the last ones are closed at the end of the input."""
    job = _live(spark, sf_dir, "live-flushed", sinks=["stats"])
    job.flush()
    return job.stats()


@query
def stream_late_rows(spark, sf_dir):
    """One file comes late: what its lines were, and what was counted without them, per hour."""
    landing, out = shared_path(spark, "live-late-in"), shared_path(spark, "live-late")
    events = load_events(spark, sf_dir)
    early = F.col("ts") < F.to_timestamp_ntz(F.lit(START_FROM))
    late = early & (F.col("event_id") % LATE_EVERY == 0)
    part = F.when(late, F.lit(2)).when(early, F.lit(0)).otherwise(F.lit(1))
    lines = written(log_lines(events).join(events.select("event_id", part.alias("part")), "event_id"), "late-lines")
    job = LiveJob(spark, out, settings=LIVE, delay_secs=STREAM_DELAY_SECS, sinks=["stats"])
    for number in range(3):
        lines.where(F.col("part") == number).select("line").write.mode("append").text(f"{landing}/part={number}")
        job.start(landing, availableNow=True).awaitTermination()
    job.flush()
    late_rows = job.late().groupBy(F.date_trunc("hour", "ts").alias("period_start")).agg(F.count("*").alias("n"))
    return late_rows.select(F.lit("late").alias("kind"), "period_start", "n").unionByName(
        job.stats().select(F.lit("counted").alias("kind"), "period_start", "n")
    )


@query
def stream_custom_period(spark, sf_dir):
    """A computation of the user's own on a stream: the median bin of a day's response sizes, from histograms."""
    schema = T.StructType([T.StructField("bins", T.ArrayType(T.LongType()))])

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = (pdf["bytes"] // HISTOGRAM["width"]).clip(upper=HISTOGRAM["bins"] - 1).value_counts()
        return pd.DataFrame({"bins": [[int(counts.get(b, 0)) for b in range(HISTOGRAM["bins"])]]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bins": [[int(sum(x)) for x in zip(*pdf["bins"])]]})

    one = Computation("sizes", DAY, partial, merge, schema, columns=["bytes"])
    job = _live(spark, sf_dir, "live-custom", computations=[one], sinks=())
    job.flush()
    n = F.aggregate("bins", F.lit(0).cast("long"), lambda total, x: total + x)
    # The median bin is the first one by which half of the rows have been met.
    met = F.transform(F.sequence(F.lit(1), F.size("bins")), lambda i: F.aggregate(F.slice("bins", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    median = F.array_position(F.transform(met, lambda m: m * 2 >= n), True) - 1
    return job.computed("sizes").select("period_start", n.alias("n"), median.cast("long").alias("median_bin"))
