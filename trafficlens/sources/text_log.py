"""Log files in, typed rows out; and the tables and text files written from them."""

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.clf import parse_clf

LineParser = Callable[[DataFrame], DataFrame]


def _lines(raw: DataFrame) -> DataFrame:
    """Non-empty lines with one trailing carriage return removed and broken UTF-8 replaced.

    A line of only a carriage return is kept as an empty, malformed line.
    """
    value = F.make_valid_utf8(F.col("value"))
    chopped = F.when(
        F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)
    ).otherwise(value)
    return raw.where(F.col("value") != "").select(
        chopped.alias("line"), F.col("_metadata.file_path").alias("file")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`line, file` of every line under `path`. Lines end at a line feed only."""
    return _lines(spark.read.option("lineSep", "\n").text(path))


def stream_lines(
    spark: SparkSession,
    path: str,
    *,
    start_from: datetime | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Lines of files as they arrive in the landing folder `path`, each file read exactly once.

    Files must be moved in complete: what is appended later is not seen. `start_from` leaves out
    files last changed before it (start at the tail), a datetime without zone being UTC; without it the
    stream starts at the oldest file. `max_files` or `max_bytes` per trigger throttle the readout.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    raw = reader.text(path)
    if start_from is not None:
        # The driver's own zone must not matter.
        since = start_from if start_from.tzinfo else start_from.replace(tzinfo=timezone.utc)
        micros = (since - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        raw = raw.where(F.unix_micros("_metadata.file_modification_time") >= micros)
    return _lines(raw)


def start_at(log: DataFrame, start_from: Column, *, ts: str = "ts") -> DataFrame:
    """Start position by event time: only rows from `start_from` on (prunes the file scan)."""
    return log.where(F.col(ts) >= start_from)


def line_parser(parse: Callable[[Column], Column]) -> LineParser:
    """A custom line format from `parse`, a function of the line column to a struct column.

    The struct needs a timestamp field `ts`; a line for which it is null is rejected as `format`.
    """

    def apply(lines: DataFrame) -> DataFrame:
        parsed = lines.select("*", F.inline(F.array(parse(F.col("line")))))
        if "ts" not in parsed.columns:
            raise ValueError("a line format must produce a column ts")
        return parsed.withColumn("reject_reason", F.when(F.col("ts").isNull(), F.lit("format")))

    return apply


def read_log(spark: SparkSession, path: str | list[str], parser: LineParser = parse_clf) -> DataFrame:
    """Every line of the files parsed, good and bad; see `good_rows` and `rejected_lines`."""
    return parser(read_lines(spark, path))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "line", "file")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """Lines set aside: `line, reason` and the file they came from."""
    file = [c for c in ["file"] if c in parsed.columns]
    return parsed.where(F.col("reject_reason").isNotNull()).select(
        "line", F.col("reject_reason").alias("reason"), *file
    )


def rejects_by_reason(parsed: DataFrame) -> DataFrame:
    return rejected_lines(parsed).groupBy("reason").agg(F.count("*").alias("n"))


def write_access_log(log: DataFrame, path: str, *, ts: str = "ts") -> None:
    """Write parsed rows once as Parquet by day, for all later queries to share.

    The rebalance hint sizes files evenly and splits a day that holds much of the log; rows are
    sorted by time inside a file so that time bounds skip row groups.
    """
    dated = log.withColumn("log_date", F.to_date(F.col(ts)))
    (
        dated.hint("rebalance", "log_date")
        .sortWithinPartitions("log_date", ts)
        .write.mode("overwrite")
        .partitionBy("log_date")
        .parquet(path)
    )


def write_parsed_log(parsed: DataFrame, path: str, *, ts: str = "ts") -> None:
    """Write every parsed line from one pass: good rows by day as `write_access_log` does, malformed lines beside them."""
    bad = F.col("reject_reason").isNotNull()
    dated = parsed.withColumns({"is_rejected": bad, "log_date": F.when(~bad, F.to_date(F.col(ts)))})
    # Only what a good row needs is kept of it: its text can be rendered again.
    dated = dated.withColumn("line", F.when(bad, F.col("line")))
    (
        dated.hint("rebalance", "is_rejected", "log_date")
        .sortWithinPartitions("is_rejected", "log_date", ts)
        .write.mode("overwrite")
        .partitionBy("is_rejected", "log_date")
        .parquet(path)
    )


def read_parsed_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines of `write_parsed_log`; `schema` is that of the parsed lines."""
    whole = T.StructType([*schema, T.StructField("is_rejected", T.BooleanType()), T.StructField("log_date", T.DateType())])
    table = spark.read.schema(whole).parquet(path)
    good = table.where(~F.col("is_rejected")).drop("is_rejected", "reject_reason", "line", "file")
    return good, rejected_lines(table.where("is_rejected"))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(lines: DataFrame, path: str, *, column: str = "line", order: list[str] | None = None) -> None:
    """Text lines to files; with `order`, files and lines in that order (range partitioned)."""
    ordered = lines.orderBy(*order) if order else lines
    ordered.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
