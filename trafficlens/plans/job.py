"""The whole analysis of a log folder, as one batch job."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.clf import parse_clf
from trafficlens.operators.gauge import alerts, traffic_crossings
from trafficlens.operators.stats import in_anchored_periods
from trafficlens.plans.report import period_report
from trafficlens.schema import (
    GAUGE_PERIOD_SECS,
    GAUGE_THRESHOLD,
    STATS_PERIOD_SECS,
    require_positive,
)
from trafficlens.session import shared_path, prepare
from trafficlens.sources.text_log import (
    LineParser,
    read_log,
    read_parsed_log,
    write_parsed_log,
    write_text,
)


@dataclass
class Analysis:
    log: DataFrame
    rejected: DataFrame
    rejects: DataFrame
    report: DataFrame
    alerts: DataFrame

    def write(self, path: str) -> None:
        """Report and alerts as text files in time order; tables of rejected lines and of their number per reason."""
        write_text(self.report, f"{path}/report", order=["period_start", "line_no"])
        write_text(self.alerts, f"{path}/alerts", order=["bucket_ts"])
        self.rejected.write.mode("overwrite").parquet(f"{path}/rejected")
        self.rejects.write.mode("overwrite").parquet(f"{path}/rejects")


def analyse(
    spark: SparkSession,
    path: str,
    *,
    stats_period: int = STATS_PERIOD_SECS,
    gauge_period: int = GAUGE_PERIOD_SECS,
    threshold: float = GAUGE_THRESHOLD,
    parser: LineParser = parse_clf,
    table: str | None = None,
) -> Analysis:
    """Parse `path` once into a table, good rows by day and malformed lines, and do all the rest from that table.

    `table` is where the parsed log is written (default: a fresh path in the shared folder).
    """
    require_positive("stats_period", stats_period)
    require_positive("gauge_period", gauge_period)
    prepare(spark)
    parsed = read_log(spark, path, parser)
    table = table or shared_path(spark, "access-log")
    write_parsed_log(parsed, table)
    log, rejected = read_parsed_log(spark, table, parsed.schema)
    crossed = traffic_crossings(log, gauge_period, threshold, anchored=True)
    return Analysis(
        log=log,
        rejected=rejected,
        rejects=rejected.groupBy("reason").agg(F.count("*").alias("n")),
        report=period_report(in_anchored_periods(log, stats_period), stats_period),
        alerts=alerts(crossed, threshold),
    )
