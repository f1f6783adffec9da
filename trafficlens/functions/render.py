"""Typed columns back to text: log lines, sizes, alerts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.functions.clock import display_datetime, format_datetime

# Unit letters of readable sizes, each 1024 times the one before.
SIZE_UNITS = ["B", "K", "M", "G", "T", "P"]

# Alert texts.
MESSAGE_UP = "High Traffic"
MESSAGE_DOWN = "Traffic is back to normal"
GAUGE_NAME_FORMAT = "High Traffic Gauge (%.2f req. per sec.)"
ALERT_FORMAT = "%s: %s - hits = {%d}, avg: %.2f, triggered: {%s}"


def clf_line(
    host="host", ident="ident", auth_user="auth_user", ts="ts", method="method",
    resource="resource", version="version", status="status", size="bytes",
) -> Column:
    """The row as one log line that parses back to the same row."""
    text = lambda name: F.col(name).cast("string")
    return F.concat(
        F.col(host), F.lit(" "), F.col(ident), F.lit(" "), F.col(auth_user),
        F.lit(" ["), format_datetime(F.col(ts)), F.lit('] "'),
        F.col(method), F.lit(" "), F.col(resource), F.lit(" HTTP/"), F.col(version),
        F.lit('" '), text(status), F.lit(" "), text(size),
    )


def human_size(size: Column) -> Column:
    """Bytes with two decimals and a unit, scaled by 1024; petabytes at most."""
    size = size.cast("double")
    out = F.when(size < 1024, F.format_string("%.2fB", size))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = F.format_string(f"%.2f{unit}B", size / float(1024**power))
        if power < len(SIZE_UNITS) - 1:
            out = out.when(size < float(1024 ** (power + 1)), scaled)
        else:
            out = out.otherwise(scaled)
    return out


def gauge_name(threshold: float) -> str:
    return GAUGE_NAME_FORMAT % threshold


def alert_text(name: str, is_up: Column, position: Column, average: Column, ts: Column) -> Column:
    message = F.when(is_up, F.lit(MESSAGE_UP)).otherwise(F.lit(MESSAGE_DOWN))
    return F.format_string(ALERT_FORMAT, F.lit(name), message, position, average, display_datetime(ts))
