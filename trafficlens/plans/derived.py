"""An access log derived from the `events` table, one request per event."""

from pyspark.sql import DataFrame, SparkSession

from trafficlens.functions.clf import section_sql

# What the derived requests use, by event number.
_METHODS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]
_VERSIONS = ["1.0", "1.1", "2.0"]
_STATUSES = [200, 201, 301, 404, 503, 100]

# Which events are written as malformed lines, and why; the first match wins.
MALFORMED = [(89, "structure"), (79, "datetime"), (83, "request"), (73, "status"), (97, "bytes")]


def _cycle(values: list) -> str:
    return f"get(array({', '.join(repr(v) for v in values)}), CAST(event_id % {len(values)} AS INT))"


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_log(events: DataFrame) -> DataFrame:
    """`event_id` and the columns of a parsed access log, `section` included."""
    resource = (
        "CASE WHEN event_id % 5 = 0 THEN concat('/', event_type) "
        "ELSE concat('/', event_type, '/', user_id % 10, '/item') END"
    )
    return events.selectExpr(
        "event_id",
        "concat('10.0.', user_id DIV 256, '.', user_id % 256) AS host",
        "'-' AS ident",
        "concat('u', user_id) AS auth_user",
        "date_trunc('second', CAST(ts AS TIMESTAMP)) AS ts",
        f"{_cycle(_METHODS)} AS method",
        f"{resource} AS resource",
        f"{_cycle(_VERSIONS)} AS version",
        f"{_cycle(_STATUSES)} AS status",
        "CAST(floor(value * 100) AS BIGINT) AS bytes",
        f"{section_sql(f'({resource})')} AS section",
    )


def log_lines(events: DataFrame) -> DataFrame:
    """`event_id, line`: the log as text, in two zones and three month forms, some lines malformed."""
    reasons = " ".join(f"WHEN event_id % {every} = 0 THEN '{why}'" for every, why in MALFORMED)
    rows = access_log(events).selectExpr(
        "*",
        "CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS local",
        "CASE WHEN event_id % 4 = 0 THEN ' +0100' ELSE ' +0000' END AS zone",
        f"coalesce(CASE {reasons} END, '') AS why",
    )
    month = (
        "CASE event_id % 3 WHEN 0 THEN date_format(local, 'MM') "
        "WHEN 1 THEN date_format(local, 'MMM') ELSE date_format(local, 'MMMM') END"
    )
    datetime = (
        "CASE why WHEN 'datetime' THEN '02/Nov/2020:10 +0100' ELSE "
        f"concat(date_format(local, 'dd'), '/', {month}, '/', date_format(local, 'yyyy:HH:mm:ss'), zone) END"
    )
    line = f"""concat(
        host, CASE why WHEN 'structure' THEN '' ELSE concat(' ', ident) END, ' ', auth_user,
        ' [', {datetime}, '] "', CASE why WHEN 'request' THEN 'TRACE' ELSE method END, ' ', resource,
        ' HTTP/', version, '" ', CASE why WHEN 'status' THEN 'abc' ELSE CAST(status AS STRING) END,
        ' ', CASE why WHEN 'bytes' THEN '-' ELSE CAST(bytes AS STRING) END)"""
    return rows.selectExpr("event_id", f"{line} AS line")
