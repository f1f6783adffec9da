"""DuckDB SQL for the named queries, written from the columns of `events` without any parsing."""

from trafficlens.plans.derived import MALFORMED
from trafficlens.plans.queries import (
    ANCHORED_PERIOD,
    AUDIT,
    BYTE_LIMIT,
    DAY,
    GAUGE,
    HISTOGRAM,
    HOUR,
    INTERVAL,
    LATE_EVERY,
    MIXED,
    PERIOD_LENGTHS,
    START_FROM,
    STATS_PERIOD,
    STREAM_DELAY_SECS,
)
from trafficlens.plans.report import IO_LABEL, LIST_TITLES, RECEIVED_LABEL, REPORT_NAME, SENT_LABEL

_REASON = "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{why}'" for n, why in MALFORMED) + " END"

ACCESS_LOG = f"""access_log AS (
  SELECT event_id,
    concat('10.0.', user_id // 256, '.', user_id % 256) AS host, '-' AS ident, concat('u', user_id) AS auth_user,
    date_trunc('second', ts) AS ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec,
    CASE event_id % 7 WHEN 0 THEN 'GET' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'POST' WHEN 3 THEN 'PUT'
      WHEN 4 THEN 'PATCH' WHEN 5 THEN 'DELETE' ELSE 'OPTIONS' END AS method,
    CASE WHEN event_id % 5 = 0 THEN concat('/', event_type)
      ELSE concat('/', event_type, '/', user_id % 10, '/item') END AS resource,
    CASE WHEN event_id % 5 <> 0 THEN concat('/', event_type) END AS section,
    CASE event_id % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '1.1' ELSE '2.0' END AS version,
    CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 100 END AS status,
    CASE event_id % 6 WHEN 0 THEN 'Success' WHEN 1 THEN 'Success' WHEN 2 THEN 'Redirection' WHEN 3 THEN 'ClientError'
      WHEN 4 THEN 'ServerError' ELSE 'InformationResponse' END AS category,
    CAST(floor(value * 100) AS BIGINT) AS bytes,
    CASE WHEN event_id % 7 IN (2, 3, 4) THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS b_in,
    CASE WHEN event_id % 7 IN (2, 3, 4) THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS b_out,
    {_REASON} AS reason
  FROM events)"""

BODY = "host, ident, auth_user, ts, method, resource, version, status, bytes, section"


def _with(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([ACCESS_LOG, *ctes]) + "\n" + body


def _at(sec: str) -> str:
    return f"make_timestamp(CAST({sec} AS BIGINT) * 1000000)"


def _cell(secs: int, sec: str = "sec") -> str:
    return f"({sec} - {sec} % {secs})"


def _two_decimals(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(38,12)), 2) AS DECIMAL(38,2)) AS VARCHAR)"


def _size(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    steps = [f"WHEN {x} < 1024 THEN {_two_decimals(x)} || 'B'"]
    for power, unit in enumerate("KMGT", start=1):
        steps.append(f"WHEN {x} < {1024 ** (power + 1)} THEN {_two_decimals(f'{x} / {1024 ** power}')} || '{unit}B'")
    return f"CASE {' '.join(steps)} ELSE {_two_decimals(f'{x} / {1024 ** 5}')} || 'PB' END"


def _display(ts: str) -> str:
    return f"strftime({ts}, '%d/%m/%Y:%H:%M:%S +0000') || ' (' || CAST(epoch_ms({ts}) AS VARCHAR) || ')'"


_SUMS = "CAST(sum(b_in) AS BIGINT) AS bytes_in, CAST(sum(b_out) AS BIGINT) AS bytes_out"
_FACTS = f"""SELECT {_cell(STATS_PERIOD)} AS p, min(ts) AS from_ts, count(*) AS n, {_SUMS},
  CAST(sum(bytes) AS BIGINT) AS bytes_total FROM access_log GROUP BY 1"""
_DIMS = """dims AS (
  SELECT {p} AS p, 'section' AS dim, section AS value FROM access_log WHERE section IS NOT NULL
  UNION ALL SELECT {p}, 'method', method FROM access_log
  UNION ALL SELECT {p}, 'version', version FROM access_log
  UNION ALL SELECT {p}, 'category', category FROM access_log)"""
_COUNTED = "counted AS (SELECT p, dim, value, count(*) AS n FROM dims GROUP BY 1, 2, 3)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY p, dim ORDER BY n DESC, value DESC) AS rank FROM counted)"
_HOURLY_DIMS = _DIMS.format(p=_cell(STATS_PERIOD))


def _count_per(dim: str) -> str:
    return _with(
        f"SELECT {_at(_cell(STATS_PERIOD))} AS period_start, {dim}, count(*) AS n FROM access_log "
        f"WHERE {dim} IS NOT NULL GROUP BY 1, 2"
    )


def _gauge_ctes(bucket: int, period: int, threshold: float, key: str = "") -> list[str]:
    k = f"{key}, " if key else ""
    by = f"PARTITION BY {key} " if key else ""
    return [
        f"""numbered AS (SELECT *, {_cell(bucket)} AS bucket,
          row_number() OVER (PARTITION BY {k}{_cell(bucket)} ORDER BY ts, event_id) AS rn FROM access_log)""",
        f"""hits AS (SELECT {k}bucket, bucket - bucket % {period} AS p, count(*) AS hits, min(ts) AS first_ts,
          min(CASE WHEN rn = {int(threshold)} + 1 THEN ts END) AS limit_ts FROM numbered GROUP BY ALL)""",
        f"""averages AS (SELECT *, CAST(sum(hits) OVER w AS BIGINT) AS cum, row_number() OVER w AS buckets,
          lead(bucket) OVER w AS next_bucket, lead(first_ts) OVER w AS next_first_ts,
          CAST(sum(hits) OVER w AS DOUBLE) / row_number() OVER w AS average FROM hits
          WINDOW w AS (PARTITION BY {k}p ORDER BY bucket ROWS UNBOUNDED PRECEDING))""",
        f"""signed AS (SELECT *, CASE WHEN next_bucket IS NULL THEN NULL WHEN average > {threshold} THEN true
          WHEN average < {threshold} THEN false END AS sign FROM averages)""",
        f"""states AS (SELECT *,
          coalesce(last_value(sign IGNORE NULLS) OVER ({by}ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was_high,
          coalesce(last_value(sign IGNORE NULLS) OVER ({by}ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_high
          FROM signed)""",
        f"""crossed AS (SELECT {k}bucket, is_high AS is_up, average,
          CASE WHEN is_high THEN cum - hits + {int(threshold)} ELSE cum END AS position,
          CASE WHEN is_high THEN limit_ts ELSE next_first_ts END AS crossed_ts
          FROM states WHERE is_high <> was_high)""",
    ]


_GAUGE = _gauge_ctes(GAUGE["bucket_secs"], GAUGE["period_secs"], GAUGE["threshold"])
_CROSSED_COLUMNS = f"{_at('bucket')} AS bucket_ts, is_up, CAST(position AS BIGINT) AS position, average, crossed_ts"
_ALERT = (
    f"'High Traffic Gauge ({GAUGE['threshold']:.2f} req. per sec.): ' || "
    "CASE WHEN is_up THEN 'High Traffic' ELSE 'Traffic is back to normal' END || ' - hits = {' || "
    f"CAST(CAST(position AS BIGINT) AS VARCHAR) || '}}, avg: ' || {_two_decimals('average')} || "
    f"', triggered: {{' || {_display('crossed_ts')} || '}}'"
)

# A chain of period starts: the first second, then always the first one a period length later.
_ANCHORED = [
    "secs AS (SELECT DISTINCT sec FROM access_log)",
    f"""succ AS (SELECT sec, min(sec) OVER (ORDER BY sec RANGE BETWEEN {ANCHORED_PERIOD} FOLLOWING AND UNBOUNDED FOLLOWING)
      AS nxt FROM secs)""",
    """starts AS (SELECT min(sec) AS s FROM secs
      UNION ALL SELECT succ.nxt FROM starts JOIN succ ON succ.sec = starts.s WHERE succ.nxt IS NOT NULL)""",
    f"placed AS (SELECT a.*, s AS p FROM access_log a JOIN starts ON a.sec BETWEEN s AND s + {ANCHORED_PERIOD - 1})",
]

_PROBES = "probes AS (SELECT event_id, sec + (user_id * 7) % 600 AS probe FROM access_log JOIN (SELECT event_id, user_id FROM events) USING (event_id))"
_SECS = "secs AS (SELECT DISTINCT sec FROM access_log)"


def _report(table: str = "access_log", *ctes: str) -> str:
    facts = [
        (1, f"'{REPORT_NAME}'"),
        (2, f"'{'=' * len(REPORT_NAME)}'"),
        (3, f"'Period: {STATS_PERIOD} seconds'"),
        (4, f"'From: ' || {_display('from_ts')}"),
        (5, f"'To: ' || {_display(_at(f'p + {STATS_PERIOD - 1}'))}"),
        (6, "'Count: ' || CAST(n AS VARCHAR)"),
        (7, f"'Logs per second: ' || {_two_decimals(f'CAST(n AS DOUBLE) / {STATS_PERIOD}')}"),
    ]
    for at, label, size in [
        (900, RECEIVED_LABEL, "bytes_in"),
        (901, SENT_LABEL, "bytes_out"),
        (902, IO_LABEL, "bytes_total"),
    ]:
        facts.append((at, f"'{label}' || {_size(size)} || ' (' || {_size(f'CAST({size} AS DOUBLE) / {STATS_PERIOD}')} || 'ps)'"))
    parts = [f"SELECT {_at('p')} AS period_start, {no} AS line_no, {text} AS line FROM facts" for no, text in facts]
    for i, (dim, title) in enumerate(LIST_TITLES.items(), start=1):
        parts.append(f"SELECT {_at('p')}, {100 * i}, '{title}' FROM ranked WHERE dim = '{dim}' AND rank = 1")
        parts.append(
            f"SELECT {_at('p')}, {100 * i} + rank, ' - ' || value || ': ' || CAST(n AS VARCHAR) "
            f"FROM ranked WHERE dim = '{dim}' AND rank <= 10"
        )
    body = "SELECT period_start, CAST(line_no AS INTEGER) AS line_no, line FROM (" + " UNION ALL ".join(parts) + ")"
    of_table = [cte.replace("FROM access_log", f"FROM {table}") for cte in (f"facts AS ({_FACTS})", _HOURLY_DIMS)]
    return _with(body, *ctes, *of_table, _COUNTED, _RANKED)


def _densified_average(bucket: int, period: int) -> str:
    return _with(
        f"SELECT {_at('bucket')} AS bucket_ts, hits, CAST(sum(hits) OVER w AS BIGINT) AS cum, "
        "row_number() OVER w AS buckets, CAST(sum(hits) OVER w AS DOUBLE) / row_number() OVER w AS average FROM filled "
        "WINDOW w AS (PARTITION BY p ORDER BY bucket ROWS UNBOUNDED PRECEDING)",
        f"hits AS (SELECT {_cell(bucket)} AS bucket, count(*) AS hits FROM access_log GROUP BY 1)",
        f"bounds AS (SELECT bucket - bucket % {period} AS p, min(bucket) AS lo, max(bucket) AS hi FROM hits GROUP BY 1)",
        f"grid AS (SELECT p, unnest(range(lo, hi + 1, {bucket})) AS bucket FROM bounds)",
        "filled AS (SELECT grid.p, grid.bucket, coalesce(hits.hits, 0) AS hits FROM grid LEFT JOIN hits USING (bucket))",
    )


_MULTI = " UNION ALL ".join(
    f"SELECT {n} AS period_secs, {_at(_cell(n))} AS period_start, count(*) AS n, "
    f"CAST(count(*) AS DOUBLE) / {n} AS rate, {_SUMS} FROM access_log GROUP BY 1, 2"
    for n in PERIOD_LENGTHS
)
_KEPT = " UNION ALL ".join(
    f"SELECT {n} AS period_secs, {_at(_cell(n))} AS period_start, method, count(*) AS n, {_SUMS}, min(ts) AS from_ts "
    "FROM access_log GROUP BY 1, 2, 3"
    for n in (600, HOUR, DAY)
)
_ROLLUP = " UNION ALL ".join(
    f"SELECT {n} AS period_secs, {_at(_cell(n))} AS period_start, count(*) AS n, {_SUMS} FROM access_log GROUP BY 1, 2"
    for n in (600, 7200)
)

ORACLE: dict[str, str] = {
    "parse_clf": _with(f"SELECT event_id, {BODY} FROM access_log WHERE reason IS NULL"),
    "access_log_read": _with(f"SELECT {BODY} FROM access_log WHERE reason IS NULL"),
    "access_log_table": _with(
        "SELECT CAST(ts AS DATE) AS log_date, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_ts "
        "FROM access_log WHERE reason IS NULL GROUP BY 1"
    ),
    "section_of": _with("SELECT event_id, resource, section FROM access_log"),
    "status_category": _with(
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN status + 600 ELSE status END AS status, "
        "CASE WHEN event_id % 3 = 0 THEN 'OutOfRange' ELSE category END AS category FROM access_log"
    ),
    "rejects_by_reason": _with("SELECT reason, count(*) AS n FROM access_log WHERE reason IS NOT NULL GROUP BY 1"),
    "rejected_lines": _with(
        """SELECT reason, host || CASE WHEN reason = 'structure' THEN '' ELSE ' -' END || ' ' || auth_user || ' [' ||
          CASE WHEN reason = 'datetime' THEN '02/Nov/2020:10 +0100' ELSE
            CASE event_id % 3 WHEN 0 THEN strftime(local, '%d/%m/%Y:%H:%M:%S') WHEN 1 THEN strftime(local, '%d/%b/%Y:%H:%M:%S')
              ELSE strftime(local, '%d/%B/%Y:%H:%M:%S') END
            || CASE WHEN event_id % 4 = 0 THEN ' +0100' ELSE ' +0000' END END || '] "' ||
          CASE WHEN reason = 'request' THEN 'TRACE' ELSE method END || ' ' || resource || ' HTTP/' || version || '" ' ||
          CASE WHEN reason = 'status' THEN 'abc' ELSE CAST(status AS VARCHAR) END || ' ' ||
          CASE WHEN reason = 'bytes' THEN '-' ELSE CAST(bytes AS VARCHAR) END AS line
        FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS local FROM access_log)
        WHERE reason IS NOT NULL"""
    ),
    "custom_parser": (
        "SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents "
        "FROM events WHERE event_id % 50 <> 0"
    ),
    "render_clf": _with(
        f"""SELECT event_id, host || ' - ' || auth_user || ' [' || strftime(ts, '%d/%m/%Y:%H:%M:%S +0000') || '] "' ||
          method || ' ' || resource || ' HTTP/' || version || '" ' || CAST(status AS VARCHAR) || ' ' ||
          CAST(bytes AS VARCHAR) AS line, {_display('ts')} AS display_ts FROM access_log"""
    ),
    "roundtrip_audit": _with(
        "SELECT count(*) AS lines, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 = 0) AS unchanged, "
        "count(*) FILTER (event_id % 4 = 0 OR event_id % 3 <> 0) AS changed, CAST(0 AS BIGINT) AS lost "
        "FROM access_log WHERE reason IS NULL"
    ),
    "size_text": _with(
        f"SELECT event_id, {_size('bytes * pow(1024.0, event_id % 7)')} AS size_text FROM access_log"
    ),
    "period_stats": _with(
        f"SELECT {_at('p')} AS period_start, {_at(f'p + {STATS_PERIOD - 1}')} AS period_end, from_ts, n, "
        f"CAST(n AS DOUBLE) / {STATS_PERIOD} AS rate, bytes_in, bytes_out, bytes_total FROM ({_FACTS})"
    ),
    "tumbling_stats": _with(
        f"SELECT {_at(f'(sec - 600) - (sec - 600) % {STATS_PERIOD} + 600')} AS period_start, count(*) AS n, "
        "CAST(sum(bytes) AS BIGINT) AS bytes FROM access_log GROUP BY 1"
    ),
    "multi_period_stats": _with(_MULTI),
    "rollup_partials": _with(_ROLLUP),
    "rollup_tables": _with(_KEPT),
    "bytes_in_out": _with(f"SELECT {_at('p')} AS period_start, bytes_in, bytes_out, bytes_total FROM ({_FACTS})"),
    "count_per_section": _count_per("section"),
    "count_per_method": _count_per("method"),
    "count_per_version": _count_per("version"),
    "count_per_status_category": _with(
        f"SELECT {_at(_cell(STATS_PERIOD))} AS period_start, category, count(*) AS n FROM access_log GROUP BY 1, 2"
    ),
    "dimension_counts": _with(
        f"SELECT {_at('p')} AS period_start, dim, value, n FROM counted", _HOURLY_DIMS, _COUNTED
    ),
    "top10_per_dimension": _with(
        f"SELECT {_at('p')} AS period_start, dim, value, n, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
        _DIMS.format(p=_cell(DAY)).replace("section AS value", "auth_user AS value").replace("WHERE section IS NOT NULL", ""),
        _COUNTED,
        _RANKED,
    ),
    "custom_period_fn": _with(
        f"SELECT {_at(_cell(DAY))} AS period_start, {_at(f'{_cell(DAY)} + {DAY - 1}')} AS period_end, "
        "count(DISTINCT host) AS hosts, max(bytes) AS largest, count(*) AS n FROM access_log GROUP BY 1, 2"
    ),
    "custom_period_pandas": _with(
        f"SELECT {_at(_cell(DAY))} AS period_start, {_at(f'{_cell(DAY)} + {DAY - 1}')} AS period_end, "
        "count(*) AS n, max(bytes) AS largest FROM access_log GROUP BY 1, 2"
    ),
    "byte_alarm": _with(
        f"SELECT {_at('p')} AS period_start, total_lines, total_bytes FROM running "
        f"WHERE total_bytes >= {BYTE_LIMIT} ORDER BY p LIMIT 1",
        f"per_period AS (SELECT {_cell(HOUR)} AS p, count(*) AS n, sum(bytes) AS b FROM access_log GROUP BY 1)",
        "running AS (SELECT p, CAST(sum(n) OVER (ORDER BY p) AS BIGINT) AS total_lines, "
        "CAST(sum(b) OVER (ORDER BY p) AS BIGINT) AS total_bytes FROM per_period)",
    ),
    "period_totals_densified": _with(
        f"SELECT {_at('p')} AS period_start, coalesce(n, 0) AS n FROM grid LEFT JOIN counted USING (p)",
        f"counted AS (SELECT {_cell(600)} AS p, count(*) AS n FROM access_log GROUP BY 1)",
        "grid AS (SELECT unnest(range(min(p), max(p) + 1, 600)) AS p FROM counted)",
    ),
    "anchored_periods": _with(
        f"SELECT {_at('p')} AS period_start, {_at(f'p + {ANCHORED_PERIOD - 1}')} AS period_end, min(ts) AS from_ts, count(*) AS n, "
        f"CAST(count(*) AS DOUBLE) / {ANCHORED_PERIOD} AS rate, {_SUMS}, CAST(sum(bytes) AS BIGINT) AS bytes_total "
        "FROM placed GROUP BY p",
        *_ANCHORED,
        recursive=True,
    ),
    "anchored_rows": _with(
        f"SELECT event_id, ts, {_at('p')} AS period_start, {_at(f'p + {ANCHORED_PERIOD - 1}')} AS period_end FROM placed",
        *_ANCHORED,
        recursive=True,
    ),
    "period_report": _report(),
    "hits_per_second": _with("SELECT ts AS second, count(*) AS hits FROM access_log GROUP BY 1"),
    "running_avg_rate": _with(f"SELECT {_at('bucket')} AS bucket_ts, hits, cum, buckets, average FROM averages", *_GAUGE),
    "running_avg_densified": _densified_average(600, DAY),
    "traffic_state": _with(f"SELECT {_at('bucket')} AS bucket_ts, average, was_high, is_high FROM states", *_GAUGE),
    "traffic_crossings": _with(f"SELECT {_CROSSED_COLUMNS} FROM crossed", *_GAUGE),
    "traffic_crossings_by_method": _with(
        f"SELECT method, {_CROSSED_COLUMNS} FROM crossed", *_gauge_ctes(HOUR, DAY, 2.0, "method")
    ),
    "traffic_alert_text": _with(f"SELECT {_at('bucket')} AS bucket_ts, {_ALERT} AS line FROM crossed", *_GAUGE),
    "interval_fetch": _with(
        f"SELECT event_id, ts, host, resource FROM access_log WHERE ts BETWEEN TIMESTAMP '{INTERVAL[0]}' AND TIMESTAMP '{INTERVAL[1]}'"
    ),
    "interval_join": _with(
        f"SELECT day, event_id, ts FROM access_log JOIN spans ON sec BETWEEN s AND s + {HOUR - 1}",
        "spans AS (SELECT CAST(ts AS DATE) AS day, min(sec) AS s FROM access_log WHERE resource LIKE '/error%' GROUP BY 1)",
    ),
    "interval_join_mixed": _with(
        "SELECT day, power, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts "
        "FROM access_log JOIN spans ON sec BETWEEN s AND s + CAST(pow(4, power) AS BIGINT) - 1 GROUP BY 1, 2",
        "firsts AS (SELECT CAST(ts AS DATE) AS day, min(sec) AS s FROM access_log WHERE resource LIKE '/error%' GROUP BY 1)",
        f"spans AS (SELECT day, s, CAST(unnest(range(0, {MIXED})) AS INTEGER) AS power FROM firsts)",
    ),
    "roundtrip_multiset": _with(
        f"""SELECT CAST(ts AS DATE) AS day, count(*) AS n_left,
          CAST(count(*) - count(*) FILTER (event_id = {AUDIT["lost"]}) + count(*) FILTER (event_id = {AUDIT["doubled"]}) AS BIGINT) AS n_right,
          count(*) FILTER (event_id IN ({", ".join(map(str, AUDIT.values()))})) = 0 AS same
        FROM access_log WHERE reason IS NULL GROUP BY 1"""
    ),
    "first_ts": _with("SELECT coalesce(min(sec) * 1000, -1) AS first_millis FROM access_log"),
    "next_ts_after": _with(
        f"SELECT event_id, {_at('probe')} AS probe_ts, coalesce(secs.sec, -1) AS next_sec FROM probes ASOF LEFT JOIN secs ON probe < secs.sec",
        _PROBES,
        _SECS,
    ),
    "nearest_event": _with(
        f"""SELECT event_id, {_at('probe')} AS probe_ts, {_at('''CASE WHEN b.sec IS NULL OR probe - a.sec <= b.sec - probe
          THEN a.sec ELSE b.sec END''')} AS nearest_ts
        FROM probes ASOF LEFT JOIN secs a ON probe >= a.sec ASOF LEFT JOIN secs b ON probe <= b.sec""",
        _PROBES,
        _SECS,
    ),
    "second_extent": _with(
        "SELECT sec, count(*) AS n, min(i) AS first_index, max(i) AS last_index FROM indexed GROUP BY 1",
        "indexed AS (SELECT sec, row_number() OVER (ORDER BY sec, event_id) - 1 AS i FROM access_log)",
    ),
    "retention_tail": _with(
        f"SELECT event_id, ts FROM access_log WHERE sec >= (SELECT max(sec) FROM access_log) - {2 * DAY}"
    ),
    "append_batches": _with(
        "SELECT 'events' AS source, event_id AS id, ts, bytes FROM access_log UNION ALL "
        "SELECT 'orders', o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) FROM orders"
    ),
    "start_position": _with(f"SELECT event_id, ts, bytes FROM access_log WHERE ts >= TIMESTAMP '{START_FROM}'"),
    "stream_period_stats": _with(
        f"SELECT {_at('p')} AS period_start, from_ts, n, CAST(n AS DOUBLE) / {STATS_PERIOD} AS rate, bytes_in, bytes_out "
        f"FROM ({_FACTS.replace('access_log', 'good')}) WHERE p + {STATS_PERIOD} <= (SELECT max(sec) FROM good) - {STREAM_DELAY_SECS}",
        "good AS (SELECT * FROM access_log WHERE reason IS NULL)",
    ),
    "stream_alerts": _with(
        f"SELECT {_at('bucket')} AS bucket_ts, {_ALERT} AS line FROM crossed",
        "good AS (SELECT * FROM access_log WHERE reason IS NULL)",
        f"closed AS (SELECT * FROM good WHERE {_cell(HOUR)} + {HOUR} <= (SELECT max(sec) FROM good) - {STREAM_DELAY_SECS})",
        *[cte.replace("FROM access_log", "FROM closed") for cte in _GAUGE],
    ),
}

# The continuous job gives what the batch job gives for what its clock has passed.
ORACLE["stream_rejects"] = ORACLE["rejected_lines"]
_GOOD = "good AS (SELECT * FROM access_log WHERE reason IS NULL)"
_OVER = f"(SELECT max(sec) FROM good) - {STREAM_DELAY_SECS}"
_FACT_COLUMNS = (
    f"{_at('p')} AS period_start, {_at(f'p + {STATS_PERIOD - 1}')} AS period_end, from_ts, n, "
    f"CAST(n AS DOUBLE) / {STATS_PERIOD} AS rate, bytes_in, bytes_out, bytes_total"
)
ORACLE["stream_job"] = f"""
WITH every_line AS ({_report('good', _GOOD)}),
alert AS ({ORACLE["stream_alerts"]}),
rejected AS ({ORACLE["rejects_by_reason"]}),
ended AS (WITH {ACCESS_LOG}, {_GOOD} SELECT {_OVER} AS at FROM good LIMIT 1)
SELECT 'report' AS sink, period_start AS at, line_no, line FROM every_line, ended
WHERE epoch(period_start) + {STATS_PERIOD} <= ended.at
UNION ALL SELECT 'alert', bucket_ts, 1, line FROM alert
UNION ALL SELECT 'rejects', NULL, 1, reason || ': ' || CAST(n AS VARCHAR) FROM rejected
"""
ORACLE["stream_anchored_stats"] = ORACLE["anchored_periods"].replace("FROM access_log", "FROM good").replace(
    "secs AS (", f"{_GOOD}, secs AS (", 1
).replace("access_log a JOIN", "good a JOIN").replace("FROM placed GROUP BY p", f"FROM placed GROUP BY p HAVING p + {ANCHORED_PERIOD} <= {_OVER}")
ORACLE["stream_anchored_stats"] = ORACLE["stream_anchored_stats"].replace("SELECT * FROM good WHERE", "SELECT * FROM access_log WHERE")
ORACLE["stream_flushed"] = _with(f"SELECT {_FACT_COLUMNS} FROM ({_FACTS.replace('access_log', 'good')})", _GOOD)
ORACLE["stream_late_rows"] = _with(
    f"SELECT CASE WHEN late THEN 'late' ELSE 'counted' END AS kind, {_at(_cell(STATS_PERIOD))} AS period_start, count(*) AS n "
    "FROM parts GROUP BY 1, 2",
    _GOOD,
    # The late file's rows near the point where the other two meet are still in time.
    f"parts AS (SELECT *, ts < TIMESTAMP '{START_FROM}' AND event_id % {LATE_EVERY} = 0 AS late FROM good)",
)
ORACLE["stream_custom_period"] = _with(
    f"SELECT {_at('p')} AS period_start, CAST(max(total) AS BIGINT) AS n, min(bin) FILTER (met * 2 >= total) AS median_bin FROM running GROUP BY p",
    _GOOD,
    f"binned AS (SELECT {_cell(DAY)} AS p, least(bytes // {HISTOGRAM['width']}, {HISTOGRAM['bins'] - 1}) AS bin, count(*) AS n FROM good GROUP BY 1, 2)",
    "running AS (SELECT p, bin, sum(n) OVER (PARTITION BY p ORDER BY bin) AS met, sum(n) OVER (PARTITION BY p) AS total FROM binned)",
)
