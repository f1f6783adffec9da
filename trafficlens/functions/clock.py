"""Reading and writing log timestamps. Everything is UTC at one second resolution.

Longer expressions are SQL text: one call to the JVM instead of hundreds.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names, short then full, lower case.
MONTH_NAMES = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# `d/M/yyyy:H:m:s Z`, the month a number or a name; hours, minutes, seconds and offset in range.
DATETIME_PATTERN = (
    r"^[0-9]{1,2}/(?:[0-9]{1,2}|[A-Za-z]{3,9})/[0-9]{4}"
    r":(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9] [+-](?:0[0-9]|1[0-8])[0-5][0-9]\z"
)
# The usual form of it, `dd/MMM/yyyy:HH:mm:ss Z`: every part is at a fixed place.
FIXED_PATTERN = (
    r"^[0-9]{2}/[A-Za-z]{3}/[0-9]{4}"
    r":(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-](?:0[0-9]|1[0-8])[0-5][0-9]\z"
)
FIXED_PLACES = [(1, 2), (4, 3), (8, 4), (13, 2), (16, 2), (19, 2), (22, 5)]


def datetime_parts(text: str) -> str:
    """SQL: the log datetime `text` cut into its seven parts, null when the form is not followed."""
    places = ", ".join(f"substring({text}, {at}, {n})" for at, n in FIXED_PLACES)
    return (
        f"CASE WHEN {text} RLIKE r'{FIXED_PATTERN}' THEN array({places}) "
        f"WHEN {text} RLIKE r'{DATETIME_PATTERN}' THEN split(replace(replace({text}, '/', ' '), ':', ' '), ' ') END"
    )


def datetime_from_parts(parts: str) -> str:
    """SQL: timestamp of `datetime_parts`; null when they are, or when there is no such day.

    The month is a number, a short or a full English name. Plain integer arithmetic: a pattern
    based parser pays for an exception on every row whose month form is not the first one tried.
    """
    day, month, year, hour, minute, second, zone = (f"get({parts}, {i})" for i in range(7))
    names = ", ".join(f"'{name}'" for name in MONTH_NAMES)
    name_at = f"array_position(array({names}), lower({month}))"
    number = (
        f"CASE WHEN substring({month}, 1, 1) <= '9' THEN {month} "
        f"WHEN {name_at} > 0 THEN CAST(({name_at} - 1) % 12 + 1 AS STRING) END"
    )
    days = f"unix_date(try_cast(concat({year}, '-', {number}, '-', {day}) AS DATE))"
    of_day = f"CAST({hour} AS INT) * 3600 + CAST({minute} AS INT) * 60 + CAST({second} AS INT)"
    offset = f"CAST({zone} AS INT)"  # +0130 is 130
    shift = f"({offset} DIV 100 * 3600 + {offset} % 100 * 60)"
    return f"timestamp_seconds(CAST({days} AS BIGINT) * 86400 + ({of_day} - {shift}))"


def parse_datetime(column: str) -> Column:
    """Timestamp of a log datetime column, null when malformed."""
    return F.expr(datetime_from_parts(datetime_parts(column)))


def format_datetime(ts: Column) -> Column:
    """`dd/MM/yyyy:HH:mm:ss +0000`, the month always a number."""
    return F.concat(F.date_format(ts, "dd/MM/yyyy:HH:mm:ss"), F.lit(" +0000"))


def display_datetime(ts: Column) -> Column:
    """Formatted timestamp followed by its epoch milliseconds in brackets."""
    return F.concat(format_datetime(ts), F.lit(" ("), F.unix_millis(ts).cast("string"), F.lit(")"))


def truncate_to_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def epoch_second(ts: Column) -> Column:
    """Whole seconds since 1970, as bigint."""
    return F.unix_seconds(ts)


def from_epoch(sec: Column) -> Column:
    return F.timestamp_seconds(sec)


def naive(ts: Column) -> Column:
    """Timestamp without time zone, the form results are handed out in."""
    return ts.cast("timestamp_ntz")


def floor_to(sec: Column, length: int, origin: int = 0) -> Column:
    """Start of the grid cell of `length` seconds holding `sec`; grid shifted by `origin`."""
    shifted = sec - F.lit(origin).cast("long")
    return shifted - F.pmod(shifted, F.lit(length).cast("long")) + F.lit(origin).cast("long")
