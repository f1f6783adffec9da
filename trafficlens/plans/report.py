"""Period report as text lines: header, top lists, byte totals."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import display_datetime, from_epoch
from trafficlens.functions.render import human_size
from trafficlens.operators.stats import DIMENSIONS, all_dimensions, ranked

# Texts of the report.
REPORT_NAME = "General HTTP Traffic Statistics"
LIST_TITLES = {
    "section": "Count per section:",
    "method": "Count per method:",
    "version": "Count per version:",
    "category": "Count per status category:",
}
RECEIVED_LABEL = "Total received (POST, PUT): "
SENT_LABEL = "Total sent (GET, HEAD, PATCH, OPTIONS, DELETE): "
IO_LABEL = "Total IO: "

# Line numbers leave room between the parts; only their order matters.
_LIST_AT = {dim: 100 * (i + 1) for i, dim in enumerate(DIMENSIONS)}
_TOTALS_AT = 900


def report_lines(counted: DataFrame, period_secs: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """`period_start, line_no, line` from the rows of `all_dimensions`.

    Each ranked row turns into its own lines: the facts row into header and totals, a list entry
    into its line, the first entry of a list also into the title. Nothing is joined back.
    """
    rows = ranked(counted, ["period_start_sec"], keys=keys)
    start = F.col("period_start_sec")
    line = lambda no, text: F.struct(
        (F.lit(no) if isinstance(no, int) else no).cast("int").alias("line_no"), text.alias("line")
    )
    text = lambda value: F.lit(value)

    def total(label, size):
        return F.concat(
            text(label), human_size(size), text(" ("), human_size(size / F.lit(period_secs)), text("ps)")
        )

    facts = F.array(
        line(1, text(REPORT_NAME)),
        line(2, text("=" * len(REPORT_NAME))),
        line(3, text(f"Period: {period_secs} seconds")),
        line(4, F.concat(text("From: "), display_datetime(F.col("first_ts")))),
        line(5, F.concat(text("To: "), display_datetime(from_epoch(start + (period_secs - 1))))),
        line(6, F.concat(text("Count: "), F.col("n").cast("string"))),
        line(7, F.format_string("Logs per second: %.2f", F.col("n") / F.lit(period_secs))),
        line(_TOTALS_AT, total(RECEIVED_LABEL, F.col("bytes_in"))),
        line(_TOTALS_AT + 1, total(SENT_LABEL, F.col("bytes_out"))),
        line(_TOTALS_AT + 2, total(IO_LABEL, F.col("bytes_in") + F.col("bytes_out"))),
    )
    at, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for dim in DIMENSIONS:
        at = F.when(F.col("dim") == dim, F.lit(_LIST_AT[dim])).otherwise(at)
        title = F.when(F.col("dim") == dim, F.lit(LIST_TITLES[dim])).otherwise(title)
    entry = line(
        at + F.col("rank"), F.concat(text(" - "), F.col("value"), text(": "), F.col("n").cast("string"))
    )
    entries = F.when(F.col("rank") == 1, F.array(line(at, title), entry)).otherwise(F.array(entry))
    return rows.select(
        *keys,
        from_epoch(start).alias("period_start"),
        F.inline(F.when(F.col("dim").isNull(), facts).otherwise(entries)),
    )


def period_report(placed: DataFrame, period_secs: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Report lines of partials that carry their `period_start_sec`."""
    return report_lines(all_dimensions(placed, keys=keys), period_secs, keys=keys)
