"""Running values over a whole timeline without a window that holds the whole timeline.

Rows are cut into blocks of positions. Windows run inside a block; one summary row per block carries
values across blocks. The window over the summaries sees one row per block of calendar time (one
per day by default, 36,525 in a century), whatever the number of log lines. Rows must already be
aggregated to one per key and position, so a block holds at most `blocks[0]` rows per key.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECS = 86_400
_BLOCK = "_block"


def scan(
    rows: DataFrame,
    position: str,
    *,
    keys: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    blocks: Sequence[int] = (DAY_SECS,),
) -> DataFrame:
    """Add running columns to `rows`, each excluding the row itself.

    `totals`: sum over all earlier rows (0 at the start). `lasts`: newest non-null value of an
    earlier row. `nexts`: oldest non-null value of a later row. `blocks` gives the positions per
    block, then the blocks per block of blocks and so on, for positions finer than seconds.
    """
    totals, lasts, nexts = dict(totals or {}), dict(lasts or {}), dict(nexts or {})
    if not blocks:
        return _within(rows, [*keys], position, totals, lasts, nexts)

    whole = f"_whole{len(blocks)}"
    size = F.lit(int(blocks[0])).cast("long")
    values = {**totals, **lasts, **nexts}
    block = F.call_function("div", F.col(position) - F.pmod(F.col(position), size), size)
    marked = rows.withColumns({_BLOCK: block, **{f"_v_{n}": c for n, c in values.items()}})
    value = {n: F.col(f"_v_{n}") for n in values}
    pick = lambda names: {n: value[n] for n in names}

    inside = _within(marked, [*keys, _BLOCK], position, pick(totals), pick(lasts), pick(nexts), prefix="_in_")

    at = lambda n: F.when(value[n].isNotNull(), F.col(position))
    summary = marked.groupBy(*keys, _BLOCK).agg(
        *[F.sum(value[n]).alias(f"_v_{n}") for n in totals],
        *[F.max_by(value[n], at(n)).alias(f"_v_{n}") for n in lasts],
        *[F.min_by(value[n], at(n)).alias(f"_v_{n}") for n in nexts],
        whole_row(rows).alias(whole),
    )
    renamed = lambda names: {f"_carry_{n}": value[n] for n in names}
    carried = scan(
        summary.withColumnRenamed(_BLOCK, "_at"),
        "_at",
        keys=keys,
        totals=renamed(totals),
        lasts=renamed(lasts),
        nexts=renamed(nexts),
        blocks=blocks[1:],
    ).select(*keys, F.col("_at").alias(_BLOCK), *[f"_carry_{n}" for n in values], whole)

    joined = match(inside, carried, [*keys, _BLOCK]).where(F.col(whole).isNotNull())
    return joined.select(
        *rows.columns,
        *[(F.col(f"_in_{n}") + F.col(f"_carry_{n}")).alias(n) for n in totals],
        *[F.coalesce(f"_in_{n}", f"_carry_{n}").alias(n) for n in [*lasts, *nexts]],
    )


def whole_row(rows: DataFrame) -> Column:
    """An aggregate that needs every column of `rows`, for a side branch that is joined back.

    A branch that reads fewer columns than its sibling gets a plan of its own, down to a second scan
    of the log. With the same columns Spark shares the exchange below both. Filter on not null (it
    always is) to keep the column from being pruned.
    """
    return F.max(F.xxhash64(*[F.col(c) for c in rows.columns]))


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `on` that keeps null keys together; the right copies of `on` are dropped."""
    theirs = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(theirs, condition, how).drop(*[f"_right_{c}" for c in on])


def _within(rows, part, position, totals, lasts, nexts, prefix=""):
    """The running columns inside each partition, plain windows."""
    forward = Window.partitionBy(*part).orderBy(F.col(position).asc())
    # Looking ahead is looking back over the reversed order: a frame that ends at the last row is
    # recomputed for every row, one that starts at the first row is not.
    backward = Window.partitionBy(*part).orderBy(F.col(position).desc())
    so_far = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return rows.select(
        "*",
        *[F.coalesce(F.sum(c).over(forward.rowsBetween(*so_far)), zero).alias(prefix + n) for n, c in totals.items()],
        *[F.last(c, ignorenulls=True).over(forward.rowsBetween(*so_far)).alias(prefix + n) for n, c in lasts.items()],
        *[F.last(c, ignorenulls=True).over(backward.rowsBetween(*so_far)).alias(prefix + n) for n, c in nexts.items()],
    )
