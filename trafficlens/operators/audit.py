"""Are two tables the same rows, each as often? Without a join, a sort or an order.

Rows are told by two independent hashes; a group of rows by its count and the sums of both. Sums do not depend on
order, count repeated rows as often as they occur, and are combined on the map side, so a group may hold any share of
the rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUM = "decimal(38,0)"


def multiset_digest(rows: DataFrame, columns: Sequence[str], *, by: Sequence[Column] = ()) -> DataFrame:
    """`n, hash_1, hash_2` of the rows of each group `by` (named columns), over `columns`; nulls count as values.

    Tables of equal digests hold the same rows but with a chance of about 2^-120 a group.
    """
    # A hash skips nulls, so whether a value is there is hashed too.
    there = [F.col(c).isNull() for c in columns]
    first = F.xxhash64(*[F.col(c) for c in columns], *there)
    second = F.xxhash64(F.lit("second"), *there, *[F.col(c) for c in reversed(columns)])
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(first.cast(_SUM)), F.lit(0)).cast(_SUM).alias("hash_1"),
        F.coalesce(F.sum(second.cast(_SUM)), F.lit(0)).cast(_SUM).alias("hash_2"),
    )


def multiset_differences(left: DataFrame, right: DataFrame, columns: Sequence[str], *, by: Sequence[Column] = ()) -> DataFrame:
    """Every group of either table: `n_left, n_right, same`. One aggregation of both, no join."""
    names = [f"_by{i}" for i in range(len(by))]
    side = lambda df, number: df.select(
        *columns, *[c.alias(n) for c, n in zip(by, names)], F.lit(number).alias("_side")
    )
    both = side(left, 0).unionByName(side(right, 1))
    digests = multiset_digest(both, columns, by=[*[F.col(n) for n in names], F.col("_side")])
    of = lambda column, number: F.coalesce(F.sum(F.when(F.col("_side") == number, F.col(column))), F.lit(0))
    compared = digests.groupBy(*names).agg(
        of("n", 0).alias("n_left"),
        of("n", 1).alias("n_right"),
        *[of(h, 0).eqNullSafe(of(h, 1)).alias(f"_{h}") for h in ("hash_1", "hash_2")],
    )
    labels = left.select(*by).columns if by else []
    return compared.select(
        *[F.col(n).alias(label) for n, label in zip(names, labels)],
        "n_left",
        "n_right",
        ((F.col("n_left") == F.col("n_right")) & F.col("_hash_1") & F.col("_hash_2")).alias("same"),
    )
