"""Rows that share an id or have none, for operators that tell rows by their ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.session import written


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Has every row an id of its own?"""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return not ids.where("n > 1 or id is null").limit(1).count()


def with_row_ids(docs: DataFrame, row_col: str = "_row") -> DataFrame:
    """`docs` with a number of its own for every row. The table is written, so the numbers stay."""
    return written(docs.withColumn(row_col, F.monotonically_increasing_id()), "row-ids")
