"""Rollups kept as tables: what has been added up once is not read again, and late rows change their days only."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.clock import from_epoch
from trafficlens.operators.stats import DIMENSIONS, partials, rollup
from trafficlens.schema import require_positive

DAY = 86_400


@dataclass
class RollupTable:
    """Partial statistics by day under one path, in cells of `levels` seconds, each a multiple of the one before.

    Every load keeps its finest cells in a folder of its own, so a load that is run again replaces itself and nothing
    is counted twice. The coarser levels hold all loads together: the days that a load touches, or touched when it was
    last run, are merged from the cells of all loads, level by level, and overwritten; other days stay as they are.
    The driver sees the list of those days.
    """

    spark: SparkSession
    path: str
    levels: Sequence[int] = (60, 3600, DAY)
    keys: Sequence[str] = ()
    dims: Sequence[str] = tuple(DIMENSIONS)

    def __post_init__(self):
        for finer, coarser in zip(self.levels, self.levels[1:]):
            if coarser % finer or DAY % coarser:
                raise ValueError("levels must divide one another and a day")
        require_positive("levels", self.levels[0])

    def load(self, name: str, log: DataFrame) -> None:
        """Add the rows of `log`, or replace what the load of this name has added before."""
        folder = f"{self.path}/loads/load={name}"
        before = self._days(folder)
        cells = rollup(partials(log, keys=self.keys), self.levels[0], keys=self.keys, dims=self.dims)
        self._by_day(cells).write.mode("overwrite").partitionBy("day").parquet(folder)
        days = sorted(before | self._days(folder))
        if not days:
            return
        touched = F.col("day").isin(days)
        merged = self.spark.read.parquet(f"{self.path}/loads").where(touched)
        for secs in self.levels[1:]:
            merged = rollup(merged, secs, keys=self.keys, dims=self.dims)
            out = f"{self.path}/level={secs}"
            present = self._by_day(merged)
            # A day that has lost all its rows is emptied too: its partition is overwritten by none.
            self._drop_days(out, before)
            present.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
            merged = self.spark.read.schema(present.schema).parquet(out).where(touched)

    def table(self, secs: int) -> DataFrame:
        """Cells of a kept level: `keys, period_start, dims, n, bytes_in, bytes_out, first_ts`."""
        if secs == self.levels[0]:
            cells = rollup(self.spark.read.parquet(f"{self.path}/loads"), secs, keys=self.keys, dims=self.dims)
        else:
            cells = self.spark.read.parquet(f"{self.path}/level={secs}")
        return cells.select(
            *self.keys, from_epoch(F.col("sec")).alias("period_start"), *self.dims, "n", "bytes_in", "bytes_out", "first_ts"
        )

    def _by_day(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn("day", F.floor(F.col("sec") / DAY).cast("long"))

    def _days(self, path: str) -> set[int]:
        try:
            return {r["day"] for r in self.spark.read.parquet(path).select("day").distinct().collect()}
        except Exception as missing:
            if any(name in str(missing) for name in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                return set()
            raise

    def _drop_days(self, path: str, days: set[int]) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for day in days:
            place = hadoop(f"{path}/day={day}")
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
