"""Session settings and the shared folder used for written intermediate tables."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


# Settings the results or the speed of every query rely on; they can be set at run time.
# All times in a log are UTC. The JVM never compiles a method of more than 8,000 bytes: a stage
# whose generated code is longer is better run operator by operator.
QUERY_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "trafficlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` overrides (dots as `__`)."""
    settings = {
        **QUERY_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites are collected for error messages at a high cost per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the settings queries rely on."""
    for key, value in QUERY_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's `spark.checkpoint.dir`. Raises where none is named."""
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/trafficlens/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """`df` as a table under the shared folder: later jobs read it instead of repeating the work.

    Survives lost executors and cuts the lineage. The folder is left to the cluster's clean-up, since the
    result may be read at any later time.
    """
    path = shared_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
