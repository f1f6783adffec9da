"""Column names, types and fixed values shared by every module."""

from pyspark.sql import types as T

ACCESS_LOG = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("ident", T.StringType()),
        T.StructField("auth_user", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
    ]
)

# The HTTP methods a request line may carry.
METHODS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]

# Methods whose bytes are received from the client; the others are sent to it.
INBOUND_METHODS = ["PUT", "POST", "PATCH"]

# Status categories, each covering a hundred statuses from 100 to 599.
STATUS_CATEGORIES = ["InformationResponse", "Success", "Redirection", "ClientError", "ServerError"]
OUT_OF_RANGE = "OutOfRange"

# Default period of the statistics, default period and threshold of the gauge.
STATS_PERIOD_SECS = 10
GAUGE_PERIOD_SECS = 120
GAUGE_THRESHOLD = 10.0

# Why a line was set aside, in the order the checks are made.
REJECT_REASONS = ["structure", "datetime", "request", "status", "bytes"]


def require_positive(name: str, value) -> None:
    if not value > 0:
        raise ValueError(f"{name} must be > 0, got {value}")
