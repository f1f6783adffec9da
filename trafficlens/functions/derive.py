"""Columns derived from a parsed access-log row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.schema import INBOUND_METHODS, OUT_OF_RANGE, STATUS_CATEGORIES


def status_category(status: Column) -> Column:
    """Category of the hundred `status` falls in; outside 100-599 it is `OutOfRange`."""
    names = F.array(*[F.lit(name) for name in STATUS_CATEGORIES])
    return F.when(
        status.between(100, 599), F.get(names, F.floor(status / 100).cast("int") - 1)
    ).otherwise(F.lit(OUT_OF_RANGE))


def is_inbound(method: Column) -> Column:
    """True when the bytes of the request were received from the client."""
    return method.isin(INBOUND_METHODS)


def in_bytes(method: Column, size: Column) -> Column:
    return F.when(is_inbound(method), size).otherwise(F.lit(0).cast("long"))


def out_bytes(method: Column, size: Column) -> Column:
    return F.when(is_inbound(method), F.lit(0).cast("long")).otherwise(size)
