"""Grouped sums over a stream: parts are micro-batches, the state store merges them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_group_sum(stream: DataFrame, key: str, value: str, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, sum), updated with every micro-batch; or (window, key, sum) with a time
    column and a window, where rows later than ``late`` behind the watermark are dropped
    and state is bounded by it."""
    if (time is None) != (window is None):
        raise ValueError("give both time and window, or neither")
    if time is None:
        return stream.groupBy(key).agg(F.sum(value).alias("sum"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.sum(value).alias("sum"))
