"""Columns as DataFrames of (pos, value), table scans, slices, and the Parquet sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import widened


def column(spark: SparkSession, values: Iterable, kind: str = "int64", name: str = "value") -> DataFrame:
    """An in-memory column: (pos bigint, name), positions from 0."""
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField(name, widened(kind))])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def adopt(spark: SparkSession, table) -> DataFrame:
    """A DataFrame of a pandas or Arrow table, handed over by Arrow batches."""
    return spark.createDataFrame(table)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of Parquet files. Filters and column lists reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slice_rows(df: DataFrame, begin: int, end: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows at positions begin <= pos < end (to the last one without an end)."""
    if end is not None and begin > end:
        raise ValueError(f"slice begins at {begin}, after its end {end}")
    p = F.col(pos)
    return df.where(p >= begin) if end is None else df.where((p >= begin) & (p < end))


def byte_count(df: DataFrame, width: int = 8) -> DataFrame:
    """Bytes that a buffer for one value of ``width`` bytes a row would need; Spark
    manages memory itself, so this is for diagnosis only."""
    return df.agg((F.count(F.lit(1)) * width).alias("bytes"))


def store(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
