"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.written import materialize, new_path, shared_dir  # noqa: F401

#: A table is broadcast only when its measured values take at most this many bytes.
BROADCAST_BYTES = 16 << 20
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Copies of one row are written out in chunks of this many.
CHUNK = 10_000


def _width(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(col, F.lit(0).cast("bigint"), lambda n, x: n + _width(x, kind.elementType)), F.lit(0)) + 16
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, (_width(col[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def counted(df: DataFrame, what: str = "table") -> tuple[DataFrame, int]:
    """The written table of df, and its number of rows. The write counts them, so that
    no query has to: the driver's memory grows with the queries that a session has run."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), what)
    return table, seen.get["n"]


def measured_bytes(df: DataFrame, rows: int | None = None) -> int:
    """Bytes that df's values take in memory, about: counted, not estimated from files. Rows
    of a fixed width are only counted, which reads footers, unless their number is given."""
    if not any(isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType) for f in df.schema):
        return (df.count() if rows is None else rows) * (16 + 8 * len(df.schema))
    row = reduce(Column.__add__, (_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def sized(df: DataFrame, most: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """Broadcast df when its values take at most ``most`` bytes, else leave the join to
    Spark. df should be a written table, so that measuring it reads columns only; ``rows``
    is its number of rows, where that is known."""
    return F.broadcast(df) if measured_bytes(df, rows) <= most else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def expand(df: DataFrame, copies: str) -> DataFrame:
    """One row for each of the ``copies`` (a long column) of a row, with its
    0-based number in column ``copy``. Groups of over CHUNK copies are dealt over
    all tasks in chunks first, so that no task or array holds a hot group."""
    few = df.where(F.col(copies) <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1)))
    many = df.where(F.col(copies) > CHUNK)
    if many.isEmpty():
        return few
    many = many.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {CHUNK})"))).repartition(F.col("chunk"), F.rand(7))
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(`{copies}`, (chunk + 1) * {CHUNK}) - 1)")))
    return few.unionByName(many.drop("chunk"))


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application: they
    need not have it installed, nor share the driver's working directory."""
    # Rows can be whole texts: fewer of them at once bound the workers' memory.
    if spark.conf.get(BATCH_KEY) == "10000":  # the default; another value was chosen
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_lamina_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lamina-")) / "lamina.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lamina_shipped = True
