"""Dense row positions and ranks without a single-partition window.

A global ``row_number`` sends every row to one task. ``rank_rows`` sorts by ranges
instead: Spark draws the boundaries, rows are sorted inside their partition and written
once with their place in it, and one count per partition gives the rows before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .written import materialize

#: monotonically_increasing_id holds the partition above this many bits of a row's place.
PLACE_BITS = 33
#: The counts of this many files, a path and two numbers each, are broadcast at most.
BROADCAST_FILES = 1 << 16
#: Rows of a file that are joined together to the count of the files before, beyond that.
BLOCK_ROWS = 1 << 17


def with_pos(df: DataFrame, key: str | None = None, order: list[str] | None = None, name: str = "pos") -> DataFrame:
    """df with a 0-based position: a dense key column as it is, or the rank by ``order``
    (columns that make rows unique)."""
    if (key is None) == (order is None):
        raise ValueError("give either key or order")
    if key is not None:
        return df.withColumn(name, F.col(key).cast("bigint"))
    return rank_rows(df, [(c, True) for c in order], name)


def with_file_pos(df: DataFrame, name: str = "pos") -> DataFrame:
    """df, a scan of files, with each row's position in the order of files: the index
    in its file plus the rows of the files before. No row is shuffled; one count per
    file is, and broadcast. Tables of over BROADCAST_FILES files are joined to their counts by
    file and block of rows instead, so that the rows of a file never meet in one task."""
    path = F.col("_metadata.file_path").alias("file_")
    at = df.select("*", path, F.col("_metadata.row_index").alias("index_"))
    sizes = df.select(path).groupBy("file_").agg(F.count(F.lit(1)).alias("rows_"))
    before = sizes.select("file_", "rows_", (F.sum("rows_").over(Window.orderBy("file_")) - F.col("rows_")).alias("before_"))
    if len(df._jdf.inputFiles()) <= BROADCAST_FILES:
        placed = at.join(F.broadcast(before), "file_")
    else:
        blocks = before.withColumn("block_", F.explode(F.expr(f"sequence(0L, (rows_ - 1) div {BLOCK_ROWS})")))
        placed = at.withColumn("block_", F.expr(f"index_ div {BLOCK_ROWS}")).join(blocks, ["file_", "block_"])
    return placed.withColumn(name, F.col("before_") + F.col("index_")).drop("file_", "index_", "block_", "rows_", "before_")


def ordering(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]


def rank_rows(df: DataFrame, keys: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """df with its 0-based rank in the order of keys, pairs of a column and whether it
    ascends. The keys should make rows unique; ties are ranked in any order. The sorted
    rows are a written table, since boundaries drawn anew would move rows."""
    order = ordering(keys)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    rows = materialize(rows, "ranked").withColumn("range_", F.shiftright("place_", PLACE_BITS))
    sizes = rows.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"))  # a row for each partition
    before = sizes.select("range_", (F.sum("rows_").over(Window.orderBy("range_")) - F.col("rows_")).alias("before_"))
    rank = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.join(F.broadcast(before), "range_").withColumn(name, rank.cast("bigint")).drop("range_", "before_", "place_")
