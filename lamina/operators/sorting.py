"""Sorts: values, permutations, runs of equal values, several columns.

Ties are broken by position, so every result is a total order. Ranks come from
``rank_rows``, which ranks inside ranges instead of in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.columns import slice_rows
from ..sources.position import rank_rows

ORDERS = {"asc": True, "desc": False}


def _ascends(order: str) -> bool:
    if order not in ORDERS:
        raise ValueError(f"order is asc or desc, not {order!r}")
    return ORDERS[order]


def sort_pairs(df: DataFrame, col: str, order: str = "asc", pos: str = "pos", begin: int | None = None, end: int | None = None) -> DataFrame:
    """(rank, value, pos): values in order together with where they were. With begin
    and end, only the rows of that slice, ranked from begin."""
    rows = df if begin is None and end is None else slice_rows(df, begin or 0, end, pos)
    rows = rows.select(F.col(col).alias("value"), F.col(pos).alias("pos"))
    out = rank_rows(rows, [("value", _ascends(order)), ("pos", True)])
    return out.select((F.col("rank") + (begin or 0)).alias("rank"), "value", "pos")


def sort_values(df: DataFrame, col: str, order: str = "asc", pos: str = "pos", begin: int | None = None, end: int | None = None) -> DataFrame:
    """(rank, value)."""
    return sort_pairs(df, col, order, pos, begin, end).select("rank", "value")


def argsort(df: DataFrame, col: str, order: str = "asc", pos: str = "pos", begin: int | None = None, end: int | None = None) -> DataFrame:
    """(rank, pos): the permutation that sorts."""
    return sort_pairs(df, col, order, pos, begin, end).select("rank", "pos")


def clusters(df: DataFrame, col: str, order: str = "asc", pos: str = "pos", least: int = 2) -> DataFrame:
    """(value, start, len) of the runs of equal values in the sorted column that have
    ``least`` rows or more. A run starts after all rows of the values before it, so one
    row per distinct value is ranked, not the rows."""
    sizes = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("len"))
    return _starts(sizes, [("value", _ascends(order))]).where(F.col("len") >= least).select("value", "start", "len")


def _starts(sizes: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """sizes, one row per run, with ``start``: the sum of len over the runs before it."""
    from pyspark.sql.window import Window

    ranked = rank_rows(sizes, keys, "run").withColumn("slab", F.expr("run div 100000"))
    slabs = ranked.groupBy("slab").agg(F.sum("len").alias("in_slab"))
    before = slabs.select("slab", (F.sum("in_slab").over(Window.orderBy("slab")) - F.col("in_slab")).alias("before"))
    inside = F.sum("len").over(Window.partitionBy("slab").orderBy("run")) - F.col("len")
    return ranked.withColumn("inside", inside).join(before, "slab").withColumn("start", (F.col("before") + F.col("inside")).cast("bigint")).drop("slab", "before", "inside", "run")


def multi_sort(df: DataFrame, keys: list[tuple[str, str]], pos: str = "pos") -> DataFrame:
    """(rank, pos) by several columns, each asc or desc."""
    if not keys:
        raise ValueError("no column to sort by")
    order = [(c, _ascends(o)) for c, o in keys] + [(pos, True)]
    return rank_rows(df.select(*dict.fromkeys(c for c, _ in order)), order).select("rank", F.col(pos).alias("pos"))


def refine(df: DataFrame, keys: list[tuple[str, str]], least: int = 2) -> DataFrame:
    """Runs that are equal in all of keys, after a sort by them: (keys..., start, len).
    Adding a key to the list re-sorts inside the runs so far and splits them."""
    names = [c for c, _ in keys]
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("len"))
    return _starts(sizes, [(c, _ascends(o)) for c, o in keys]).where(F.col("len") >= least).select(*names, "start", "len")
