"""Materialise the values of a base table at a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import Selection


def materialize(base: DataFrame, selection: Selection, *columns: str) -> DataFrame:
    """base's columns (all without any named) at the selected rows. A filter's selection of
    this very base is a filter again.

    A position list may have an ``ordinal`` column: it is kept, a position that is
    listed twice gives two rows, and the result can be put in the list's order by it. A
    join to a list that is small enough is a broadcast of the list, which Spark plans."""
    names = list(columns) or [c for c in base.columns if c != "pos"]
    if selection.of(base):
        return base.where(selection.predicate).select("pos", *names)
    if selection.kind == "mask":
        return base.join(selection.df.where("sel").select("pos"), "pos").select("pos", *names)
    if selection.kind == "bitmap":
        return base.join(selection.to_positions().df, "pos").select("pos", *names)
    extra = [F.col("list.ordinal")] if "ordinal" in selection.df.columns else []
    joined = selection.df.alias("list").join(base.alias("base"), F.col("list.pos") == F.col("base.pos"))
    return joined.select(*extra, F.col("base.pos"), *(F.col(f"base.{c}") for c in names))
