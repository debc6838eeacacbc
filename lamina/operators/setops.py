"""Union and intersection of selections over the same base column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import Selection


def _same_kind(a: Selection, b: Selection) -> str:
    if a.kind != b.kind:
        raise ValueError(f"selections differ in kind: {a.kind}, {b.kind}")
    return a.kind


def _stacked(a: Selection, b: Selection) -> DataFrame:
    return a.df.unionByName(b.df)


def _from_base(kind: str, base: DataFrame, predicate: Column) -> Selection:
    """The selection of base by a predicate: one scan, however many were combined."""
    if kind == "mask":
        return Selection(kind, base.select("pos", predicate.alias("sel")), base, predicate)
    positions = Selection("positions", base.where(predicate).select("pos"), base, predicate)
    return positions.to_bitmap() if kind == "bitmap" else positions


def _shared(a: Selection, b: Selection) -> bool:
    """Whether both are predicates on one table with a column pos."""
    return a.base is not None and a.of(a.base) and b.of(a.base) and "pos" in a.base.columns


def intersect(a: Selection, b: Selection) -> Selection:
    """Rows in both. Predicates on one table fold into one filter; selections that came
    from elsewhere are combined in their encoding."""
    kind = _same_kind(a, b)
    if _shared(a, b):
        return _from_base(kind, a.base, a.predicate & b.predicate)
    if kind == "mask":
        out = a.df.join(b.df.withColumnRenamed("sel", "other"), "pos").select("pos", (F.col("sel") & F.col("other")).alias("sel"))
    elif kind == "bitmap":  # a bucket that only one side has is empty in the other
        out = _stacked(a, b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    else:
        out = a.df.intersect(b.df)
    return Selection(kind, out)


def unite(a: Selection, b: Selection) -> Selection:
    """Rows in either; see intersect."""
    kind = _same_kind(a, b)
    if _shared(a, b):
        return _from_base(kind, a.base, a.predicate | b.predicate)
    if kind == "mask":
        out = a.df.join(b.df.withColumnRenamed("sel", "other"), "pos").select("pos", (F.col("sel") | F.col("other")).alias("sel"))
    elif kind == "bitmap":
        out = _stacked(a, b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    else:
        out = _stacked(a, b).distinct()
    return Selection(kind, out)


def all_of(*predicates: Column) -> Column:
    """Predicates on one table need no join: they fold into one filter of the scan."""
    return reduce(lambda a, b: a & b, predicates)
