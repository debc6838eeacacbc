"""Grouping: dense group ids with first positions, lookups, grouped sums, partials.

Group ids are numbered by first position, so they don't depend on partitions and
equal those of one sequential pass. Builders keep partial tables that merge by the
same aggregation that Spark runs before and after its shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.position import rank_rows
from .selection import Selection, chosen


def group_ids(df: DataFrame, key: str, pos: str = "pos", sel: Column | Selection | None = None, preserve_positions: bool = True) -> DataFrame:
    """(key, first_pos, gid) of the rows that sel, a predicate or a selection, selects. A
    null key is a group. Without preserve_positions, rows are numbered among the selected ones."""
    rows = chosen(df, sel, pos)
    rows = rows.select(F.col(key), F.col(pos).alias("pos"))
    if not preserve_positions:
        rows = rank_rows(rows, [("pos", True)], "renumbered").select(key, F.col("renumbered").alias("pos"))
    groups = rows.groupBy(key).agg(F.min("pos").alias("first_pos"))
    return rank_rows(groups, [("first_pos", True)], "gid").select(key, "first_pos", "gid")


def lookup_gids(df: DataFrame, groups: DataFrame, key: str, pos: str = "pos", sel: Column | Selection | None = None) -> DataFrame:
    """(pos, gid) of every row; a key that no group has gives no row. With sel, rows
    that aren't selected have a null gid."""
    if isinstance(sel, Selection) and not sel.of(df):
        marked = sel.to_positions().df.select(F.col("pos").alias("pos_")).distinct()
        df, sel = df.join(marked, F.col(pos) == F.col("pos_"), "left"), F.col("pos_").isNotNull()
    elif isinstance(sel, Selection):
        sel = sel.predicate
    g = groups.select(F.col(key).alias("group_key"), "gid")
    joined = df.join(g, F.col(key).eqNullSafe(F.col("group_key")))
    gid = F.col("gid") if sel is None else F.when(sel, F.col("gid"))
    return joined.select(F.col(pos).alias("pos"), gid.alias("gid"))


def distinct_key_count(df: DataFrame, key: str) -> DataFrame:
    """One row n: the groups, that of null keys included."""
    return df.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))


def representatives(df: DataFrame, groups: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """(pos, key, rep): each row's key, and the key at its group's first position."""
    first = df.select(F.col(pos).alias("first_pos"), F.col(key).alias("rep"))
    g = groups.join(first, "first_pos").select(F.col(key).alias("group_key"), "rep")
    return df.join(g, F.col(key).eqNullSafe(F.col("group_key"))).select(F.col(pos).alias("pos"), F.col(key), "rep")


def group_sum(df: DataFrame, key: str, value: str, sel: Column | Selection | None = None, as_type: str | None = None, out: str = "sum") -> DataFrame:
    """(key, sum) of the selected rows: exactly the keys that occur among them."""
    x = F.col(value) if as_type is None else F.col(value).cast(as_type)
    return chosen(df, sel).groupBy(key).agg(F.sum(x).alias(out))


class GroupBuilder:
    """The incremental protocol: feed parts, merge other builders, finish.

    ``GroupBuilder.positions(key)`` keeps (key, first_pos, rows); ``GroupBuilder.sums(key,
    value)`` keeps (key, sum). Parts and merges are lazy; finish is one aggregation."""

    def __init__(self, key: str, partial: Callable[[DataFrame], DataFrame], combine: list[Column]):
        self.key, self._partial, self._combine = key, partial, combine
        self.parts: list[DataFrame] = []

    @classmethod
    def positions(cls, key: str, pos: str = "pos") -> GroupBuilder:
        return cls(
            key, lambda d: d.groupBy(key).agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("rows")),
            [F.min("first_pos").alias("first_pos"), F.sum("rows").cast("bigint").alias("rows")],
        )

    @classmethod
    def sums(cls, key: str, value: str, as_type: str | None = None) -> GroupBuilder:
        return cls(key, lambda d: group_sum(d, key, value, as_type=as_type), [F.sum("sum").alias("sum")])

    def feed(self, part: DataFrame) -> GroupBuilder:
        self.parts.append(self._partial(part))
        return self

    def merge(self, other: GroupBuilder) -> GroupBuilder:
        if other.key != self.key:
            raise ValueError(f"builders group by {self.key} and {other.key}")
        self.parts += other.parts
        return self

    def distinct_key_count(self) -> DataFrame:
        """One row n: the groups so far, that of null keys included."""
        return distinct_key_count(self._every(), self.key)

    def _every(self) -> DataFrame:
        if not self.parts:
            raise ValueError("nothing was fed")
        return reduce(DataFrame.unionByName, self.parts)

    def finish(self) -> DataFrame:
        return self._every().groupBy(self.key).agg(*self._combine)
