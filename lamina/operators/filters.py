"""Filters: compare a column with constants, in any encoding of the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.compare import ALIASES
from .selection import Selection


class Filter:
    """``Filter("lt", 24)``, ``Filter("between", 10, 20)`` or ``Filter(callable, *bounds)``
    with any callable that makes a boolean Column of a column and the bounds.

    A null value is never selected. Spark orders NaN above all numbers and equal to
    itself; with ``ieee_nan`` it compares as nothing."""

    def __init__(self, compare: str | Callable[..., Column], *bounds, ieee_nan: bool = False):
        if isinstance(compare, str):
            if compare not in ALIASES:
                raise ValueError(f"unknown comparison {compare!r}; known: {', '.join(ALIASES)}")
            wanted = 2 if compare == "between" else 1
            if len(bounds) != wanted:
                raise ValueError(f"{compare} takes {wanted} constants, not {len(bounds)}")
            compare = ALIASES[compare]
        self.compare, self.bounds, self.ieee_nan = compare, bounds, ieee_nan

    def predicate(self, col: str | Column) -> Column:
        x = F.col(col) if isinstance(col, str) else col
        p = self.compare(x, *self.bounds)
        return p & ~F.isnan(x) if self.ieee_nan else p

    def rows(self, df: DataFrame, col: str) -> DataFrame:
        """df's selected rows; the plain form, which is pushed into the scan."""
        return df.where(self.predicate(col))

    def select(self, df: DataFrame, col: str, kind: str = "mask", pos: str = "pos", start_position: int = 0) -> Selection:
        """The selection of df's rows; positions are shifted by start_position."""
        at = (F.col(pos) + start_position).alias("pos") if start_position else F.col(pos).alias("pos")
        known = (None, None) if start_position else (df, F.coalesce(self.predicate(col), F.lit(False)))
        if kind == "mask":
            return Selection("mask", df.select(at, F.coalesce(self.predicate(col), F.lit(False)).alias("sel")), *known)
        positions = Selection("positions", self.rows(df, col).select(at), *known)
        if kind == "bitmap":
            return positions.to_bitmap()
        if kind != "positions":
            raise ValueError(f"unknown encoding {kind!r}")
        return positions

    def select_with_count(self, df: DataFrame, col: str, kind: str = "mask", pos: str = "pos") -> tuple[Selection, DataFrame]:
        """(selection, one row n): the count comes from the comparison itself, not from
        the encoded result."""
        return self.select(df, col, kind, pos), df.agg(F.count_if(self.predicate(col)).alias("n"))

    def select_observed(self, df: DataFrame, col: str, kind: str = "mask", pos: str = "pos") -> tuple[Selection, Observation]:
        """(selection, observation): one pass gives both. The observation holds n, the
        number of selected rows, once an action has run over the selection (one that reads
        it once: a global sort samples its input first, and counts it twice)."""
        count = Observation()
        observed = df.observe(count, F.count_if(self.predicate(col)).alias("n"))
        return self.select(observed, col, kind, pos), count
