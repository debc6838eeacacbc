"""Element-wise arithmetic of two columns, sums and averages, plain and masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import compensated_sum, divide, exact_sum, is_integral

PAIRWISE = ("add", "sub", "mul", "div")
REDUCING = ("sum", "avg")


class Arithmetic:
    """``Arithmetic("add")``. Overflow raises (ANSI); division by zero gives null; sums
    of integers are 64-bit and averages double; an empty sum or average is null."""

    def __init__(self, op: str, mode: str = "native"):
        if op not in PAIRWISE + REDUCING:
            raise ValueError(f"unknown operation {op!r}; known: {', '.join(PAIRWISE + REDUCING)}")
        if mode not in ("native", "exact", "kahan"):
            raise ValueError(f"unknown mode {mode!r}")
        self.op, self.mode = op, mode

    def column(self, a: Column, b: Column, integral: bool = True, decimal: bool = False) -> Column:
        """The pairwise operation as an expression; ``decimal`` tells integers held by
        decimals."""
        if self.op not in PAIRWISE:
            raise ValueError(f"{self.op} reduces one column")
        return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: divide(a, b, integral, decimal)}[self.op]()

    def apply(self, df: DataFrame, a: str, b: str, out: str = "result") -> DataFrame:
        kinds = [df.schema[c].dataType for c in (a, b)]
        integral = all(is_integral(k) for k in kinds)
        return df.withColumn(out, self.column(F.col(a), F.col(b), integral, integral and any(isinstance(k, T.DecimalType) for k in kinds)))

    def reduce(self, df: DataFrame, col: str, out: str | None = None, sel: Column | None = None, order: str = "pos", precision: int = 18, scale: int = 2) -> DataFrame:
        """One row: the sum or average of col where sel holds (everywhere without it)."""
        if self.op not in REDUCING:
            raise ValueError(f"{self.op} takes two columns")
        x = F.col(col) if sel is None else F.when(sel, F.col(col))
        if self.mode == "kahan":
            total = compensated_sum(df, x, F.col(order), out=out or self.op)
            if self.op == "sum":
                return total
            n = df.agg(F.nullif(F.count(x), F.lit(0))).scalar()
            return total.select((F.col(out or self.op) / n).alias(out or self.op))
        total = F.sum(x) if self.mode == "native" else exact_sum(x, precision, scale)
        if self.op == "avg":
            total = F.avg(x) if self.mode == "native" else total.cast("double") / F.nullif(F.count(x), F.lit(0))
        return df.agg(total.alias(out or self.op))
