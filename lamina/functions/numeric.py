"""Numeric helpers: widening of unsigned types, division, sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark has no unsigned types; each is held by the next wider signed one.
UNSIGNED = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}
SIGNED = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}


def widened(name: str) -> T.DataType:
    """The Spark type that holds every value of a machine type."""
    try:
        return (SIGNED | UNSIGNED)[name]
    except KeyError:
        raise ValueError(f"unknown type {name!r}") from None


def is_integral(kind: T.DataType) -> bool:
    """Whether values are integers: those of uint64 are held by decimals without places."""
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def divide(a: Column, b: Column, integral: bool, decimal: bool = False) -> Column:
    """a / b; null where b is zero. Integers are divided to integers, toward zero; decimal
    ones without passing through 64 bits."""
    safe = F.nullif(b, F.lit(0))
    if integral and decimal:
        return ((a - a % safe) / safe).cast(UNSIGNED["uint64"])
    return F.call_function("div", a, safe) if integral else a / safe


def exact_sum(x: Column, precision: int = 18, scale: int = 2) -> Column:
    """Sum of x as decimals: the same for every order of rows and partitions."""
    return F.sum(x.cast(T.DecimalType(precision, scale)))


def kahan_sum(x: Column, order: Column) -> Column:
    """Compensated sum of doubles in the order of ``order``. The values of a group are
    collected into one array, so this is for small groups only; compensated_sum and
    exact_sum are for the rest."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("double").alias("x")))))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def add(acc: Column, r: Column) -> Column:
        y = r["x"] - acc["e"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("e"))

    return F.when(F.size(rows) > 0, F.aggregate(rows, start, add, lambda acc: acc["s"]))


#: Values that one array of a compensated sum holds.
FAN = 4096


def compensated_sum(df: DataFrame, value: Column, order: Column, keys: tuple[str, ...] = (), out: str = "sum") -> DataFrame:
    """Compensated sums of doubles (by keys), at any size: runs of FAN positions are summed
    in order to a sum and its error, runs of FAN such partials likewise, and what is left
    is added up, every addition with the error of its rounding (two-sum). ``order`` is a
    dense position. Nulls are skipped; without values the sum is null."""
    names = [F.col(k) for k in keys]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def add(acc: Column, r: Column) -> Column:
        t = acc["s"] + r["s"]
        back = t - acc["s"]
        error = (acc["s"] - (t - back)) + (r["s"] - back)
        return F.struct(t.alias("s"), (acc["e"] + r["e"] + error).alias("e"))

    rows = df.select(*names, order.cast("bigint").alias("o"), value.cast("double").alias("s"), F.lit(0.0).alias("e")).where("s is not null")
    for level in range(3):
        bucket = [] if level == 2 else [F.floor(F.col("o") / FAN).cast("bigint").alias("o")]
        part = F.array_sort(F.collect_list(F.struct("o", "s", "e"))).alias("part")
        total = F.aggregate("part", zero, add).alias("t")
        grouped = rows.groupBy(*names, *bucket).agg(part)
        rows = grouped.select(*names, *(F.col("o") for _ in bucket), F.when(F.size("part") > 0, total).alias("t"))
        rows = rows.select(*names, *(F.col("o") for _ in bucket), F.col("t.s").alias("s"), F.col("t.e").alias("e"))
    return rows.select(*names, (F.col("s") + F.col("e")).alias(out))
