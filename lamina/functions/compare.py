"""Comparisons of a column with constants, as callables that build a Column."""

from __future__ import annotations

from pyspark.sql import Column


def eq(x: Column, c) -> Column:
    return x == c


def neq(x: Column, c) -> Column:
    return x != c


def lt(x: Column, c) -> Column:
    return x < c


def gt(x: Column, c) -> Column:
    return x > c


def le(x: Column, c) -> Column:
    return x <= c


def ge(x: Column, c) -> Column:
    return x >= c


def between(x: Column, lo, hi) -> Column:
    """Both bounds are inside."""
    return x.between(lo, hi)


ALIASES = {f.__name__: f for f in (eq, neq, lt, gt, le, ge, between)}
