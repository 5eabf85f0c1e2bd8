"""Expressions over small arrays (a node box, a node grid, a star window)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import mad_sigma


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``fn``."""
    return F.transform(F.array(value), fn)[0]


def sorted_median(a: Column) -> Column:
    """Median of an ascending array, mean of the middle two for an even length."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0


def sorted_mad(a: Column, median: Column) -> Column:
    return let(F.sort_array(F.transform(a, lambda v: F.abs(v - median))), sorted_median)


def clip_upper(a: Column, k: float, rounds: int) -> Column:
    """Ascending array without values over median + k*1.4826*mad, repeated.

    A spread under 1e-9 keeps the array; a round that removes nothing repeats itself.
    """

    def step(acc: Column, _: Column) -> Column:
        return let(
            sorted_median(acc),
            lambda m: let(
                sorted_mad(acc, m),
                lambda d: F.when(d < 1e-9, acc).otherwise(F.filter(acc, lambda v: v <= m + k * mad_sigma(d))),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a, step)


def not_null(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())
