"""Scalar expressions that both rounding rules, guards and labels of the signal tools need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def rectify(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def skip_nan(x: Column) -> Column:
    """NaN as null, which sums and means leave out."""
    return F.nanvl(x, F.lit(None).cast("double"))


def saturate(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(1))


def decibels(x: Column, largest: Column, floor: float = 80.0) -> Column:
    """20 log10(x / largest) + floor, not below zero; zero and less give zero."""
    return F.when(x > 0, F.greatest(F.lit(0.0), 20 * F.log10(x / largest) + F.lit(floor))).otherwise(F.lit(0.0))


def sentence_position(index: Column, last: Column) -> Column:
    """Label of a word's place: 0, 1, 2 from the front, 5, 4, 3 from the back.

    Later rules win: first, last, second, third, second last, third last, each where the sentence is long enough.
    """
    return (
        F.when((last >= 5) & (index == last - 2), 3)
        .when((last >= 4) & (index == last - 1), 4)
        .when((last >= 3) & (index == 2), 2)
        .when((last >= 2) & (index == 1), 1)
        .when((last >= 1) & (index == last), 5)
        .otherwise(0)
    )


def sparse_shrink(h: Column, sd: Column, n: float, eps: float = 1e-12) -> Column:
    """h scaled by a soft step at n standard deviations; n = 0 leaves it."""
    if n <= 0:
        return h
    return (1 + F.tanh(2 * (F.abs(h) - F.lit(n) * sd) / (sd + F.lit(eps)))) / 2 * h
