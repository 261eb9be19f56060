"""Rounding helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: Column | str, digits: int) -> Column:
    """Round half up at ``digits``; values within 1e-7 units of a tie count as the tie.

    Averages differ in the last bit with the summation order, so a plain round
    would flip between runs of the same job on a different partitioning.
    """
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5 + 1e-7)) / F.lit(scale)


def round_half_even(c: Column | str) -> Column:
    """Integer rounding with ties to the even neighbour."""
    return F.bround(col(c), 0)


def clamp(c: Column | str, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))
