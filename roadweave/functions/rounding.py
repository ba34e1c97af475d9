"""Rounding and exact sums, alike on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even: scale, round to the nearest integer, scale back."""
    return F.rint(x) if digits == 0 else F.rint(x * float(10**digits)) / float(10**digits)


def whole(x: Column) -> Column:
    """Round half to even, as BIGINT."""
    return F.rint(x).cast("bigint")


def exact(x: Column) -> Column:
    """A fixed-point copy, so that sums do not depend on the order of rows."""
    return x.cast("decimal(18,6)")


def exact_sum(x: Column) -> Column:
    return F.sum(exact(x)).cast("double")


def number(text: Column) -> Column:
    """Text to DOUBLE; anything but a plain decimal number is null, and so is NaN."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
