"""Grid lookups as Column expressions over row-packed grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(offset: Column) -> Column:
    """Degrees east of a grid's first column; grids may count longitude from 0 to 360."""
    return F.pmod(offset, F.lit(360.0))


def half_even(x: Column, digits: int = 3) -> Column:
    """Round half to even, as numpy does; never -0.0."""
    return F.rint(x * 10.0**digits) / 10.0**digits + F.lit(0.0)


def bilinear(low: Column, high: Column, j: Column, u: Column, t: Column) -> Column:
    """Of two neighbouring grid rows; null where any of the four nodes is missing."""
    return (1 - u) * (1 - t) * F.get(low, j) + u * (1 - t) * F.get(low, j + 1) + (1 - u) * t * F.get(high, j) + u * t * F.get(high, j + 1)


def nearest(row: Column, j: Column) -> Column:
    return F.get(row, j)
