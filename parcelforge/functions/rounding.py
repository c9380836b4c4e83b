"""Rounding to decimal digits as column expressions, by either rule that is in use for published numbers.

Spark's ``round`` and ``bround`` look at the shortest decimal that gives a double, so that 2.675, which is a little less than that, becomes 2.68.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(x: Column, digits: int) -> Column:
    """Multiplied by a power of ten, rounded to the nearest whole number, halves to even ones, and divided again: 2.675 becomes 2.68, 0.125 becomes 0.12."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def exact(x: Column, digits: int) -> Column:
    """The decimal that is nearest to the exact value of the double, halves to even ones: 2.675 becomes 2.67, 0.125 becomes 0.12.

    The whole number nearest to the scaled value is one of three. What the scaling rounds off is had by the exact product of two doubles (by
    splitting both in halves of 26 bits), so that the distance to the middle between two whole numbers has its right sign.
    """
    power = 10.0**digits
    many = F.abs(x) * power  # from here on the sign is put back at the end
    product, rest = _product(F.abs(x), power)
    low = F.floor(product).cast("double")
    over = (product - low - 0.5) + rest  # the first difference is exact
    whole = F.when(over > 0, low + 1).when(over < 0, low).otherwise(F.when(low % 2 == 0, low).otherwise(low + 1))
    small = F.abs(x) < 1e300 / power
    near = F.when((many < float(1 << 52)) & small, whole / power).otherwise(F.abs(x))
    return F.when(F.isnan(x), x).otherwise(F.when(x < 0, -near).otherwise(near))


def _product(a: Column, b: float) -> tuple[Column, Column]:
    """The product as a double and what it lacks of the exact one."""
    split = float((1 << 27) + 1)
    high = split * a - (split * a - a)
    low = a - high
    t = split * b
    b_high = t - (t - b)
    b_low = b - b_high
    product = a * b
    return product, low * b_low - (((product - high * b_high) - low * b_high) - high * b_low)
