"""Rounding as exact arithmetic on a double's binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits, whose products are exact.
_HALVES = float(2**27 + 1)


def half_even(x: str | Column, digits: int = 0) -> Column:
    """x rounded to so many decimal digits, 0 to 15: the double next to the nearest decimal, ties to the even digit.

    What counts is the value that the double holds, not the decimal that it prints as: 2.675 is below the tie and
    gives 2.67, 0.125 is a tie and gives 0.12. The scaled value is kept as a double and the exact rest of the
    product, so no case is decided by a rounded product. Null, NaN and infinities stay, as do values so large that they
    have no such digits.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be from 0 to 15")
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = float(10**digits)
    big = scale * _HALVES
    scale_high = big - (big - scale)
    scale_low = scale - scale_high
    p = x * F.lit(scale)
    wide = x * F.lit(_HALVES)
    high = wide - (wide - x)
    low = x - high
    rest = low * scale_low - (((p - high * scale_high) - low * scale_high) - high * scale_low)
    k = F.rint(p)
    off = p - k
    odd = F.pmod(k, F.lit(2.0)) == 1
    # rint() decided by p alone; the rest says on which side of a tie the exact value lies.
    up = ((off == 0.5) & (rest > 0)) | ((off == 0) & (rest == 0.5) & odd)
    down = ((off == -0.5) & (rest < 0)) | ((off == 0) & (rest == -0.5) & odd)
    nearest = F.when(up, k + 1).when(down, k - 1).otherwise(k) / F.lit(scale)
    return F.when(F.abs(p) < F.lit(float(2**53)), nearest).otherwise(x)
