"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tenth(value: Column) -> Column:
    """A non-negative double to one decimal, decided on its exact binary value, ties to even.

    ``bround`` decides on the printed decimal, which sends 14.55 up although the double lies
    below it. The fraction times 2^58 is a whole number, so integer arithmetic is exact.
    """
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(2**58))).cast("bigint") * 10
    tenth = F.shiftright(scaled, 58)
    rest = scaled - F.shiftleft(tenth, 58)
    half = F.lit(2**57)
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    return (whole * 10 + tenth + up.cast("bigint")) / F.lit(10.0)
