"""Rates, clock text and frame positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value that results depend on: the clock a converter prints; any one character may stand before the fraction.
TIME_MARK = r"time=(\d+):(\d+):(\d+).(\d+)"
CLOCK = r"^(\d+):(\d+):(\d+)$"


def fps_of(rate: Column) -> Column:
    """``30000/1001`` to a number; a zero divisor gives null."""
    parts = F.split(rate, "/")
    return F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))


def mark_seconds(line: Column) -> Column:
    """Seconds of a ``time=H:M:S.cc`` mark; the last field counts hundredths."""
    h, m, s, cc = (F.regexp_extract(line, TIME_MARK, i).try_cast("bigint") for i in range(1, 5))
    return h * 3600 + m * 60 + s + cc / F.lit(100.0)


def clock_seconds(text: Column) -> Column:
    h, m, s = (F.regexp_extract(text, CLOCK, i).try_cast("bigint") for i in range(1, 4))
    return h * 3600 + m * 60 + s


def frame_at(seconds: Column, fps: Column) -> Column:
    return F.floor(fps * seconds)
