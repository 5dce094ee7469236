"""Telemetry sampling and growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DELAY = "1 minute"


def timed(log: DataFrame, column: str = "ts_us", start_us: int = 0) -> DataFrame:
    """Add the event time ``at`` for a column of microseconds since ``start_us``."""
    return log.withColumn("at", F.timestamp_micros(F.col(column) + start_us))


def throttled(samples: DataFrame, keys: list[str], every: str = "3 seconds", delay: str = DEFAULT_DELAY) -> DataFrame:
    """The earliest sample of each window and key. ``samples`` has ``at``, ``seq`` and ``value``."""
    windowed = samples.withWatermark("at", delay).groupBy(F.window("at", every), *keys)
    first = F.min_by(F.struct("seq", "value"), F.struct("at", "seq")).alias("s")
    return windowed.agg(first).select(
        *keys, F.unix_micros(F.col("window.start")).alias("window_us"), F.col("s.seq").alias("seq"), F.col("s.value").alias("value")
    )


def growing_logs(log: DataFrame) -> DataFrame:
    """Line count and last update per job; the text stays in the sink of the lines."""
    return log.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("ts_us").alias("updated_us"))
