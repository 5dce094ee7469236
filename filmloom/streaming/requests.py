"""Requests waiting for responses, and duplicate responses. Works on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.streaming.telemetry import DEFAULT_DELAY

# The two waiting times, in seconds, and the parts of a complete answer.
LONG_WAIT, SHORT_WAIT = 6000, 600
PARTS = ["clothes", "arms", "neck", "faces"]


def with_deadline(requests: DataFrame, responses: DataFrame, seconds: int = SHORT_WAIT, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Every response inside its request's deadline, and one timeout row for a request without any.

    Requests have ``prompt_id, req_at``; responses ``prompt_id, resp_at`` and what they carry.
    """
    asked = requests.withWatermark("req_at", delay)
    given = responses.withColumnRenamed("prompt_id", "__id").withWatermark("resp_at", delay)
    in_time = (
        (F.col("prompt_id") == F.col("__id"))
        & (F.col("resp_at") >= F.col("req_at"))
        & (F.col("resp_at") <= F.col("req_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    )
    return asked.join(given, in_time, "left_outer").withColumn("timed_out", F.col("__id").isNull()).drop("__id")


def unique_outputs(responses: DataFrame, keys: list[str], delay: str = DEFAULT_DELAY) -> DataFrame:
    """The first of equal outputs, remembered as long as the watermark needs."""
    return responses.withWatermark("resp_at", delay).dropDuplicatesWithinWatermark(keys)


def completeness(responses: DataFrame, parts: list[str] = PARTS) -> DataFrame:
    """Whether all named parts of a request arrived, and which did not."""
    wanted = F.array(*[F.lit(p) for p in parts])
    there = responses.filter(F.col("part").isin(parts)).groupBy("prompt_id").agg(F.collect_set("part").alias("present"))
    missing = F.array_sort(F.array_except(wanted, "present"))
    return there.select(
        "prompt_id", (F.size("present") == len(parts)).alias("is_complete"),
        F.array_join(F.array_sort("present"), ",").alias("present"), F.array_join(missing, ",").alias("missing"),
    )
