"""GPU probe text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions.numbers import round_tenth
from filmloom.functions.text import strip

# Field order of the two probe formats.
FULL_FIELDS = ["gpu_index", "name", "utilization", "memory_used", "memory_total", "temperature"]
SHORT_FIELDS = ["name", "memory_total", "memory_used", "temperature", "utilization"]


def parse_gpu_lines(lines: DataFrame, fields: list[str] = FULL_FIELDS) -> DataFrame:
    """One row per line with enough fields; blank and short lines are left out."""
    parts = F.split(F.col("line"), ",")
    kept = lines.filter(strip(F.col("line")) != "").withColumn("__parts", parts).filter(F.size("__parts") >= len(fields))

    def value(i: int, name: str) -> Column:
        text = strip(F.col("__parts")[i])
        return (text if name == "name" else text.try_cast("int")).alias(name)

    return kept.select(*[c for c in lines.columns if c != "line"], *[value(i, n) for i, n in enumerate(fields)])


def memory_percent() -> Column:
    """Used memory in percent with one decimal; 0 where the total is 0."""
    used, total = F.col("memory_used"), F.col("memory_total")
    return F.when(total > 0, round_tenth(used / total * 100)).otherwise(0.0)


# The three ways the services call a GPU idle.
def idle_by_load() -> Column:
    return F.col("utilization") < 10


def idle_by_memory() -> Column:
    return F.when(F.col("memory_total") > 0, F.col("memory_used") / F.col("memory_total") * 100).otherwise(0.0) < 20


def idle_by_both() -> Column:
    return (F.col("utilization") < 10) & (F.col("memory_used") < F.lit(0.2) * F.col("memory_total"))
