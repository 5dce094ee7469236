"""Stored files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions.paths import base_name, has_suffix


def list_files(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """Name, path, size and time of every file below a folder. Contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = raw.select(
        base_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("modified_us"),
    )
    return listed.filter(has_suffix(F.col("name"), suffixes)) if suffixes else listed
