"""Log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filmloom.functions.paths import stem
from filmloom.plans.ordering import number_rows


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """One job per text file. Lines are numbered from 1 in file order, in parallel over file blocks."""
    raw = spark.read.text(path).select(
        stem(F.col("_metadata.file_path")).alias("job_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("read_order"),
        F.col("value").alias("line"),
    )
    numbered = number_rows(raw, ["job_id"], ["block_start", "read_order"], [F.col("block_start")], "line_no")
    return numbered.select("job_id", (F.col("line_no") + 1).alias("line_no"), "line")


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int | None = None, bytes_per_trigger: int | None = 16 * 2**30
) -> DataFrame:
    """A folder's parquet files of one table as a stream; a backlog is taken in bounded micro-batches.

    ``bytes_per_trigger=None`` takes all there is in one, as a table needs whose files are not in the order of event time.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return (reader.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else reader).parquet(folder)
