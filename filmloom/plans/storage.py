"""Shared scratch storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without: it gets a temporary folder. Executors of a cluster would each
    write to a disk of their own, and what is read back would be incomplete.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, below ``filmloom/``; the deployment's retention removes it."""
    return f"{shared_dir(spark)}/filmloom/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later plans reuse it and survive lost executors."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
