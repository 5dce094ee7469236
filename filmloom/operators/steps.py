"""Resumable steps: skip what exists, publish only whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.plans import versions


def missing_outputs(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def complete_batches(members: DataFrame, done: DataFrame, batch: list[str], key: str) -> DataFrame:
    """Per batch: members, finished members, and whether all are finished."""
    marked = members.join(done.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    hit = F.coalesce("__done", F.lit(False))
    return marked.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_done"), F.bool_and(hit).alias("all_exist")
    )


def published(inputs: DataFrame, path: str, key: str) -> DataFrame:
    """Keys already published; none where nothing was published."""
    spark = inputs.sparkSession
    try:
        return spark.read.parquet(*versions.resolve(spark, path)).select(key)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return inputs.select(key).limit(0)


def run_step(inputs: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, key: str) -> DataFrame:
    """Run a step for the keys not yet published and add its rows as a new version.

    The rows become visible together, by one file (``plans.versions``): a lost run leaves nothing behind, and a second call goes on where
    the first stopped. Of two runs at one time the second raises ``ConcurrentWrite``, so no row is there twice.
    """
    spark = inputs.sparkSession
    base, folders = versions.latest(spark, path)
    todo = missing_outputs(inputs, published(inputs, path, key), key)
    folder = versions.new_folder(path)
    step(todo).write.parquet(folder)
    versions.publish(spark, path, base, [*folders, folder])
    return spark.read.parquet(*folders, folder)
