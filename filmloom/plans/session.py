"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Cluster defaults. A deployment can override any of them with spark-submit --conf.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed streaming state off the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

PARTITION_BYTES = 128 * 2**20
LEAST_PARTITIONS = 200


def partition_settings(input_bytes: int, state_partitions: int = LEAST_PARTITIONS) -> dict[str, str]:
    """Shuffle partitions for an input of this size.

    The runtime merges small partitions of a shuffle but does not split large ones, so shuffles start with one
    partition for each 128 MB. A stream keeps the number it starts with, as its state is stored
    by partition; that number is ``spark.sql.shuffle.partitions`` and is chosen for itself.
    """
    wide = max(LEAST_PARTITIONS, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(wide),
        "spark.sql.shuffle.partitions": str(state_partitions),
    }


def build_session(app: str = "filmloom", master: str | None = None, input_bytes: int = 0, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **partition_settings(input_bytes), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
