"""Run a stream over what is there and hand back its output as a table in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from filmloom.plans.session import SETTINGS
from filmloom.plans.storage import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Counting all rows of the store costs a read for each write; a micro-batch saves its changes, not the whole store.
STATE_SETTINGS = {
    STATE_STORE: SETTINGS[STATE_STORE],
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Ticks:
    """A stream of times beside the data: moves the watermark where the data pauses or has ended."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_path(spark, 'ticks')}/at"
        self._write([])

    def _write(self, times: list[str]) -> None:
        rows = self.spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("at"))
        rows.coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(StructType([StructField("at", TimestampType())])).parquet(self.folder)

    def close(self) -> None:
        """A time far behind all data."""
        self._write(["2200-01-01 00:00:00"])


def drain(stream: DataFrame, label: str, mode: str = "append", ticks: Ticks | None = None, at_once: bool = False) -> DataFrame:
    """Process all available input into a table and read it.

    ``append`` uses the file sink. ``update`` and ``complete`` write each micro-batch with its
    ``batch_id``; see :func:`latest` for the current row per key. Restarts reuse the checkpoint. With ``ticks``, the
    watermark is then moved behind all data, so that what waits for it comes out too. ``at_once`` says that the sources give all they have
    in one micro-batch: the closing time may then come with it.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    out, checkpoint = f"{root}/table", f"{root}/checkpoint"
    if ticks is not None and at_once:
        ticks.close()
    start(stream, out, checkpoint, mode).awaitTermination()
    if ticks is not None and not at_once:
        ticks.close()
        start(stream, out, checkpoint, mode).awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(out)


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Start the query; its keyed state is in the store of ``plans.session`` whatever the session has."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        conf.set(name, value)
    try:
        return _start(stream, out, checkpoint, mode)
    finally:
        for name, value in before.items():
            conf.set(name, value) if value else conf.unset(name)


def _start(stream: DataFrame, out: str, checkpoint: str, mode: str):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", out).start()

    def write(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, overwritten on a retry, so a batch is never counted twice.
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return writer.foreachBatch(write).start()


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of a table written in update mode."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return table.groupBy(*keys).agg(newest).select(*keys, "v.*")
