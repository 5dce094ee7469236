"""Job requests, job lists, run summaries and the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request fields with their two spellings.
TEXT_FIELDS = {
    "input_method": ("inputMethod", "input_method"), "youtube_url": ("youtubeUrl", "youtube_url"),
    "manual_path": ("manualPath", "manual_path"), "input_url": ("inputUrl", "input_url"),
    "batch_csv_path": ("batchCsvPath", "batch_csv_path"), "job_type": ("type", "jobType", "mode"),
}
NUMBER_FIELDS = {"part_index": ("partIndex", "part_index"), "part_total": ("partTotal", "part_total")}
FLAG_FIELDS = {
    "unet_flag": ("unetFlag", "unet_flag"), "face_restore_flag": ("faceRestoreFlag", "face_restore_flag"),
    "upscale_flag": ("upscaleFlag", "upscale_flag"), "clahe_flag": ("claheFlag", "clahe_flag"),
}
SCALE_FIELDS = ("upscaleValue", "upscale_value")
DEFAULT_SCALE = 2.0
ACTIVE = ["running", "queued"]
TERMINAL = ["completed", "failed", "cancelled"]


def parse_requests(jobs: DataFrame, body: str = "body") -> DataFrame:
    """Typed request columns from JSON text.

    Texts and numbers take the first spelling with a value other than empty or 0, and failing
    that the last one as it is. Flags and the scale take the first spelling that is present,
    even where it is null.
    """
    fields = [f for names in TEXT_FIELDS.values() for f in names]
    numbers = [f for names in NUMBER_FIELDS.values() for f in names]
    flags = [f for names in FLAG_FIELDS.values() for f in names]
    schema = ", ".join(
        [f"{f} string" for f in fields] + [f"{f} bigint" for f in numbers] + [f"{f} boolean" for f in flags] + [f"{f} double" for f in SCALE_FIELDS]
    )
    parsed = jobs.withColumns({"__r": F.from_json(body, schema), "__keys": F.json_object_keys(body)})

    def field(name: str) -> Column:
        return F.col(f"__r.{name}")

    def first_true(names: tuple[str, ...], empty: object) -> Column:
        return F.coalesce(*[F.nullif(field(n), F.lit(empty)) for n in names[:-1]], field(names[-1]))

    def first_present(names: tuple[str, str], default: object) -> Column:
        camel, snake = (F.array_contains("__keys", n) for n in names)
        return F.when(camel, field(names[0])).when(snake, field(names[1])).otherwise(F.lit(default))

    return parsed.select(
        *[c for c in jobs.columns if c != body],
        *[first_true(n, "").alias(c) for c, n in TEXT_FIELDS.items()],
        *[first_true(n, 0).alias(c) for c, n in NUMBER_FIELDS.items()],
        *[first_present(n, False).alias(c) for c, n in FLAG_FIELDS.items()],
        first_present(SCALE_FIELDS, DEFAULT_SCALE).alias("upscale_value"),
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.first("status").isin(ACTIVE).alias("is_active"))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(ACTIVE))


def run_summary(items: DataFrame, existed: Column, result_ok: Column) -> DataFrame:
    """Items skipped because their output existed, done, and failed."""
    return items.agg(
        F.count_if(~existed & result_ok).alias("success"), F.count_if(existed).alias("skipped"), F.count_if(~existed & ~result_ok).alias("failed")
    )


def fleet(nodes: DataFrame, gpus: DataFrame, jobs: DataFrame, idle: Column) -> DataFrame:
    """Every node with its GPU counts and running jobs; nodes never heard of stay null."""
    seen = gpus.groupBy("node_id").agg(F.count(F.lit(1)).alias("gpus"), F.count_if(idle).alias("idle_gpus"))
    busy = active(jobs).groupBy("node_id").agg(F.count(F.lit(1)).alias("running_jobs"), F.max("progress").alias("top_progress"))
    return (
        nodes.join(seen, "node_id", "left").join(busy, "node_id", "left")
        .withColumn("running_jobs", F.coalesce("running_jobs", F.lit(0)))
        .withColumn("status", F.lit("online"))
    )
