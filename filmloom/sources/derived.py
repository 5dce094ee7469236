"""Media tables derived from the given tables, over all their rows.

``FIXTURES.md`` describes each derivation; ``catalog/oracle_views.py`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.plans.ordering import number_rows

SIDE = 8  # height and width of a derived frame
FPS = 5  # frame rate of the derived videos
START_US = 1_704_067_200_000_000  # 2024-01-01, where derived times start; event times must lie after the epoch
BUCKET = 2**21  # ids per numbering bucket: spread over 4 videos and 10 labels, about 52,000 rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 2024-01-01."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


# frames and pixels


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 4).alias("video_id"),
        "vec_id",
        "label",
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        F.transform(
            "embedding",
            lambda e: F.greatest(
                F.least(F.floor(20 + F.col("label") * 20 + e.cast("double") * 16), F.lit(255)), F.lit(0)
            ).cast("int"),
        ).alias("px"),
    )
    order = ["label", "vec_id"]
    buckets = [F.col("label"), F.floor(F.col("vec_id") / BUCKET)]
    return number_rows(raw, ["video_id"], order, buckets, "frame_idx").select("video_id", "frame_idx", "h", "w", "px")


def rotated(px: Column, by: int) -> Column:
    return F.concat(F.slice(px, by + 1, SIDE * SIDE), F.slice(px, 1, by))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Color pixels: blue, green and red are the plane rotated by 0, 1 and 9 positions."""
    planes = F.arrays_zip(
        F.col("px").alias("b"), rotated(F.col("px"), 1).alias("g"), rotated(F.col("px"), 9).alias("r")
    )
    return (
        frames(spark, sf_dir)
        .select("video_id", "frame_idx", F.posexplode(planes).alias("pos", "c"))
        .select(
            "video_id", "frame_idx",
            F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"),
            "c.b", "c.g", "c.r",
        )
    )


def mask_of(px: Column, k: int) -> Column:
    """Mask k of a frame: 1 where ``(v + 37 k) % 11 = 0``; four masks leave most pixels free."""
    return F.transform(px, lambda v: ((v + 37 * k) % 11 == 0).cast("int"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four instance masks per frame, packed."""
    packed = F.array(*[F.struct(F.lit(k).alias("inst"), mask_of(F.col("px"), k).alias("mask")) for k in range(1, 5)])
    return frames(spark, sf_dir).select("video_id", "frame_idx", "h", "w", F.inline(packed))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order, one box per line and part; equal confidences occur on purpose."""
    boxes = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(F.max("l_quantity").alias("q"), F.max("l_suppkey").alias("s"))
    )
    x1, y1 = F.col("l_partkey") % 6, F.col("s") % 6
    return boxes.select(
        (F.col("l_orderkey") % 4).alias("video_id"),
        F.floor(F.col("l_orderkey") / 4).alias("frame_idx"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("det_no"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + 1 + F.col("l_linenumber") % 3).cast("int").alias("x2"),
        (y1 + 1 + F.col("q").cast("int") % 3).cast("int").alias("y2"),
        (F.col("q") / 50).alias("conf"),
        (F.col("l_partkey") % 3).cast("int").alias("cls"),
    )


# manifests and jobs

# The manifest header.
MANIFEST_COLUMNS = [
    "YouTube URL", "face_upscale", "background_upscale", "background_upscale_value", "unet", "clahe",
    "crop_video", "start_time (00:00:00)", "end_time (01:22:33)", "Executed", "Start Time", "End Time",
    "Remarks", "Input Path",
]


def manifest_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, "")
        .when(k % 23 == 0, F.concat(F.lit("/data/in/"), k.cast("string"), F.lit(".mkv")))
        .when(k % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit(" https://youtu.be/"), F.col("o_custkey").cast("string")))
    )
    flag = F.element_at(
        F.array(F.lit("true"), F.lit("False"), F.lit("nan"), F.lit("maybe"), F.lit(None).cast("string")),
        F.left("o_orderpriority", F.lit(1)).cast("int"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "P", "Error").otherwise("")
    return table(spark, sf_dir, "orders").select(
        k.alias("line_no"),
        url.alias("YouTube URL"),
        flag.alias("face_upscale"),
        F.when(k % 2 == 0, "1").otherwise("No").alias("background_upscale"),
        F.when(k % 7 == 0, " NaN ").when(k % 11 == 0, "two").otherwise((k % 6).cast("string")).alias("background_upscale_value"),
        flag.alias("unet"),
        F.lit("").alias("clahe"),
        F.when(k % 3 == 0, "y").otherwise("n").alias("crop_video"),
        F.lit("00:00:05").alias("start_time (00:00:00)"),
        F.concat(F.lit("00:01:"), F.lpad((k % 60).cast("string"), 2, "0")).alias("end_time (01:22:33)"),
        status.alias("Executed"),
        F.lit("").alias("Start Time"),
        F.lit("").alias("End Time"),
        F.when(k % 5 == 0, "failed: out of memory, retry").otherwise("").alias("Remarks"),
        F.concat(F.lit("input_videos/"), k.cast("string"), F.lit(".mp4")).alias("Input Path"),
    )


def manifest_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet from elsewhere: no ``Input Path``, no ``clahe``, one column of its own."""
    k = F.col("c_custkey")
    prefix = F.when(k % 2 == 0, "https://www.youtube.com/watch?v=").otherwise("https://youtu.be/")
    cols = {c: F.lit("") for c in MANIFEST_COLUMNS if c not in ("Input Path", "clahe")}
    cols["YouTube URL"] = F.concat(prefix, k.cast("string"))
    cols["unet"] = F.when(k % 2 == 0, "True").otherwise("nan")
    return table(spark, sf_dir, "customer").select(
        k.alias("line_no"), *[c.alias(n) for n, c in cols.items()], F.col("c_mktsegment").alias("Owner")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results of the pending manifest rows."""
    k, cents = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100 + 0.5)
    good = cents % 2 == 0
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") != "F")
        .select(
            k.alias("line_no"),
            F.when(good, "Yes").otherwise("Error").alias("new_status"),
            F.lit("2025-01-01T00:00:00").alias("new_start"),
            F.when(good, "2025-01-01T01:00:00").otherwise("").alias("new_end"),
            F.when(good, "").otherwise(F.concat(F.lit("code "), (k % 9).cast("string"))).alias("new_remarks"),
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests as JSON, with camelCase keys on odd rows and snake_case on even ones."""
    k = F.col("o_orderkey")
    num = k.cast("string")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "failed")
        .when(k % 2 == 0, "queued")
        .otherwise("running")
    )
    url = F.concat(F.lit("https://youtu.be/"), F.col("o_custkey").cast("string"))
    part = (k % 3).cast("string")
    camel = F.concat(
        F.lit('{"jobType":"batch_csv","youtubeUrl":"'), F.when(k % 9 == 0, "").otherwise(url),
        F.lit('","youtube_url":"alt-'), num, F.lit('","partIndex":'), part, F.lit(',"part_index":7'),
        F.when(k % 7 == 0, "").otherwise(F.when(k % 5 == 0, ',"unetFlag":null,"unet_flag":true,"upscaleValue":1.5').otherwise(',"unetFlag":true,"upscaleValue":3')),
        F.lit("}"),
    )
    snake = F.concat(
        F.lit('{"mode":"single","type":"","youtube_url":"'), url, F.lit('","part_index":'), part,
        F.when(k % 7 == 0, "").otherwise(',"unet_flag":true,"upscale_value":4.0'), F.lit("}"),
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), status.alias("status"), (k % 101).cast("int").alias("progress"),
        (F.col("o_custkey") % 8).alias("node_id"),
        F.when(k % 2 == 1, camel).otherwise(snake).alias("body"),
    )


# logs and telemetry


def log_columns() -> list[Column]:
    """The log columns of an events row; also used on an events stream."""
    i, ev = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    num, n = k.cast("string"), i.cast("string")
    click = (
        F.when(i % 4 == 0, F.concat(F.lit("Progress: "), num, F.lit("%")))
        .when(i % 4 == 1, F.concat(F.lit(" "), num, F.lit("%|####  | 3/8")))
        .when(i % 4 == 2, F.concat(F.lit("frame=  "), (k * 11).cast("string"), F.lit(" fps=25")))
        .otherwise(
            F.concat(
                F.lit("size=1kB time=00:0"), (i % 3).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"),
                F.lit("."), F.lpad((i % 100).cast("string"), 2, "0"), F.lit(" speed=1x"),
            )
        )
    )
    view = (
        F.when(i % 7 == 0, F.concat(F.lit("Task "), num, F.lit(" / 100")))
        .when(i % 7 == 1, F.concat(F.lit("task "), num, F.lit("/8")))
        .when(i % 7 == 2, "[INFO] Running restoration...")
        .when(i % 7 == 3, "[INFO] Starting scene detection for: x")
        .when(i % 7 == 4, "ComfyUI server ready")
        .when(i % 7 == 5, F.concat(F.lit("Colorized final video at: tmp/"), n, F.lit(".mp4")))
        .otherwise(F.concat(F.lit("Task "), num, F.lit(" / 0")))
    )
    signup = (
        F.when(i % 2 == 0, F.concat(F.lit("🎯 Video URL: https://youtu.be/"), n))
        .otherwise(F.concat(F.lit("📥 Resolved Path: input_videos/"), n, F.lit(".mp4")))
    )
    purchase = (
        F.when(i % 4 == 0, F.concat(F.lit("final video at: /workspace/out//"), n, F.lit(".mp4")))
        .when(i % 4 == 1, F.concat(F.lit("Final Postprocessed video at: out/"), n, F.lit(".mp4")))
        .otherwise(F.concat(F.lit("final video at: output_videos/x/../"), n, F.lit(".mp4 ")))
    )
    error = (
        F.when(i % 5 == 0, "")
        .when(i % 2 == 0, "status: Error")
        .otherwise(F.concat(F.lit("remarks: code "), num, F.lit(": retry")))
    )
    line = (
        F.when(ev == "click", click).when(ev == "view", view).when(ev == "signup", signup)
        .when(ev == "purchase", purchase).otherwise(error)
    )
    return [
        F.col("user_id").alias("job_id"), i.alias("line_no"),
        F.floor(micros("ts") / 1000).alias("ts_us"), line.alias("line"),
    ]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*log_columns())


def gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe output, one text line per row, with blank and short lines among them."""
    k = F.col("s_suppkey")
    full = F.concat_ws(
        ", ", k.cast("string"), F.col("s_name"), (k % 30).cast("string"), ((k * 97) % 8000).cast("string"),
        F.when(k % 25 == 0, "0").otherwise("8000"), (k % 40 + 40).cast("string"),
    )
    lines = F.array(full, F.when(k % 10 == 0, "   "), F.when(k % 10 == 1, "n/a, no device, -"))
    return (
        table(spark, sf_dir, "supplier")
        .select((F.col("s_nationkey") % 8).cast("bigint").alias("node_id"), k.alias("probe_no"), F.posexplode(lines).alias("part", "line"))
        .filter(F.col("line").isNotNull())
    )


# files, videos, templates


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(F.lit(".mp4"), F.lit(".MKV"), F.lit(".txt"), F.lit("")), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("Actor_"), k.cast("string"), ext)
    folder = (
        F.when(k % 29 == 0, F.lit("/workspace2/"))
        .when(k % 13 == 0, F.lit("../../etc/"))
        .when(k % 11 == 0, F.concat(F.lit("input_videos/./x/../Scene_"), F.col("p_size").cast("string"), F.lit("//")))
        .when(k % 7 == 0, F.lit("/workspace/input_videos/"))
        .otherwise(F.concat(F.lit("input_videos/Scene_"), F.col("p_size").cast("string"), F.lit("/")))
    )
    return table(spark, sf_dir, "part").select(
        k.alias("file_id"), name.alias("name"), F.concat(folder, name).alias("path"),
        (k * 31 % 1000).alias("size"), (k % 3 == 0).alias("is_done"), "p_size",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rate = F.when(k % 5 == 0, "0/0").when(k % 2 == 0, "25/1").otherwise("30000/1001")
    return table(spark, sf_dir, "part").select(
        k.alias("video_id"), rate.alias("rate"), (s * 40).cast("bigint").alias("width"),
        (s * 30 - k % 7 + 7).alias("height"), (k % 400).alias("frame_count"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node graphs as JSON text; the order of the five nodes differs from row to row."""
    k = F.col("p_partkey")
    nodes = [
        '"78":{"class_type":"Load Image","inputs":{"image":"a.png","upload":"image"}}',
        '"76":{"class_type":"CLIPTextEncode","inputs":{"text":"old","clip":["38",0]}}',
        '"3":{"class_type":"KSampler","inputs":{"seed":1,"steps":4,"cfg":1.5}}',
        '"35":{"class_type":"FluxGuidance","inputs":{"guidance":2.5,"cfg":9.5}}',
        '"77":{"class_type":"TextEncode","inputs":{"prompt":"none","width":64}}',
    ]
    bodies = ["{" + ",".join(nodes[i:] + nodes[:i]) + "}" for i in range(5)]
    return table(spark, sf_dir, "part").select(
        k.alias("template_id"), F.element_at(F.array(*[F.lit(b) for b in bodies]), (k % 5 + 1).cast("int")).alias("body")
    )


# requests, vectors


def request_columns() -> list[Column]:
    return [F.col("event_id").alias("prompt_id"), micros("ts").alias("req_us")]


def responses_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    parts = F.filter(
        F.array(F.lit("clothes"), F.lit("arms"), F.lit("neck"), F.when(k % 7 != 0, "faces")), lambda p: p.isNotNull()
    )
    return events.filter(k % 10 != 0).select(
        F.col("event_id").alias("prompt_id"),
        (micros("ts") + k.cast("bigint") * 13_000_000).alias("resp_us"),
        F.explode(parts).alias("part"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token logits of one query per row."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double") * 8).alias("logits")
    )
