"""Detections: ranking, boxes to pixels, masks of boxes, vectors, cache.

Columns: video_id, frame_idx, det_no, x1, y1, x2, y2, conf, cls (0 is a person).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filmloom.operators.packed import line_spans, lines_of

KEYS = ["video_id", "frame_idx"]
PERSON = 0
# Boxes kept per frame, confidence limit, share a box grows on each side.
TOP_BOXES, MIN_CONFIDENCE, ENLARGE = 3, 0.6, 0.2
# Fixed value: score and token limit of the text query.
QUERY_LIMIT = 0.12


def top_detections(detections: DataFrame, k: int = TOP_BOXES, min_conf: float = MIN_CONFIDENCE, cls: int = PERSON) -> DataFrame:
    """The k most confident detections of a frame, and of those the confident ones of one class.

    The cut to k comes first. Equal confidences keep the later detection first, as a reversed
    ascending sort does. Spark applies the rank limit before the shuffle too, so a frame with
    very many detections sends k rows per task.
    """
    w = Window.partitionBy(*KEYS).orderBy(F.desc("conf"), F.desc("det_no"))
    top = detections.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.filter((F.col("cls") == cls) & (F.col("conf") >= min_conf))


def confident(detections: DataFrame, min_conf: float = MIN_CONFIDENCE, cls: int = PERSON) -> DataFrame:
    return detections.filter((F.col("cls") == cls) & (F.col("conf") >= min_conf))


def clamped(detections: DataFrame, width: int, height: int, enlarge: float = 0.0) -> DataFrame:
    """Boxes grown by a share of their size and cut at the picture's edges; empty ones are dropped."""
    dx = F.floor((F.col("x2") - F.col("x1")) * enlarge)
    dy = F.floor((F.col("y2") - F.col("y1")) * enlarge)
    grown = {
        "x1": F.greatest(F.lit(0), F.col("x1") - dx), "y1": F.greatest(F.lit(0), F.col("y1") - dy),
        "x2": F.least(F.lit(width), F.col("x2") + dx), "y2": F.least(F.lit(height), F.col("y2") + dy),
    }
    return detections.withColumns({c: v.cast("int") for c, v in grown.items()}).filter("x2 > x1 AND y2 > y1")


def on_frames(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes of frames that ``cells`` has, so that no other box is ever spread over pixels."""
    return boxes.join(cells.select(*KEYS).distinct(), KEYS, "left_semi")


def rasterized(boxes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per pixel a box covers."""
    rows = boxes.select(*KEYS, *keep, "x1", "x2", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    return rows.select(*KEYS, *keep, "y", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels under at least one box: boxes become spans of lines, and each pixel meets its line once."""
    spans = line_spans(on_frames(boxes, pixels))
    inside = F.exists("spans", lambda s: (F.col("x") >= s["from"]) & (F.col("x") < s["to"]))
    return pixels.join(spans, [*KEYS, "y"]).filter(inside).select(*pixels.columns)


def split_by_detection(frames: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with and without any detection; only the first need a mask model."""
    seen = detections.select(*KEYS).distinct()
    return frames.join(seen, KEYS, "left_semi"), frames.join(seen, KEYS, "left_anti")


def with_blank_masks(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame once, marked, with an all-zero mask where nothing was detected."""
    seen = detections.select(*KEYS).distinct().withColumn("has_box", F.lit(True))
    marked = frames.join(seen, KEYS, "left").withColumn("has_box", F.coalesce("has_box", F.lit(False)))
    return marked.withColumn("mask", F.when(~F.col("has_box"), F.transform("px", lambda _: F.lit(0))))


def pasted_crops(crop_cells: DataFrame, boxes: DataFrame, frame_cells: DataFrame) -> DataFrame:
    """Masks in box coordinates, put at their boxes and joined per class over all boxes of a frame.

    ``crop_cells``: video_id, frame_idx, det_no, cls, crop_h, crop_w, cy, cx, m. A box of another
    size takes the nearest crop cell. Pixels of ``frame_cells`` (with ``cls``) without any mask are 0.
    """
    bx = on_frames(boxes.select(*KEYS, "det_no", "x1", "y1", "x2", "y2"), frame_cells)
    crop_cells = on_frames(crop_cells, frame_cells)
    # A crop's line is one row, and so is each line of a box; only they are joined.
    crops = crop_cells.groupBy(*KEYS, "det_no", "cls", "crop_h", "crop_w", "cy").agg(F.array_sort(F.collect_list(F.struct("cx", "m"))).alias("line"))
    sized = bx.join(crop_cells.select(*KEYS, "det_no", "cls", "crop_h", "crop_w").distinct(), [*KEYS, "det_no"])
    lines = lines_of(sized.withColumns({"top": F.col("y1"), "high": F.col("y2") - F.col("y1")}), ["det_no", "cls", "crop_h", "crop_w", "top", "high"])
    wanted = lines.withColumn("cy", F.floor((F.col("y") - F.col("top")) * F.col("crop_h") / F.col("high")).cast("int"))
    hit = wanted.join(crops, [*KEYS, "det_no", "cls", "crop_h", "crop_w", "cy"])
    held = hit.groupBy(*KEYS, "cls", "y").agg(F.collect_list(F.struct("x1", "x2", "crop_w", "line")).alias("held"))

    def cell(b: Column) -> Column:
        cx = F.floor((F.col("x") - b["x1"]) * b["crop_w"] / (b["x2"] - b["x1"])).cast("int")
        found = F.array_max(F.transform(F.filter(b["line"], lambda c: c["cx"] == cx), lambda c: c["m"]))
        return F.when(F.size(b["line"]) == b["crop_w"], F.get(b["line"], cx)["m"]).otherwise(found)

    over = F.filter("held", lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]))
    joined = frame_cells.join(held, [*KEYS, "cls", "y"], "left")
    return joined.withColumn("m", F.coalesce(F.array_max(F.transform(over, cell)), F.lit(0))).drop("held")


def confidence_maps(cells: DataFrame, boxes: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Per label and pixel, the largest confidence of a box that covers it; 0 where there is none.

    Boxes become lines with the largest confidence of equal stretches; a pixel meets the stretches of its line once, strongest first.
    """
    lines = lines_of(on_frames(boxes.filter(F.col("cls").isin(list(labels))), cells), ["cls", "conf"])
    best = lines.groupBy(*KEYS, "y", "cls", "x1", "x2").agg(F.max("conf").alias("conf"))
    held = best.groupBy(*KEYS, "y").agg(F.sort_array(F.collect_list(F.struct("conf", "cls", "x1", "x2")), asc=False).alias("held"))
    joined = cells.select(*KEYS, "y", "x").join(held, [*KEYS, "y"], "left")
    over = F.filter("held", lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]))
    found = joined.select(*KEYS, "y", "x", over.alias("over"))

    def strongest(c: int) -> Column:
        return F.coalesce(F.get(F.filter("over", lambda b: b["cls"] == c), F.lit(0))["conf"], F.lit(0.0))

    per_label = F.array(*[F.struct(F.lit(c).alias("cls"), strongest(c).alias("confidence")) for c in labels])
    return found.select(*KEYS, "y", "x", F.inline(per_label))


def best_tokens(vectors: DataFrame, threshold: float = QUERY_LIMIT, text_threshold: float = QUERY_LIMIT) -> DataFrame:
    """Token with the highest probability of each query that passes both limits.

    A query passes with any probability over the first limit, and one over the second that is
    neither the first nor the last token. The winner is taken over all tokens.
    """
    probs = F.transform("logits", lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
    scored = vectors.select("id", probs.alias("probs")).withColumn("score", F.array_max("probs"))
    inner = F.slice("probs", F.lit(2), F.greatest(F.size("probs") - 2, F.lit(0)))
    passed = (F.col("score") > threshold) & F.exists(inner, lambda p: p > text_threshold)
    return scored.filter(passed).select("id", "score", (F.array_position("probs", F.col("score")) - 1).alias("token"))


def best_frames(detections: DataFrame, sharpness: DataFrame, seconds_frames: int, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Per interval the frame with the largest confident person, the earliest on ties, else the sharpest.

    ``sharpness`` has one row per frame. Both choices are ``max_by`` aggregates.
    """
    interval = F.floor(F.col("frame_idx") / seconds_frames).alias("interval_no")
    area = F.greatest(F.lit(0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    people = confident(detections, min_conf).select("video_id", interval, "frame_idx", area.alias("area"))
    person = people.groupBy("video_id", "interval_no").agg(
        F.max_by("frame_idx", F.struct("area", -F.col("frame_idx"))).alias("person_frame"), F.max("area").alias("area")
    )
    sharp = sharpness.groupBy("video_id", interval).agg(
        F.max_by("frame_idx", F.struct("sharpness", -F.col("frame_idx"))).alias("sharp_frame")
    )
    return sharp.join(person, ["video_id", "interval_no"], "left").select(
        "video_id", "interval_no", F.coalesce("person_frame", "sharp_frame").alias("frame_idx"),
        F.when(F.col("person_frame").isNotNull(), "person").otherwise("sharpness").alias("chosen_by"), "area",
    )


def cache_detections(detections: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Write detections once, nested per frame and part, and read them back flat.

    A frame's list is split into parts of bounded size, so no row grows with a crowded frame. What a
    failed first write left behind is written over.
    """
    spark = detections.sparkSession
    if not _is_written(spark, path):
        box = F.struct("det_no", "x1", "y1", "x2", "y2", "conf", "cls")
        nested = detections.groupBy(*KEYS, F.floor(F.col("det_no") / 1024).alias("part")).agg(F.collect_list(box).alias("boxes"))
        nested.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).select(*KEYS, F.inline("boxes"))


def _is_written(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a table; a write that failed leaves none, since its committer shows all files at the end."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True
