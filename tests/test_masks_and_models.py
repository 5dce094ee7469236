"""Masks of any instance number, one model call per row, boxes that stay off pixels, cache retries."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from filmloom.operators import detections as DT
from filmloom.operators import frames as FR
from filmloom.operators import inference as I
from filmloom.operators import pixels as PX
from filmloom.plans.storage import scratch_path

FRAME = "video_id bigint, frame_idx bigint, h int, w int, px array<int>"
BOX = "video_id bigint, frame_idx bigint, det_no bigint, x1 int, y1 int, x2 int, y2 int, conf double, cls int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_blend_in_instance_order_whatever_the_numbers(spark):
    base = spark.createDataFrame([(1, 0, 2, 2, [10, 20, 30, 40])], FRAME)
    over = spark.createDataFrame([(1, 0, 2, 2, [110, 120, 130, 140])], FRAME)
    parts = [(-1, [1.0, 0.0, 0.25, 0.5]), (1_000_000, [0.5, 0.5, 0.0, 0.3]), (7, [0.2, 0.9, 0.6, 0.1])]
    masks = spark.createDataFrame([(1, 0, i, m) for i, m in parts], "video_id bigint, frame_idx bigint, inst bigint, mask array<double>")
    want = [10.0, 20.0, 30.0, 40.0]
    for _, mask in sorted(parts):
        want = [math.floor(m * n + (1.0 - m) * v) if m > 0 else v for v, n, m in zip(want, [110, 120, 130, 140], mask)]
    assert rows(FR.alpha_blend(base, over, masks), "pos", "v") == [(i, int(v)) for i, v in enumerate(want)]
    with pytest.raises(Exception, match="without an instance"):
        FR.alpha_blend(base, over, masks.withColumn("inst", F.lit(None).cast("bigint"))).collect()


def test_user_functions_are_called_once_per_row(spark):
    px = list(range(36))
    frames = spark.createDataFrame([(1, i, 6, 6, px) for i in range(3)], FRAME)
    tiles = PX.map_tiles(frames, 4, 3, lambda t: t + t.shape[0])
    regions = PX.connected_regions(frames.withColumn("mask", F.transform("px", lambda v: v % 2))).select("frame_idx", F.posexplode("labels").alias("i", "v"))
    members = frames.select("video_id", F.lit(0).alias("scene_id"), F.col("frame_idx").alias("pos"), "h", "w", "px")
    grids = I.map_grids(members, ["video_id", "scene_id"], lambda c: c + 1)
    for df in (tiles, regions, grids.select("pos", F.explode("px"))):
        assert plan_of(df).count("ArrowEvalPython") == 1
    want = sorted((f, n, y, x, float(y * 6 + x + min(4, 6 - ty))) for f in range(3) for n, (ty, tx) in enumerate((a, b) for a in (0, 3) for b in (0, 3)) for y in range(ty, min(6, ty + 4)) for x in range(tx, min(6, tx + 4)))
    assert rows(tiles, "frame_idx", "tile_no", "y", "x", "v") == sorted(want, key=repr)
    assert all(r.px == [v + 1 for v in px] for r in grids.collect()) and grids.count() == 3


def test_boxes_of_absent_frames_meet_no_pixel(spark):
    pixels = spark.createDataFrame([(1, 0, y, x) for y in range(4) for x in range(4)], "video_id bigint, frame_idx bigint, y int, x int")
    boxes = spark.createDataFrame([(1, 0, 1, 1, 1, 3, 3, 0.9, 0), (1, 5, 2, 0, 0, 4, 4, 0.9, 0), (2, 0, 3, 0, 0, 4, 4, 0.9, 0)], BOX)
    assert rows(DT.on_frames(boxes, pixels), "det_no") == [(1,)]
    assert rows(DT.pixels_in_boxes(pixels, boxes), "y", "x") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_region_means_leave_the_background_alone(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 1, 2, 90, 91), (1, 0, 0, 1, 5, 3, 4, 10, 20), (1, 0, 0, 2, 5, 5, 6, 15, 21), (1, 1, 0, 0, 0, 7, 8, 1, 1)],
        "video_id bigint, frame_idx bigint, y int, x int, region int, a int, b int, new_a int, new_b int",
    )
    got = PX.region_color_transfer(cells)
    assert rows(got, "frame_idx", "x", "a", "b") == [(0, 0, 1, 2), (0, 1, 12, 20), (0, 2, 12, 20), (1, 0, 7, 8)]
    assert got.columns == cells.columns and "Window" not in plan_of(got)


def test_cache_recovers_from_a_failed_write(spark):
    path = scratch_path(spark, "cache")
    boxes = spark.createDataFrame([(1, 0, 1, 1, 1, 3, 3, 0.9, 0), (1, 0, 2000, 0, 0, 4, 4, 0.5, 1)], BOX)
    failing = boxes.withColumn("conf", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        DT.cache_detections(failing, path)
    assert rows(DT.cache_detections(boxes, path), "det_no", "conf") == [(1, 0.9), (2000, 0.5)]
    assert rows(DT.cache_detections(boxes.limit(0), path), "det_no") == [(1,), (2000,)]  # written once, then read
