"""Packed masks and line spans against numpy, on frames of real size and odd ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from filmloom.operators import detections as DT
from filmloom.operators import frames as FR
from filmloom.operators import packed as PK
from filmloom.operators import pixels as PX
from filmloom.plans import graph
from filmloom.plans.storage import write_through

MASKS = "video_id bigint, frame_idx bigint, inst int, mask array<int>"
FRAMES = "video_id bigint, frame_idx bigint, px array<int>"
BOXES = "video_id bigint, frame_idx bigint, det_no int, x1 int, y1 int, x2 int, y2 int, conf double, cls int"


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(8)


def test_masked_replace_of_256_by_256(spark, rng):
    n = 256 * 256
    masks = {(f, i): (rng.random(n) < 0.1).astype(int) for f in (0, 1) for i in (1, 2, 7)}
    old, new = rng.integers(0, 256, (3, n)), rng.integers(0, 256, (3, n))
    table = spark.createDataFrame([(1, f, i, m.tolist()) for (f, i), m in masks.items()], MASKS)
    source, target = (spark.createDataFrame([(1, f, x[f].tolist()) for f in range(3)], FRAMES) for x in (new, old))
    words = PK.united(table)
    assert words.count() == 2 * n // 64  # a row for 64 cells
    out = FR.masked_replace(source, target, table)
    got = {r.frame_idx: np.array(r.px) for r in out.collect()}
    for f in (0, 1):
        any_mask = sum(masks[f, i] for i in (1, 2, 7)) > 0
        assert (got[f] == np.where(any_mask, new[f], old[f])).all()
    assert (got[2] == old[2]).all()  # no mask
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "posexplode" in plan  # the words alone


def test_blend_over_several_strips(spark, rng):
    n = FR.STRIP + 2000
    old, new = rng.integers(0, 256, n), rng.integers(0, 256, n)
    soft = {3: rng.random(n).round(2), 1: rng.random(n).round(2), -2: np.where(rng.random(n) < 0.5, 0.0, 0.5)}
    masks = spark.createDataFrame([(1, 0, i, m.tolist()) for i, m in soft.items()], MASKS.replace("array<int>", "array<double>"))
    base, over = (spark.createDataFrame([(1, 0, x.tolist()), (1, 1, x.tolist())], FRAMES) for x in (old, new))
    v = old.astype(float)
    for i in (-2, 1, 3):
        v = np.floor(soft[i] * new + (1 - soft[i]) * v)
    got = rows(FR.alpha_blend(base, over, masks).filter("frame_idx = 0"), "pos", "v")
    assert got == sorted(((i, int(x)) for i, x in enumerate(v)), key=repr)
    assert rows(FR.alpha_blend(base, over, masks).filter("frame_idx = 1"), "pos", "v") == sorted(((i, int(x)) for i, x in enumerate(old)), key=repr)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 130])
def test_words_and_back(spark, rng, size):
    cells = [None if x < 1 else int(x > 5) for x in rng.integers(0, 10, size)]
    df = spark.createDataFrame([(1, 0, 1, cells), (1, 0, 2, [0] * size), (2, 0, 1, None)], MASKS)
    out = PK.unpacked(PK.united(df), ["bits"])
    assert rows(out, "pos", "bits") == sorted(((i, c == 1) for i, c in enumerate(cells)), key=repr)


def boxes_of(spark, seed, side=40, n=60):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        out.append((1, d % 3, d, x, y, min(side, x + rng.randint(0, 12)), min(side, y + rng.randint(0, 12)), rng.randint(1, 9) / 10, rng.randrange(3)))
    return out, spark.createDataFrame(out, BOXES)


def test_spans_cover_and_confidences(spark):
    side = 40
    plain, boxes = boxes_of(spark, 4)
    assert PK.lines_of(boxes).count() == sum(b[6] - b[4] for b in plain if b[5] > b[3])  # a row for each line
    cover, best = np.zeros((3, side, side), bool), np.zeros((3, 3, side, side))
    for _, f, _, x1, y1, x2, y2, conf, cls in plain:
        cover[f, y1:y2, x1:x2] = True
        best[f, cls, y1:y2, x1:x2] = np.maximum(best[f, cls, y1:y2, x1:x2], conf)
    spans = PK.line_spans(boxes).collect()
    drawn = np.zeros_like(cover)
    for r in spans:
        assert all(a["to"] < b["from"] for a, b in zip(r.spans, r.spans[1:], strict=False))
        for s in r.spans:
            drawn[r.frame_idx, r.y, s["from"]:s["to"]] = True
    assert (drawn == cover).all()
    words = np.zeros((3, side * side), bool)
    for r in PK.cover_words(boxes, side).collect():
        for i in range(64):
            if r.cover >> i & 1:
                words[r.frame_idx, r.word * 64 + i] = True
    assert (words.reshape(cover.shape) == cover).all()
    cells = spark.range(3 * side * side).select(
        F.lit(1).cast("bigint").alias("video_id"), F.floor(F.col("id") / side**2).alias("frame_idx"), F.floor(F.col("id") % side**2 / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x")
    )
    assert rows(DT.pixels_in_boxes(cells, boxes), "frame_idx", "y", "x") == sorted(map(tuple, np.argwhere(cover).tolist()), key=repr)
    found = DT.confidence_maps(cells, boxes, [0, 2]).collect()
    assert len(found) == 2 * 3 * side**2 and all(r.confidence == best[r.frame_idx, r.cls, r.y, r.x] for r in found)


def test_exclusive_masks_inside_boxes(spark, rng):
    side = 40
    plain, boxes = boxes_of(spark, 9)
    masks = rng.random((3, 4, side * side)) < 0.3
    table = spark.createDataFrame([(1, f, i + 1, masks[f, i].astype(int).tolist()) for f in range(3) for i in range(4)], MASKS)
    cover = np.zeros((3, side, side), bool)
    for _, f, _, x1, y1, x2, y2, *_ in plain:
        cover[f, y1:y2, x1:x2] = True
    m1, m2, m3, m4 = (masks[:, i] for i in range(4))
    a, b = m1 & ~(m2 | m3 | m4) & cover.reshape(3, -1), (m2 | m3) & ~(m1 | m4) & cover.reshape(3, -1)
    words = PX.restricted(PX.exclusive_masks(PK.by_instance(table)), PK.cover_words(boxes, side), ["mask_a", "mask_b"])
    counts = PX.without_empty(words, ["mask_a", "mask_b"])
    assert rows(counts, "frame_idx", "n_mask_a", "n_mask_b", "discarded") == [(f, int(a[f].sum()), int(b[f].sum()), False) for f in range(3)]
    cells = {(r.frame_idx, r.pos): (r.mask_a, r.mask_b) for r in PK.unpacked(words, ["mask_a", "mask_b"]).collect()}
    assert cells == {(f, p): (bool(a[f, p]), bool(b[f, p])) for f in range(3) for p in range(side**2)}


def test_crops_pasted_line_by_line(spark):
    # Crops of another size than their box, one with a missing and one with a repeated cell.
    boxes = spark.createDataFrame([(1, 0, 1, 1, 1, 5, 4, 0.9, 0), (1, 0, 2, 3, 2, 6, 6, 0.9, 0), (1, 9, 3, 0, 0, 2, 2, 0.9, 0)], BOXES)
    crop = {(1, 7, 3, 2): {(y, x): (y + x) % 2 for y in range(3) for x in range(2)}, (2, 7, 2, 3): {(y, x): 1 + y for y in range(2) for x in range(3) if (y, x) != (0, 1)}}
    cells = [(1, 0, d, cls, h, w, y, x, m) for (d, cls, h, w), held in crop.items() for (y, x), m in held.items()] + [(1, 0, 2, 7, 2, 3, 1, 2, 5)]
    table = spark.createDataFrame(cells, "video_id bigint, frame_idx bigint, det_no int, cls int, crop_h int, crop_w int, cy int, cx int, m int")
    frame = spark.createDataFrame([(1, 0, c, y, x) for c in (7, 8) for y in range(7) for x in range(7)], "video_id bigint, frame_idx bigint, cls int, y int, x int")
    want = {(c, y, x): 0 for c in (7, 8) for y in range(7) for x in range(7)}
    for d, (x1, y1, x2, y2) in {1: (1, 1, 5, 4), 2: (3, 2, 6, 6)}.items():
        (key,) = [k for k in crop if k[0] == d]
        _, cls, h, w = key
        for y in range(y1, y2):
            for x in range(x1, x2):
                at = ((y - y1) * h // (y2 - y1), (x - x1) * w // (x2 - x1))
                m = max([crop[key].get(at, 0)] + [5] * (d == 2 and at == (1, 2)))
                want[cls, y, x] = max(want[cls, y, x], m)
    got = {(r.cls, r.y, r.x): r.m for r in DT.pasted_crops(table, boxes, frame).collect()}
    assert got == want


def test_crops_of_other_frames_go_before_they_are_shuffled(spark):
    boxes = spark.createDataFrame([(1, f, 1, 0, 0, 2, 2, 0.9, 0) for f in range(9)], BOXES)
    cells = spark.createDataFrame([(1, f, 1, 7, 1, 1, 0, 0, 1) for f in range(9)], "video_id bigint, frame_idx bigint, det_no int, cls int, crop_h int, crop_w int, cy int, cx int, m int")
    frame = spark.createDataFrame([(1, 0, 7, 0, x) for x in range(3)], "video_id bigint, frame_idx bigint, cls int, y int, x int")
    out = DT.pasted_crops(cells, boxes, frame)
    assert [r.m for r in out.orderBy("x").collect()] == [1, 1, 0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 3  # boxes, crop lines and crop sizes


def test_regions_of_a_large_picture_in_tiles(spark, rng):
    side, step = 700, 128
    picture = rng.random((side, side)) < 0.42  # near the share where regions grow through the whole picture
    picture[350, :] = True  # a region through all tiles, and a spiral of borders
    picture[:, 128] = picture[127, ::2] = True
    tiles = [(1, 0, t, l, min(step, side - t), min(step, side - l), picture[t:t + step, l:l + step].astype(int).ravel().tolist()) for t in range(0, side, step) for l in range(0, side, step)]
    table = spark.createDataFrame([*tiles, (2, 5, 0, 0, 2, 2, [0, 0, 0, 0])], "video_id bigint, frame_idx bigint, top int, left int, h int, w int, mask array<int>")
    got = np.zeros((side, side), np.int64)
    for r in PX.connected_regions_of_tiles(table, side).filter("video_id = 1").collect():
        got[r.top:r.top + r.h, r.left:r.left + r.w] = np.array(r.labels).reshape(r.h, r.w)
    assert (got == PX._label(picture[None])[0]).all()


def test_regions_of_tiles_are_not_broadcast(spark, monkeypatch):
    # Written labels are small on disk and large in memory: a broadcast of them would fill the driver.
    plans = []

    def planned(df, label):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write_through(df, label)

    monkeypatch.setattr(PX, "write_through", planned)
    monkeypatch.setattr(graph, "write_through", planned)
    table = spark.createDataFrame([(1, 0, 0, 0, 1, 2, [1, 1]), (1, 0, 0, 2, 1, 2, [1, 0])], "video_id bigint, frame_idx bigint, top int, left int, h int, w int, mask array<int>")
    out = PX.connected_regions_of_tiles(table, 4)
    assert {r.left: list(r.labels) for r in out.collect()} == {0: [1, 1], 2: [1, 0]}
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
