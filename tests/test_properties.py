"""Laws that hold for any input."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from filmloom.operators import batches as B
from filmloom.operators import frames as FR
from filmloom.operators import inference as I
from filmloom.operators import pixels as PX
from filmloom.operators import scenes as S
from filmloom.operators import steps as ST
from filmloom.plans.storage import scratch_path


def group(spark, n):
    return spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("pos"))


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 10, 11, 25])
def test_overlapping_batches_save_each_member_once(spark, n):
    batched = B.overlapping_batches(group(spark, n))
    assert rows(batched.filter("is_saved"), "pos") == [(i,) for i in sorted(range(n), key=lambda i: repr((i,)))]
    want = {(b, p - 4 * b) for b in range(n) if 4 * b < n for p in range(4 * b, min(4 * b + 6, n))}
    assert {(r.batch_no, r.slot) for r in batched.collect()} == want


@pytest.mark.parametrize("n", [1, 6, 13])
def test_fixed_batches_cover_each_member_once(spark, n):
    bounds = B.batch_bounds(group(spark, n), ["g"], 6).orderBy("batch_no").collect()
    assert [(r.start, r.end) for r in bounds] == [(s, min(s + 6, n)) for s in range(0, n, 6)]
    assert B.without_fill(B.filled_slots(B.fixed_batches(group(spark, n), 6), ["g"])).count() == n


def test_pieces_tile_their_scene(spark):
    scenes = spark.createDataFrame([(1, 1, 0, 17), (1, 2, 17, 18), (1, 3, 18, 18), (2, 1, 0, 5)], "video_id bigint, scene_id bigint, start_frame bigint, end_frame bigint")
    pieces = S.split_long(scenes, 5)
    assert pieces.filter("end_frame - start_frame > 5 OR end_frame <= start_frame").count() == 0
    frames = pieces.select("video_id", "scene_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("f"))
    assert rows(frames.groupBy("video_id", "scene_id").agg(F.count("f"), F.count_distinct("f"))) == [(1, 1, 17, 17), (1, 2, 1, 1), (2, 1, 5, 5)]


def test_random_split_is_exact_and_complete(spark):
    frames = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(2).alias("video_id"), F.col("id").alias("frame_idx"))
    split = FR.random_split(frames, 5)
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("video_id", "is_validation").count().collect()}
    assert counts == {(1, True): int(700 * (1 - 0.95)), (1, False): 665, (2, True): int(300 * (1 - 0.95)), (2, False): 285}
    assert split.select("frame_idx").distinct().count() == 1000
    assert rows(split) == rows(FR.random_split(frames.repartition(3), 5))
    assert rows(split.filter("is_validation")) != rows(FR.random_split(frames, 6).filter("is_validation"))


def test_shuffle_is_a_permutation(spark):
    batches = spark.range(50).select(F.lit(1).alias("video_id"), F.col("id").alias("batch_no"))
    moved = FR.shuffled_batches(batches, 3)
    assert {r.new_pos for r in moved.collect()} == set(range(50))
    assert any(r.new_pos != r.batch_no for r in moved.collect())


def test_blend_of_equal_sources_changes_nothing(spark):
    planes = {f"{p}{s}": F.array(*[F.lit(v) for v in (0, 100, 255)]) for s in (1, 2, 3) for p in "lab"}
    got = FR.lab_blend(spark.range(1).select(F.lit(1).alias("video_id"), F.lit(0).alias("frame_idx")).withColumns(planes)).first()
    assert [tuple(p) for p in got.lab] == [(v, v, v) for v in (0, 100, 255)]


def test_feathered_merge_of_a_constant(spark):
    cells = spark.range(144).select(F.lit(1).alias("video_id"), F.lit(0).alias("frame_idx"), F.floor(F.col("id") / 12).cast("int").alias("y"), (F.col("id") % 12).cast("int").alias("x"), F.lit(7.0).alias("v"))
    merged = PX.merge_feathered(PX.tile_cells(cells, 6, 3, 12, 12), 6, 2)
    # The outer rim has weight 0 in its only tile, so it stays without a value, as in a plain weighted sum.
    got = {(r.y, r.x): r.v for r in merged.collect()}
    assert len(got) == 144
    assert all(abs(v - 7.0) < 1e-9 for (y, x), v in got.items() if y > 0 and x > 0 and y < 11 and x < 11)


@pytest.mark.parametrize(("tile", "stride"), [(4, 2), (5, 3), (3, 3), (6, 1)])
def test_tile_cells_match_the_tile_walk(spark, tile, stride):
    frames = spark.createDataFrame([(1, 0, 7, 9)], "video_id bigint, frame_idx bigint, h int, w int")
    cells = frames.select("video_id", "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select(
        "video_id", "frame_idx", F.floor(F.col("i") / 9).cast("int").alias("y"), (F.col("i") % 9).alias("x")
    )
    by_cell = PX.tile_cells(cells, tile, stride, 7, 9).groupBy("tile_no", "ty", "tx", "th", "tw").count()
    walk = PX.tile_grid(frames, tile, stride).select("tile_no", "ty", "tx", "th", "tw", (F.col("th") * F.col("tw")).alias("count"))
    assert rows(by_cell) == rows(walk)


def numpy_equalized(px, grid, clip):
    """The published algorithm, step by step."""
    h, w = px.shape
    gy, gx = grid
    picture = px
    if h % gy or w % gx:
        px = np.pad(px, ((0, gy - h % gy), (0, gx - w % gx)), mode="reflect")
    th, tw = px.shape[0] // gy, px.shape[1] // gx
    limit = max(int(clip * th * tw / 256), 1)
    tables = {}
    for ty in range(gy):
        for tx in range(gx):
            hist = np.bincount(px[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + excess // 256
            rest = excess % 256
            if rest:
                hist[:: max(256 // rest, 1)][:rest] += 1
            tables[ty, tx] = np.minimum(np.rint(np.cumsum(hist) * (255.0 / (th * tw))), 255)
    px = picture
    out = np.zeros_like(px)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            ty, tx = int(np.floor(fy)), int(np.floor(fx))
            wy, wx = fy - ty, fx - tx

            def at(a, b, v=px[y, x]):
                return tables[min(max(a, 0), gy - 1), min(max(b, 0), gx - 1)][v]

            upper = at(ty, tx) * (1 - wx) + at(ty, tx + 1) * wx
            lower = at(ty + 1, tx) * (1 - wx) + at(ty + 1, tx + 1) * wx
            out[y, x] = np.rint(upper * (1 - wy) + lower * wy)
    return out


@pytest.mark.parametrize(("sides", "grid", "clip"), [((16, 16), (2, 2), 2.0), ((64, 64), (2, 4), 2.0), ((64, 64), (1, 1), 40.0), ((5, 7), (2, 2), 2.0), ((33, 40), (4, 8), 2.0), ((9, 12), (4, 3), 3.0)])
def test_local_contrast_against_the_published_steps(spark, sides, grid, clip):
    px = np.random.default_rng(sum(sides)).integers(0, 256, sides) // 3
    data = [(1, 0, *sides, px.ravel().tolist())]
    frames = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, h int, w int, px array<int>")
    got = np.asarray(PX.local_contrast(frames, grid, clip).first().px).reshape(sides)
    assert np.array_equal(got, numpy_equalized(px, grid, clip))


def test_thumbnail_against_numpy(spark):
    planes = np.random.default_rng(1).integers(0, 6, (23, 12))
    frames = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(planes)], "video_id bigint, frame_idx bigint, px array<int>")
    want = []
    for start in range(0, 23, 5):
        hists = np.array([np.bincount(p, minlength=256) for p in planes[start : start + 5]], dtype=float)
        want.append((1, start // 5, start + int(((hists - hists.mean(0)) ** 2).sum(1).round(9).argmin())))
    assert rows(FR.thumbnails(frames, 5), "video_id", "win", "frame_idx") == sorted(want, key=repr)


def test_sharpness_against_numpy(spark):
    px = np.random.default_rng(2).integers(0, 256, (5, 7))
    p = np.pad(px, 1, mode="reflect")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * px
    frames = spark.createDataFrame([(1, 0, 5, 7, px.ravel().tolist())], "video_id bigint, frame_idx bigint, h int, w int, px array<int>")
    assert abs(PX.sharpness(frames).first().sharpness - edges.var()) < 1e-6


def test_fold_keeps_order_in_every_key(spark):
    data = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), (F.col("id") * 7919 % 5003).alias("t"))
    out = I.fold_in_order(data, ["k"], "t", lambda s, r: ((s * 31 + r["t"]) % 1009,) * 2, 1, "h", "bigint")
    want = {}
    for k, t in sorted((r.k, r.t) for r in data.collect()):
        want.setdefault(k, [1]).append((want.get(k, [1])[-1] * 31 + t) % 1009)
    got = {}
    for r in out.orderBy("k", "t").collect():
        got.setdefault(r.k, [1]).append(r.h)
    assert got == want


def test_grid_function_sees_one_canvas_and_members_come_back(spark):
    members = spark.createDataFrame([(1, i, 2, 3, [i * 10 + c for c in range(6)]) for i in range(8)], "g bigint, pos bigint, h int, w int, px array<int>")
    shapes = I.map_grids(members, ["g"], lambda canvas: np.full_like(canvas, canvas.shape[0] * 100 + canvas.shape[1]))
    assert {v for r in shapes.collect() for v in r.px} == {606}
    same = I.map_grids(members, ["g"], lambda canvas: canvas)
    assert rows(same, "pos", "px") == rows(members, "pos", "px")


def test_step_goes_on_where_it_stopped(spark):
    path, calls = scratch_path(spark, "resume"), []

    def step(todo):
        calls.append(todo.count())
        return todo.withColumn("done", F.lit(True))

    items = spark.range(10).select(F.col("id").cast("string").alias("key"))
    ST.run_step(items.filter("key < '4'"), step, path, "key")
    out = ST.run_step(items, step, path, "key")
    assert calls == [4, 6] and out.count() == 10
    assert ST.run_step(items, step, path, "key").count() == 10 and calls[-1] == 0


def test_deflicker_leaves_an_even_video_alone(spark):
    frames = spark.createDataFrame([(1, i, [50, 70]) for i in range(40)], "video_id bigint, frame_idx bigint, px array<int>")
    gains = FR.deflicker(frames, segment=16)
    assert all(abs(r.gain - 1) < 1e-9 for r in gains.collect())
    assert rows(FR.apply_gain(frames, gains), "px") == rows(frames, "px")


def test_reverse_twice_is_the_video(spark):
    frames = spark.createDataFrame([(v, i, [i]) for v in (1, 2) for i in range(5 + v)], "video_id bigint, frame_idx bigint, px array<int>")
    assert rows(FR.reversed_frames(FR.reversed_frames(frames)), *frames.columns) == rows(frames)
