"""Pixel and detection queries (ids A9, B27-B29, C8, C9, C14, D6, D9-D15, D17-D19, D21, D22, E19, F2, F3, I2, I3, I5, I6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.catalog import color_sql as Q
from filmloom.catalog.registry import RAW_SQL as ORACLES
from filmloom.catalog.registry import query
from filmloom.functions import color as C
from filmloom.operators import detections as DT
from filmloom.operators import frames as FR
from filmloom.operators import packed as PK
from filmloom.operators import pixels as PX
from filmloom.plans.storage import scratch_path, write_through
from filmloom.sources import derived as D

SIDE = D.SIDE
CELL = ["video_id", "frame_idx", "y", "x"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def cell_of(df):
    """Position in a frame to row and column."""
    return df.withColumns({"y": F.floor(F.col("pos") / SIDE).cast("int"), "x": F.col("pos") % SIDE}).drop("pos")


# color

LAB_COLS = "video_id, frame_idx, y, x, b, g, r"


@query("b27_color_spaces", f"""
SELECT {', '.join(LAB_COLS.split(', ')[:4])}, {Q.near('0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')} AS gray,
       round(lab_l / 100, 6) AS l_share, {Q.cut('lab_l / 100 * 255')} AS l_byte, {Q.cut('lab_a + 128')} AS a_byte, {Q.cut('lab_b + 128')} AS b_byte,
       round(least(greatest((lab_a / 128 + 1) / 2, 0), 1), 6) AS a_share, hsv_h, hsv_s, hsv_v
FROM ({Q.hsv('(' + Q.lab('pixels', 'r', 'g', 'b', LAB_COLS) + ')', 'r', 'g', 'b', ('hsv_h', 'hsv_s', 'hsv_v'))})
""")
def b27(spark, sf):
    df = C.with_hsv(C.with_lab(D.pixels(spark, sf)))
    l, a, b = F.col("lab_l"), F.col("lab_a"), F.col("lab_b")
    return df.select(
        *CELL, C.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"), F.round(l / 100.0, 6).alias("l_share"), C.to_byte(l / 100.0 * 255.0).alias("l_byte"),
        C.to_byte(a + 128.0).alias("a_byte"), C.to_byte(b + 128.0).alias("b_byte"),
        F.round(C.clip((a / 128.0 + 1.0) / 2.0, 0.0, 1.0), 6).alias("a_share"), "hsv_h", "hsv_s", "hsv_v",
    )


@query("b28_lab_to_rgb", f"""
SELECT video_id, frame_idx, y, x, {Q.cut('r1 * 255')} AS red, {Q.cut('g1 * 255')} AS green, {Q.cut('b1 * 255')} AS blue
FROM ({Q.rgb("(SELECT *, b / CAST(255 AS DOUBLE) * 100 AS la, (g / CAST(255 AS DOUBLE) * 2 - 1) * 127 AS aa, (r / CAST(255 AS DOUBLE) * 2 - 1) * 127 AS ba FROM pixels)", 'la', 'aa', 'ba', ('r1', 'g1', 'b1'))})
""")
def b28(spark, sf):
    lab = D.pixels(spark, sf).withColumns(
        {"la": F.col("b") / 255.0 * 100.0, "aa": (F.col("g") / 255.0 * 2.0 - 1.0) * 127.0, "ba": (F.col("r") / 255.0 * 2.0 - 1.0) * 127.0}
    )
    out = C.with_rgb_from_lab(lab, "la", "aa", "ba", ("r1", "g1", "b1"))
    return out.select(*CELL, *[C.to_byte(F.col(c) * 255.0).alias(n) for c, n in (("r1", "red"), ("g1", "green"), ("b1", "blue"))])


FINISH_LAB = f"""(SELECT {LAB_COLS}, {Q.near('lab_l * 255 / 100')} * CAST(100 AS DOUBLE) / 255 AS lq,
  greatest({Q.near('lab_a + 128')} - 5, 0) - CAST(128 AS DOUBLE) AS aq, greatest({Q.near('lab_b + 128')} - 10, 0) - CAST(128 AS DOUBLE) AS bq FROM ({Q.lab('pixels', 'r', 'g', 'b', LAB_COLS)}))"""
FINISH_RGB = f"(SELECT video_id, frame_idx, y, x, {Q.near('rr * 255')} AS ra, {Q.near('gg * 255')} AS ga, {Q.near('bb * 255')} AS ba FROM ({Q.rgb(FINISH_LAB, 'lq', 'aq', 'bq', ('rr', 'gg', 'bb'))}))"


def gain_sql(source, r, g, b, s_gain, v_gain):
    hsv = Q.hsv(source, r, g, b, ("h0", "s0", "v0"))
    gained = f"(SELECT *, CAST(floor(least(s0 * {s_gain}::DOUBLE, 255) + 1e-6::DOUBLE) AS INTEGER) AS s1, CAST(floor(least(v0 * {v_gain}::DOUBLE, 255) + 1e-6::DOUBLE) AS INTEGER) AS v1 FROM ({hsv}))"
    return Q.bgr(gained, "h0", "s1", "v1", ("bo", "go", "ro"))


@query("b29_finishing_pass", f"""
SELECT video_id, frame_idx, y, x, {Q.near('abs(bo * 1.2::DOUBLE + 10)')} AS b, {Q.near('abs(go * 1.2::DOUBLE + 10)')} AS g, {Q.near('abs(ro * 1.2::DOUBLE + 10)')} AS r
FROM ({gain_sql(FINISH_RGB, 'ra', 'ga', 'ba', 1.3, 1.1)})
""")
def b29(spark, sf):
    return PX.finished(D.pixels(spark, sf))


@query("b29_saturation_gain", f"SELECT video_id, frame_idx, y, x, bo AS b, go AS g, ro AS r FROM ({gain_sql('pixels', 'r', 'g', 'b', 1.1, 1.1)})")
def b29_gain(spark, sf):
    out = PX.gained(D.pixels(spark, sf), "r", "g", "b", names=("bo", "go", "ro"))
    return out.select(*CELL, F.col("bo").alias("b"), F.col("go").alias("g"), F.col("ro").alias("r"))


@query("d6_color_cast", """
SELECT video_id, frame_idx, round(avg(g), 6) AS mean_a, round(avg(r), 6) AS mean_b, avg(g) > 132 OR avg(r) > 135 AS is_warm FROM pixels GROUP BY 1, 2
""")
def d6(spark, sf):
    return rounded(PX.color_cast(D.pixels(spark, sf).select(*CELL, F.col("g").alias("a"), F.col("r").alias("b"))), "mean_a", "mean_b")


# detections


@query("a9_detection_cache", "SELECT * FROM detections")
def a9(spark, sf):
    return DT.cache_detections(D.detections(spark, sf), scratch_path(spark, "detections"))


@query("c8_blank_masks", """
SELECT f.video_id, f.frame_idx, d.video_id IS NOT NULL AS has_box, CASE WHEN d.video_id IS NULL THEN 64 END AS mask_size
FROM frames f LEFT JOIN (SELECT DISTINCT video_id, frame_idx FROM detections) d ON d.video_id = f.video_id AND d.frame_idx = f.frame_idx
""")
def c8(spark, sf):
    marked = DT.with_blank_masks(D.frames(spark, sf), D.detections(spark, sf))
    return marked.select("video_id", "frame_idx", "has_box", F.when(F.col("mask").isNotNull(), F.size("mask")).alias("mask_size"))


def person_boxes(spark, sf):
    return DT.clamped(DT.confident(D.detections(spark, sf)), SIDE, SIDE, DT.ENLARGE)


PERSON_SQL = """SELECT video_id, frame_idx, det_no, conf, greatest(0, x1 - floor((x2 - x1) * 0.2::DOUBLE)) AS x1, greatest(0, y1 - floor((y2 - y1) * 0.2::DOUBLE)) AS y1,
  least(8, x2 + floor((x2 - x1) * 0.2::DOUBLE)) AS x2, least(8, y2 + floor((y2 - y1) * 0.2::DOUBLE)) AS y2 FROM detections WHERE cls = 0 AND conf >= 0.6"""


@query("c9_pixels_in_boxes", f"""
SELECT * FROM pixels p WHERE EXISTS (SELECT 1 FROM ({PERSON_SQL}) d WHERE d.video_id = p.video_id AND d.frame_idx = p.frame_idx AND p.x >= d.x1 AND p.x < d.x2 AND p.y >= d.y1 AND p.y < d.y2)
""")
def c9(spark, sf):
    return DT.pixels_in_boxes(D.pixels(spark, sf), person_boxes(spark, sf))


@query("c14_crop_paste", """
WITH boxes AS (SELECT *, CAST(1 + det_no % 2 AS INTEGER) AS label FROM detections WHERE x2 > x1 AND y2 > y1)
SELECT p.video_id, p.frame_idx, c.cls, p.y, p.x,
       coalesce(max(((p.y - d.y1) * 2 // (d.y2 - d.y1) * 2 + (p.x - d.x1) * 2 // (d.x2 - d.x1) + d.det_no) % 2), 0) AS m
FROM (SELECT video_id, frame_idx, y, x FROM pixels) p CROSS JOIN (VALUES (1), (2)) c(cls)
LEFT JOIN boxes d ON d.video_id = p.video_id AND d.frame_idx = p.frame_idx AND d.label = c.cls AND p.x >= d.x1 AND p.x < d.x2 AND p.y >= d.y1 AND p.y < d.y2
GROUP BY 1, 2, 3, 4, 5
""")
def c14(spark, sf):
    # Boxes outside all frames cover no pixel; they go before their crops are made, and the rest is written once for both uses.
    boxes = write_through(DT.on_frames(D.detections(spark, sf).filter("x2 > x1 AND y2 > y1"), D.frames(spark, sf)), "boxes")
    label = (F.col("det_no") % 2 + 1).cast("int").alias("cls")
    corners = F.array(*[F.struct(F.lit(y).alias("cy"), F.lit(x).alias("cx")) for y in (0, 1) for x in (0, 1)])
    crops = boxes.select("video_id", "frame_idx", "det_no", label, F.lit(2).alias("crop_h"), F.lit(2).alias("crop_w"), F.inline(corners)).withColumn(
        "m", (F.col("cy") * 2 + F.col("cx") + F.col("det_no")) % 2
    )
    cells = D.pixels(spark, sf).select("video_id", "frame_idx", F.explode(F.array(F.lit(1), F.lit(2))).alias("cls"), "y", "x")
    return DT.pasted_crops(crops, boxes, cells)


@query("d9_confidence_map", """
SELECT p.video_id, p.frame_idx, p.y, p.x, c.cls, coalesce(max(d.conf), CAST(0 AS DOUBLE)) AS confidence
FROM pixels p CROSS JOIN (VALUES (0), (1), (2), (5)) c(cls)
LEFT JOIN detections d ON d.video_id = p.video_id AND d.frame_idx = p.frame_idx AND d.cls = c.cls AND p.x >= d.x1 AND p.x < d.x2 AND p.y >= d.y1 AND p.y < d.y2
GROUP BY 1, 2, 3, 4, 5
""")
def d9(spark, sf):
    return DT.confidence_maps(D.pixels(spark, sf), D.detections(spark, sf), [0, 1, 2, 5])


@query("d10_best_token", """
SELECT id, round(list_max(p), 6) AS score, list_position(p, list_max(p)) - 1 AS token
FROM (SELECT id, list_transform(logits, lambda v: 1 / (1 + exp(-v))) AS p FROM vectors)
WHERE list_max(p) > 0.9 AND len(list_filter(p[2:63], lambda v: v > 0.9)) > 0
""")
def d10(spark, sf):
    return rounded(DT.best_tokens(D.vectors(spark, sf), 0.9, 0.9), "score")


@query("f2_top_then_filter", """
SELECT video_id, frame_idx, det_no, conf, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, det_no DESC) AS rank FROM detections) WHERE rank <= 3 AND cls = 0 AND conf >= 0.6
""")
def f2(spark, sf):
    return DT.top_detections(D.detections(spark, sf)).select("video_id", "frame_idx", "det_no", "conf", "rank")


SHARP_SQL = """SELECT video_id, frame_idx, avg(e * e) - avg(e) * avg(e) AS sharpness FROM (
  SELECT video_id, frame_idx, CAST(px[abs(y - 1) * 8 + x + 1] + px[(7 - abs(7 - (y + 1))) * 8 + x + 1] + px[y * 8 + abs(x - 1) + 1] + px[y * 8 + (7 - abs(7 - (x + 1))) + 1] - 4 * px[y * 8 + x + 1] AS BIGINT) AS e
  FROM frames CROSS JOIN range(8) a(y) CROSS JOIN range(8) b(x)) GROUP BY 1, 2"""


@query("e19_sharpness", f"SELECT video_id, frame_idx, round(sharpness, 6) AS sharpness FROM ({SHARP_SQL})")
def e19(spark, sf):
    return rounded(PX.sharpness(D.frames(spark, sf)), "sharpness")


@query("f3_best_frame", f"""
WITH people AS (SELECT video_id, frame_idx, frame_idx // 5 AS interval_no, (x2 - x1) * (y2 - y1) AS area FROM detections WHERE cls = 0 AND conf >= 0.9),
     best AS (SELECT video_id, interval_no, arg_max(frame_idx, area * CAST(1000000000 AS BIGINT) - frame_idx) AS frame_idx, max(area) AS area FROM people GROUP BY 1, 2),
     sharp AS (SELECT video_id, frame_idx // 5 AS interval_no, arg_max(frame_idx, round(sharpness, 6) * 1000000 - frame_idx / CAST(100000000 AS DOUBLE)) AS frame_idx FROM ({SHARP_SQL}) GROUP BY 1, 2)
SELECT s.video_id, s.interval_no, coalesce(b.frame_idx, s.frame_idx) AS frame_idx, CASE WHEN b.area IS NULL THEN 'sharpness' ELSE 'person' END AS chosen_by, b.area
FROM sharp s LEFT JOIN best b ON b.video_id = s.video_id AND b.interval_no = s.interval_no
""")
def f3(spark, sf):
    return DT.best_frames(D.detections(spark, sf), PX.sharpness(D.frames(spark, sf)), D.FPS, 0.9)


@query("i5_box_rasterizer", "SELECT video_id, frame_idx, det_no, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x FROM (SELECT *, unnest(range(x1, x2)) AS xx FROM (SELECT *, unnest(range(y1, y2)) AS yy FROM detections))")
def i5(spark, sf):
    return DT.rasterized(D.detections(spark, sf).filter("x2 > x1 AND y2 > y1"), ["det_no"])


# masks and regions

ANY_MASK = "((b + 37) % 11 = 0 OR (b + 74) % 11 = 0 OR (b + 111) % 11 = 0 OR (b + 148) % 11 = 0)"
NAMED_SQL = "SELECT video_id, frame_idx, y, x, b, g, r, (b + 37) % 11 = 0 AS m1, (b + 74) % 11 = 0 AS m2, (b + 111) % 11 = 0 AS m3, (b + 148) % 11 = 0 AS m4 FROM pixels"
AB_SQL = f"SELECT video_id, frame_idx, y, x, m1 AND NOT (m2 OR m3 OR m4) AS mask_a, (m2 OR m3) AND NOT (m1 OR m4) AS mask_b FROM ({NAMED_SQL})"
BOXED_SQL = f"""SELECT q.video_id, q.frame_idx, q.y, q.x, mask_a AND k AS mask_a, mask_b AND k AS mask_b FROM (SELECT p.*, EXISTS (SELECT 1 FROM detections d
  WHERE d.video_id = p.video_id AND d.frame_idx = p.frame_idx AND p.x >= d.x1 AND p.x < d.x2 AND p.y >= d.y1 AND p.y < d.y2) AS k FROM ({AB_SQL}) p) q"""


@query("d11_mask_union", f"SELECT video_id, frame_idx, y, x, {ANY_MASK} AS m FROM pixels")
def d11(spark, sf):
    return cell_of(PK.unpacked(PK.united(D.masks(spark, sf)).withColumnRenamed("bits", "m"), ["m"]))


def boxed_masks(spark, sf):
    exclusive = PX.exclusive_masks(PK.by_instance(D.masks(spark, sf)))
    boxes = DT.on_frames(DT.clamped(D.detections(spark, sf), SIDE, SIDE), exclusive)
    return PX.restricted(exclusive, PK.cover_words(boxes, SIDE), ["mask_a", "mask_b"])


@query("d12_exclusive_masks", BOXED_SQL)
def d12(spark, sf):
    return cell_of(PK.unpacked(boxed_masks(spark, sf), ["mask_a", "mask_b"]))


@query("d12_gray_subtract", "SELECT video_id, frame_idx, y, x, greatest(b - (g | r | (255 - b)), 0) AS gray_a, g | r AS gray_b FROM pixels")
def d12_gray(spark, sf):
    named = D.pixels(spark, sf).select(*CELL, F.col("b").alias("g1"), F.col("g").alias("g2"), F.col("r").alias("g3"), (F.lit(255) - F.col("b")).alias("g4"))
    return PX.gray_masks(named).select(*CELL, "gray_a", "gray_b")


@query("d13_empty_masks", f"""
SELECT video_id, frame_idx, count(*) FILTER (mask_a) AS n_mask_a, count(*) FILTER (mask_b) AS n_mask_b, NOT bool_or(mask_a OR mask_b) AS discarded FROM ({BOXED_SQL}) GROUP BY 1, 2
""")
def d13(spark, sf):
    return PX.without_empty(boxed_masks(spark, sf), ["mask_a", "mask_b"])


REGION_SQL = "WITH RECURSIVE cell AS (SELECT video_id, frame_idx, y, x, CAST(y * 8 + x + 1 AS INTEGER) AS id FROM pixels WHERE " + ANY_MASK + """),
reach AS (SELECT video_id, frame_idx, id AS root, y, x FROM cell
  UNION SELECT r.video_id, r.frame_idx, r.root, c.y, c.x FROM reach r JOIN cell c ON c.video_id = r.video_id AND c.frame_idx = r.frame_idx AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
region AS (SELECT video_id, frame_idx, y, x, min(root) AS region FROM reach GROUP BY 1, 2, 3, 4)
"""


def labelled(spark, sf):
    frames = D.frames(spark, sf).withColumn("mask", F.transform("px", lambda v: F.greatest(*[((v + 37 * k) % 11 == 0).cast("int") for k in (1, 2, 3, 4)])))
    return PX.connected_regions(frames)


@query("d14_connected_regions", REGION_SQL + "SELECT p.video_id, p.frame_idx, p.y, p.x, coalesce(region, 0) AS region FROM pixels p LEFT JOIN region q ON q.video_id = p.video_id AND q.frame_idx = p.frame_idx AND q.y = p.y AND q.x = p.x")
def d14(spark, sf):
    return cell_of(FR.explode_plane(labelled(spark, sf), "labels", name="region"))


@query("d14_regions_of_tiles", ORACLES["d14_connected_regions"])
def d14_tiles(spark, sf):
    """The same pictures cut into tiles of 5 x 5 and what is left of them."""
    frames = D.frames(spark, sf).withColumn("mask", F.transform("px", lambda v: F.greatest(*[((v + 37 * k) % 11 == 0).cast("int") for k in (1, 2, 3, 4)])))
    at = F.array(*[F.struct(F.lit(t).alias("top"), F.lit(l).alias("left"), F.lit(min(5, SIDE - t)).alias("th"), F.lit(min(5, SIDE - l)).alias("tw")) for t in (0, 5) for l in (0, 5)])
    cut = frames.select("video_id", "frame_idx", "mask", F.inline(at))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.col("th") - 1), lambda y: F.slice("mask", (F.col("top") + y) * SIDE + F.col("left") + 1, F.col("tw"))))
    tiles = cut.select("video_id", "frame_idx", "top", "left", F.col("th").alias("h"), F.col("tw").alias("w"), rows.alias("mask"))
    cells = PX.connected_regions_of_tiles(tiles, SIDE).select("video_id", "frame_idx", "top", "left", "w", F.posexplode("labels").alias("i", "region"))
    return cells.select(
        "video_id", "frame_idx", (F.col("top") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("left") + F.col("i") % F.col("w")).alias("x"), F.col("region").cast("int").alias("region")
    )


def region_cells(spark, sf):
    """Regions with the picture's chroma (planes 1 and 9) and a donor's (6 and 14)."""
    px = F.col("px")
    planes = F.arrays_zip(
        F.col("labels").alias("region"), D.rotated(px, 1).alias("a"), D.rotated(px, 9).alias("b"), D.rotated(px, 6).alias("new_a"), D.rotated(px, 14).alias("new_b")
    )
    exploded = labelled(spark, sf).select("video_id", "frame_idx", F.posexplode(planes).alias("pos", "c"))
    return cell_of(exploded.select("video_id", "frame_idx", "pos", "c.*"))


DONOR_SQL = """donor AS (SELECT p.video_id, p.frame_idx, p.y, p.x, p.g AS a, p.r AS b, coalesce(q.region, 0) AS region, f.px[(p.y * 8 + p.x + 6) % 64 + 1] AS new_a, f.px[(p.y * 8 + p.x + 14) % 64 + 1] AS new_b
  FROM pixels p JOIN frames f ON f.video_id = p.video_id AND f.frame_idx = p.frame_idx LEFT JOIN region q ON q.video_id = p.video_id AND q.frame_idx = p.frame_idx AND q.y = p.y AND q.x = p.x)"""


@query("d15_region_color_mean", REGION_SQL + f""", {DONOR_SQL}
SELECT video_id, frame_idx, y, x, region, CASE WHEN region > 0 THEN CAST(floor(avg(new_a) OVER k) AS INTEGER) ELSE a END AS a, CASE WHEN region > 0 THEN CAST(floor(avg(new_b) OVER k) AS INTEGER) ELSE b END AS b
FROM donor WINDOW k AS (PARTITION BY video_id, frame_idx, region)
""")
def d15(spark, sf):
    return PX.region_color_transfer(region_cells(spark, sf)).select(*CELL, "region", "a", "b")


@query("d15_region_color_fixed", f"SELECT video_id, frame_idx, y, x, CASE WHEN {ANY_MASK} THEN 128 ELSE g END AS a, CASE WHEN {ANY_MASK} THEN 115 ELSE r END AS b FROM pixels")
def d15_fixed(spark, sf):
    # The neutral a and the cool b of the fixed form.
    return PX.region_color_transfer(region_cells(spark, sf), fixed=(128, 115)).select(*CELL, "a", "b")


# tiles

TILE, STRIDE, FADE = 4, 2, 2
TILED_SQL = """SELECT p.*, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, ty // 2 * 4 + tx // 2 AS tile_no, least(4, 8 - ty) AS th, least(4, 8 - tx) AS tw
FROM pixels p CROSS JOIN range(0, 8, 2) a(ty) CROSS JOIN range(0, 8, 2) b(tx) WHERE p.y >= ty AND p.y < ty + 4 AND p.x >= tx AND p.x < tx + 4"""
WEIGHT_SQL = "CASE WHEN y - ty IN (0, 3) OR x - tx IN (0, 3) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
MERGE_SQL = "SELECT video_id, frame_idx, y, x, round(sum(v * k) / CASE WHEN sum(k) = 0 THEN 1 ELSE sum(k) END, 6) AS v FROM (SELECT *, {weight} AS k FROM ({tiled})) GROUP BY 1, 2, 3, 4"


def tiled(spark, sf):
    return PX.tile_cells(D.pixels(spark, sf), TILE, STRIDE, SIDE, SIDE)


@query("i2_tile_walk", """
SELECT video_id, frame_idx, ty // 3 * 3 + tx // 3 AS tile_no, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST(least(5, 8 - ty) AS INTEGER) AS th, CAST(least(5, 8 - tx) AS INTEGER) AS tw
FROM frames CROSS JOIN range(0, 8, 3) a(ty) CROSS JOIN range(0, 8, 3) b(tx)
""")
def i2(spark, sf):
    return PX.tile_grid(D.frames(spark, sf), 5, 3)


@query("d17_feathered_merge", MERGE_SQL.format(weight=WEIGHT_SQL, tiled=f"SELECT *, b * (1 + tile_no % 3) AS v FROM ({TILED_SQL})"))
def d17(spark, sf):
    scaled = tiled(spark, sf).withColumn("v", (F.col("b") * (F.col("tile_no") % 3 + 1)).cast("double"))
    return rounded(PX.merge_feathered(scaled, TILE, FADE), "v")


@query("d18_strongest_merge", f"""
SELECT video_id, frame_idx, y, x, arg_max(a, m) AS a, arg_max(c, m) AS b FROM (SELECT *, (a * a + c * c) * 1000 - tile_no AS m FROM (SELECT *, b - 100 + tile_no % 5 AS a, g - 100 - tile_no % 3 AS c FROM ({TILED_SQL}))) GROUP BY 1, 2, 3, 4
""")
def d18(spark, sf):
    shifted = tiled(spark, sf).select(*CELL, "tile_no", (F.col("b") - 100 + F.col("tile_no") % 5).alias("a"), (F.col("g") - 100 - F.col("tile_no") % 3).alias("b"))
    return PX.merge_strongest(shifted)


@query("i3_tile_map_merge", MERGE_SQL.format(weight=WEIGHT_SQL, tiled=f"SELECT *, b - avg(b) OVER (PARTITION BY video_id, frame_idx, tile_no) AS v FROM ({TILED_SQL})"))
def i3(spark, sf):
    mapped = PX.map_tiles(D.frames(spark, sf), TILE, STRIDE, lambda grid: grid - grid.mean())
    return rounded(PX.merge_feathered(mapped, TILE, FADE), "v")


@query("d19_area_downscale", "SELECT video_id, frame_idx, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, avg(b) AS v FROM pixels GROUP BY 1, 2, 3, 4")
def d19(spark, sf):
    return PX.block_mean(D.pixels(spark, sf).withColumn("v", F.col("b")), 2)


@query("d21_loss", """
SELECT video_id, frame_idx // 16 AS batch_no, round(avg((abs(g - b) + abs(r - b)) / CAST(2 AS DOUBLE)), 6) AS ab_loss,
       round(avg((abs(g - b) + abs(r - b)) / CAST(2 AS DOUBLE)) * 0.5::DOUBLE + avg(g * g) * 0.25::DOUBLE + avg(abs(r - g)) * 2, 6) AS total_loss FROM pixels GROUP BY 1, 2
""")
def d21(spark, sf):
    batches = D.pixels(spark, sf).select(
        "video_id", F.floor(F.col("frame_idx") / 16).alias("batch_no"), F.col("g").alias("a"), F.col("r").alias("b"), F.col("b").alias("pred_a"), F.col("b").alias("pred_b"),
        (F.col("g") * F.col("g")).alias("second"), F.abs(F.col("r") - F.col("g")).alias("third"),
    )
    out = PX.loss(batches, {"ab_loss": 0.5, "second": 0.25, "third": 2.0})
    return rounded(out, "ab_loss", "total_loss").select("video_id", "batch_no", "ab_loss", "total_loss")


@query("d22_local_contrast", """
WITH hist AS (SELECT video_id, frame_idx, y // 4 AS ty, x // 4 AS tx, b AS v, count(*) AS c FROM pixels GROUP BY ALL),
     tile AS (SELECT video_id, frame_idx, ty, tx, sum(greatest(c - 1, 0)) AS rest FROM hist GROUP BY ALL),
     want AS (SELECT p.video_id, p.frame_idx, p.y, p.x, p.b AS v, least(greatest(ky, 0), 1) AS ty, least(greatest(kx, 0), 1) AS tx,
                     (CASE WHEN j = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN i = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS k
              FROM (SELECT *, CAST(floor(fy) AS BIGINT) + j AS ky, CAST(floor(fx) AS BIGINT) + i AS kx FROM (SELECT *, y / CAST(4 AS DOUBLE) - 0.5::DOUBLE AS fy, x / CAST(4 AS DOUBLE) - 0.5::DOUBLE AS fx FROM pixels) CROSS JOIN range(2) a(j) CROSS JOIN range(2) b(i)) p),
     lut AS (SELECT w.video_id, w.frame_idx, w.y, w.x, w.k, least(round_even((count(h.c) + least(any_value(t.rest), CASE WHEN any_value(t.rest) = 0 THEN 0 ELSE any_value(w.v) // greatest(256 // any_value(t.rest), 1) + 1 END)) * (CAST(255 AS DOUBLE) / 16), 0), 255) AS o
             FROM (SELECT *, row_number() OVER () AS id FROM want) w JOIN tile t ON t.video_id = w.video_id AND t.frame_idx = w.frame_idx AND t.ty = w.ty AND t.tx = w.tx
             LEFT JOIN hist h ON h.video_id = w.video_id AND h.frame_idx = w.frame_idx AND h.ty = w.ty AND h.tx = w.tx AND h.v <= w.v GROUP BY w.id, w.video_id, w.frame_idx, w.y, w.x, w.k)
SELECT video_id, frame_idx, CAST(y * 8 + x AS INTEGER) AS pos, CAST(round_even(sum(k * o), 0) AS INTEGER) AS v FROM lut GROUP BY 1, 2, 3
""")
def d22(spark, sf):
    return FR.explode_plane(PX.local_contrast(D.frames(spark, sf), (2, 2)), "px")


@query("i6_channel_stack", """
SELECT video_id, frame_idx, y, x, b / CAST(255 AS DOUBLE) || ',' || g / CAST(255 AS DOUBLE) || ',' || r / CAST(255 AS DOUBLE) || ',' || CASE WHEN (b + 37) % 4 = 0 THEN '1.0' ELSE '0.0' END AS stack FROM pixels
""")
def i6(spark, sf):
    cells = D.pixels(spark, sf)
    share = {"L": F.col("b"), "A": F.col("g"), "B": F.col("r"), "person": ((F.col("b") + 37) % 4 == 0).cast("int") * 255}
    planes = cells.select(*CELL, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (c / 255.0).alias("v")) for n, c in share.items()])))
    stacked = PX.channel_stack(cells, planes, list(share))
    return stacked.select(*CELL, F.array_join(F.col("stack").cast("array<string>"), ",").alias("stack"))
