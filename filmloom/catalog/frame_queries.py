"""Frame queries (ids B26, C4-C6, C10, C12, C13, D5, D16, D20, D23, E11-E18, E20, E21, F5, F6, G4, G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.catalog.file_queries import name_numbers
from filmloom.catalog.registry import query
from filmloom.catalog.scene_queries import members, placed, scenes
from filmloom.functions import color as C
from filmloom.functions import paths as P
from filmloom.operators import batches as B
from filmloom.operators import frames as FR
from filmloom.operators import scenes as S
from filmloom.plans.storage import scratch_path
from filmloom.sources import derived as D

PX_SUM_SQL = "CAST(list_sum(px) AS BIGINT) AS px_sum"


def block(name, size=4096):
    return F.floor(F.col(name) / size)


def summed(df, *extra):
    return df.select("video_id", "frame_idx", *extra, FR.plane_sum("px").alias("px_sum"))


@query("b26_tone_map", """
SELECT video_id, frame_idx, i AS pos, CAST(floor(least(greatest((v - 127.5::DOUBLE) * 1.15::DOUBLE + 127.5::DOUBLE + 255 * 0.02::DOUBLE + 1e-6, 0), 255)) AS INTEGER) AS eq,
       CAST(least(round_even(abs(v * 1.2::DOUBLE + 10), 0), 255) AS INTEGER) AS scaled
FROM (SELECT video_id, frame_idx, CAST(i AS INTEGER) AS i, px[i + 1] AS v FROM frames CROSS JOIN range(64) t(i))
""")
def b26(spark, sf):
    both = F.arrays_zip(FR.tone(F.col("px"), C.eq_tone).alias("eq"), FR.tone(F.col("px"), C.scale_abs).alias("scaled"))
    return D.frames(spark, sf).select("video_id", "frame_idx", F.posexplode(both).alias("pos", "t")).select(
        "video_id", "frame_idx", "pos", "t.eq", "t.scaled"
    )


@query("c4_zip_equal_counts", """
SELECT a.video_id, pos, start_frame, ref_frame FROM
  (SELECT video_id, start_frame, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS pos FROM pieces) a
JOIN (SELECT video_id, mid_frame AS ref_frame, row_number() OVER (PARTITION BY video_id ORDER BY mid_frame) - 1 AS pos FROM members) b USING (video_id, pos)
""")
def c4(spark, sf):
    pieces = placed(scenes(spark, sf))
    clips = pieces.select("video_id", "start_frame")
    refs = S.with_middle(pieces).select("video_id", F.col("mid_frame").alias("ref_frame"))
    return FR.zip_positions(
        clips, refs, ["video_id"], ["start_frame"], ["ref_frame"], [block("start_frame")], [block("ref_frame")], strict=True
    ).select("video_id", "pos", "start_frame", "ref_frame")


@query("c5_zip_to_shorter", """
SELECT pos, file_id, video_id, frame_idx FROM
  (SELECT file_id, row_number() OVER (ORDER BY s, a, file_id) - 1 AS pos FROM (SELECT file_id, coalesce(TRY_CAST(regexp_extract(path, 'Scene_(\\d+)', 1) AS BIGINT), 999) AS s,
     coalesce(TRY_CAST(regexp_extract(path, 'Actor_(\\d+)\\.mp4$', 1) AS BIGINT), 999) AS a FROM files WHERE lower(name) LIKE '%.mp4'))
JOIN (SELECT video_id, frame_idx, row_number() OVER (ORDER BY video_id, frame_idx) - 1 AS pos FROM frames) USING (pos)
""")
def c5(spark, sf):
    actors = D.files(spark, sf).filter(P.has_suffix(F.col("name"), ["mp4"])).select("file_id", *name_numbers())
    refs = D.frames(spark, sf).select("video_id", "frame_idx")
    return FR.zip_positions(
        actors, refs, [], ["scene_num", "actor_num", "file_id"], ["video_id", "frame_idx"],
        [F.col("scene_num"), block("actor_num"), block("file_id")], [F.col("video_id"), block("frame_idx")], strict=False,
    ).select("pos", "file_id", "video_id", "frame_idx")


@query("c6_frame_sync", """
SELECT f.video_id, f.frame_idx, m.inst, CAST(list_sum(f.px) AS BIGINT) AS a, CAST(list_sum(g.px) AS BIGINT) AS b, CAST(list_sum(m.mask) AS BIGINT) AS c
FROM frames f JOIN (SELECT * FROM frames WHERE 5 * frame_idx < 4 * (SELECT count(*) FROM frames n WHERE n.video_id = frames.video_id)) g USING (video_id, frame_idx)
JOIN masks m USING (video_id, frame_idx)
""")
def c6(spark, sf):
    """Whole videos against their first four fifths and all masks."""
    whole = D.frames(spark, sf)
    length = whole.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    shorter = whole.join(length, "video_id").filter(F.col("frame_idx") * 5 < F.col("n") * 4).select("video_id", "frame_idx", F.col("px").alias("other"))
    mask = D.masks(spark, sf).select("video_id", "frame_idx", "inst", "mask")
    return FR.in_sync(whole, shorter, mask).select(
        "video_id", "frame_idx", "inst", FR.plane_sum("px").alias("a"), FR.plane_sum("other").alias("b"), FR.plane_sum("mask").alias("c")
    )


SCENE_OF_SQL = "SELECT c.video_id, c.frame_idx, s.scene_id FROM cuts c JOIN scenes s ON s.video_id = c.video_id AND c.frame_idx >= s.start_frame AND c.frame_idx < s.end_frame"


@query("c10_reference_of_scene", f"""
SELECT o.video_id, o.frame_idx, o.scene_id, m.mid_frame AS ref_frame, CAST(list_sum(f.px) AS BIGINT) AS ref_sum
FROM ({SCENE_OF_SQL}) o JOIN members m ON m.video_id = o.video_id AND m.scene_id = o.scene_id AND m.pos = (m.n - 1) // 2
JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.mid_frame
""")
def c10(spark, sf):
    frames = D.frames(spark, sf)
    cuts, found = S.detect(frames)
    refs = S.lower_middle(members(found)).select("video_id", "scene_id", F.col("mid_frame").alias("frame_idx"))
    pictures = refs.join(frames, ["video_id", "frame_idx"]).select(
        "video_id", "scene_id", F.col("frame_idx").alias("ref_frame"), FR.plane_sum("px").alias("ref_sum")
    )
    return FR.with_reference(FR.with_scene(cuts), pictures).select("video_id", "frame_idx", "scene_id", "ref_frame", "ref_sum")


@query("c12_masked_replace", """
SELECT video_id, frame_idx, CAST(i AS INTEGER) AS pos, CASE WHEN (px[i + 1] + 37) % 11 = 0 OR (px[i + 1] + 74) % 11 = 0 OR (px[i + 1] + 111) % 11 = 0 OR (px[i + 1] + 148) % 11 = 0 THEN px[(i + 5) % 64 + 1] ELSE px[i + 1] END AS v
FROM frames CROSS JOIN range(64) t(i)
""")
def c12(spark, sf):
    target = D.frames(spark, sf)
    source = target.withColumn("px", D.rotated(F.col("px"), 5))
    out = FR.masked_replace(source, target, D.masks(spark, sf))
    return FR.explode_plane(out, "px")


@query("c13_alpha_blend", """
SELECT video_id, frame_idx, CAST(i AS INTEGER) AS pos, CAST(floor(m3 * new + (1 - m3) * floor(m2 * new + (1 - m2) * floor(m1 * new + (1 - m1) * old))) AS INTEGER) AS v
FROM (SELECT video_id, frame_idx, i, CAST(px[i + 1] AS DOUBLE) AS old, CAST(px[(i + 5) % 64 + 1] AS DOUBLE) AS new, (px[i + 1] * 1 % 5) / CAST(4 AS DOUBLE) AS m1,
             (px[i + 1] * 2 % 5) / CAST(4 AS DOUBLE) AS m2, (px[i + 1] * 3 % 5) / CAST(4 AS DOUBLE) AS m3 FROM frames CROSS JOIN range(64) t(i))
""")
def c13(spark, sf):
    base = D.frames(spark, sf)
    overlay = base.withColumn("px", D.rotated(F.col("px"), 5))
    soft = F.array(*[F.struct(F.lit(k).alias("inst"), F.transform("px", lambda v: (v * k % 5) / F.lit(4.0)).alias("mask")) for k in (1, 2, 3)])
    return FR.alpha_blend(base, overlay, base.select("video_id", "frame_idx", F.inline(soft)))


@query("d5_scene_brightness", f"""
SELECT video_id, scene_id, round(brightness, 6) AS brightness, round(dark_share, 6) AS dark_share, brightness <= 55 AND dark_share >= 0.6 AS is_dark FROM (
  SELECT o.video_id, o.scene_id, avg(list_sum(f.px) / CAST(64 AS DOUBLE)) AS brightness, avg(len(list_filter(f.px, lambda v: v < 55)) / CAST(64 AS DOUBLE)) AS dark_share
  FROM ({SCENE_OF_SQL}) o JOIN frames f ON f.video_id = o.video_id AND f.frame_idx = o.frame_idx GROUP BY 1, 2)
""")
def d5(spark, sf):
    frames = D.frames(spark, sf)
    scene_frames = FR.with_scene(S.detect(frames)[0]).join(frames, ["video_id", "frame_idx"])
    return FR.scene_brightness(scene_frames).withColumns({c: F.round(c, 6) for c in ("brightness", "dark_share")})


@query("d16_lab_blend", """
SELECT video_id, frame_idx, CAST(i AS INTEGER) AS pos, CAST((l1 + l2 + l3) // 3 AS INTEGER) AS l,
       CASE WHEN c1 >= c2 AND c1 >= c3 THEN a1 WHEN c2 >= c3 THEN a2 ELSE a3 END AS a, CASE WHEN c1 >= c2 AND c1 >= c3 THEN b1 WHEN c2 >= c3 THEN b2 ELSE b3 END AS b
FROM (SELECT *, (a1 - 128) ** 2 + (b1 - 128) ** 2 AS c1, (a2 - 128) ** 2 + (b2 - 128) ** 2 AS c2, (a3 - 128) ** 2 + (b3 - 128) ** 2 AS c3 FROM (
  SELECT video_id, frame_idx, i, px[(i + 5) % 64 + 1] AS l1, px[(i + 6) % 64 + 1] AS a1, px[(i + 14) % 64 + 1] AS b1, px[(i + 10) % 64 + 1] AS l2, px[(i + 11) % 64 + 1] AS a2,
         px[(i + 19) % 64 + 1] AS b2, px[(i + 15) % 64 + 1] AS l3, px[(i + 16) % 64 + 1] AS a3, px[(i + 24) % 64 + 1] AS b3 FROM frames CROSS JOIN range(64) t(i)))
""")
def d16(spark, sf):
    planes = {f"{p}{s}": D.rotated(F.col("px"), s * 5 + shift) for s in (1, 2, 3) for p, shift in (("l", 0), ("a", 1), ("b", 9))}
    blended = FR.lab_blend(D.frames(spark, sf).withColumns(planes))
    return FR.explode_plane(blended, "lab", name="c").select("video_id", "frame_idx", "pos", "c.l", "c.a", "c.b")


@query("d20_count_fallback", f"""
WITH good AS (SELECT * FROM frames WHERE px[1] >= 60 + 60 * video_id), enough AS (SELECT video_id FROM good GROUP BY 1 HAVING count(*) >= 5)
SELECT video_id, frame_idx, 'restored' AS origin, {PX_SUM_SQL} FROM good WHERE video_id IN (FROM enough)
UNION ALL SELECT video_id, frame_idx, 'original', {PX_SUM_SQL} FROM frames WHERE video_id NOT IN (FROM enough)
""")
def d20(spark, sf):
    whole = D.frames(spark, sf)
    bright = whole.filter(F.col("px")[0] >= F.col("video_id") * 60 + 60).withColumn("origin", F.lit("restored"))
    return summed(FR.with_fallback(bright, whole.withColumn("origin", F.lit("original"))), "origin")


@query("d23_thumbnail_frame", """
SELECT video_id, win, arg_min(frame_idx, e * 100000 + frame_idx) AS frame_idx FROM (
  SELECT video_id, win, frame_idx, CAST(sum((n * c - s) ** 2) AS BIGINT) AS e FROM (
    SELECT f.video_id, f.win, f.frame_idx, t.v, t.s, t.n, count(p.v) AS c FROM (SELECT *, frame_idx // 10 AS win FROM frames) f
    JOIN (SELECT video_id, win, v, count(*) AS s, any_value(n) AS n FROM (SELECT video_id, win, n, unnest(px) AS v FROM (SELECT *, frame_idx // 10 AS win, count(*) OVER (PARTITION BY video_id, frame_idx // 10) AS n FROM frames)) GROUP BY 1, 2, 3) t
      ON t.video_id = f.video_id AND t.win = f.win
    LEFT JOIN (SELECT video_id, frame_idx, unnest(px) AS v FROM frames) p ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx AND p.v = t.v
    GROUP BY ALL) GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def d23(spark, sf):
    return FR.thumbnails(D.frames(spark, sf), 10)


@query("e11_fixed_batches", "SELECT video_id, frame_idx // 16 AS batch_no, min(frame_idx) AS start, max(frame_idx) + 1 AS end FROM frames GROUP BY 1, 2")
def e11(spark, sf):
    return B.batch_bounds(D.frames(spark, sf), ["video_id"], 16, "frame_idx")


@query("e12_overlapping_batches", """
SELECT video_id, scene_id, pos, b AS batch_no, pos - 4 * b AS slot, b = 0 OR pos - 4 * b >= 2 AS is_saved
FROM members JOIN range(0, 1000) t(b) ON 4 * b < n AND pos >= 4 * b AND pos < 4 * b + 6
""")
def e12(spark, sf):
    return B.overlapping_batches(members(scenes(spark, sf))).select("video_id", "scene_id", "pos", "batch_no", "slot", "is_saved")


@query("e13_grid_placement", """
SELECT video_id, slot, slot // 2 AS grid_row, slot % 2 AS grid_col, fw AS fit_w, fh AS fit_h, (slot % 2) * 640 + CAST(floor((640 - fw) / 2) AS BIGINT) AS x, (slot // 2) * 480 + CAST(floor((480 - fh) / 2) AS BIGINT) AS y
FROM (SELECT video_id, video_id % 6 AS slot, CAST(floor(width * k) AS BIGINT) AS fw, CAST(floor(height * k) AS BIGINT) AS fh FROM (SELECT *, least(640 / CAST(width AS DOUBLE), 480 / CAST(height AS DOUBLE)) AS k FROM videos))
""")
def e13(spark, sf):
    slots = D.videos(spark, sf).withColumn("slot", F.col("video_id") % 6)
    cell = (F.lit(640).cast("bigint"), F.lit(480).cast("bigint"))
    return B.placed_on_grid(slots, F.col("width"), F.col("height"), *cell).select(
        "video_id", "slot", "grid_row", "grid_col", "fit_w", "fit_h", "x", "y"
    )


@query("e14_short_batch_fill", """
SELECT b.video_id, b.scene_id, b.batch_no, t.s AS slot, m.mid_frame, t.s >= b.used AS is_fill
FROM (SELECT video_id, scene_id, pos // 6 AS batch_no, count(*) AS used FROM members GROUP BY 1, 2, 3) b CROSS JOIN range(6) t(s)
JOIN members m ON m.video_id = b.video_id AND m.scene_id = b.scene_id AND m.pos = b.batch_no * 6 + least(t.s, b.used - 1)
""")
def e14(spark, sf):
    keys = ["video_id", "scene_id"]
    filled = B.filled_slots(B.fixed_batches(members(scenes(spark, sf)), B.SLOTS), keys)
    return filled.select(*keys, "batch_no", "slot", "mid_frame", "is_fill")


@query("e15_reverse_order", f"SELECT video_id, count(*) OVER (PARTITION BY video_id) - 1 - frame_idx AS frame_idx, {PX_SUM_SQL} FROM frames")
def e15(spark, sf):
    return summed(FR.reversed_frames(D.frames(spark, sf)))


@query("e16_concatenate_groups", """
SELECT video_id, scene_num, idx, row_number() OVER (PARTITION BY video_id ORDER BY scene_num, idx) - 1 AS frame_no FROM (SELECT video_id, 1000 - scene_id AS scene_num, pos AS idx FROM members)
""")
def e16(spark, sf):
    groups = members(scenes(spark, sf)).select("video_id", (F.lit(1000) - F.col("scene_id")).alias("scene_num"), F.col("pos").alias("idx"))
    return FR.concatenated(groups)


@query("e17_equal_chunks", "SELECT video_id, frame_idx, frame_idx // CAST(ceil(count(*) OVER (PARTITION BY video_id) / CAST(8 AS DOUBLE)) AS BIGINT) AS chunk_no FROM frames")
def e17(spark, sf):
    return FR.equal_chunks(D.frames(spark, sf).select("video_id", "frame_idx"), 8)


@query("e18_deflicker", """
SELECT video_id, frame_idx, round(level, 6) AS level, round(level / luma, 6) AS gain FROM (
  SELECT f.video_id, f.frame_idx, any_value(f.luma) AS luma, pow(avg(pow(g.luma, 3)), 1 / CAST(3 AS DOUBLE)) AS level
  FROM (SELECT video_id, frame_idx, list_sum(px) / CAST(64 AS DOUBLE) AS luma, least(greatest(count(*) OVER (PARTITION BY video_id) // 4, 4), 16) AS size FROM frames) f
  JOIN (SELECT video_id, frame_idx, list_sum(px) / CAST(64 AS DOUBLE) AS luma FROM frames) g ON g.video_id = f.video_id AND g.frame_idx >= f.frame_idx AND g.frame_idx < f.frame_idx + f.size
  GROUP BY 1, 2)
""")
def e18(spark, sf):
    return FR.deflicker(D.frames(spark, sf)).select("video_id", "frame_idx", *[F.round(c, 6).alias(c) for c in ("level", "gain")])


GAINED_SQL = """
WITH luma AS (SELECT video_id, frame_idx, px, list_sum(px) / CAST(64 AS DOUBLE) AS luma, least(greatest(count(*) OVER (PARTITION BY video_id) // 4, 4), 16) AS size FROM frames),
gain AS (SELECT f.video_id, f.frame_idx, any_value(f.px) AS px, CASE WHEN any_value(f.luma) > 0 THEN pow(avg(pow(g.luma, 3)), 1 / CAST(3 AS DOUBLE)) / any_value(f.luma) ELSE 1 END AS gain
  FROM luma f JOIN luma g ON g.video_id = f.video_id AND g.frame_idx >= f.frame_idx AND g.frame_idx < f.frame_idx + f.size GROUP BY 1, 2)
SELECT video_id, frame_idx, CAST(list_sum(list_transform(px, lambda v: floor(least(greatest(v * gain + 1e-6, 0), 255)))) AS BIGINT) AS px_sum FROM gain
"""


@query("e18_gained_frames", GAINED_SQL)
def e18_frames(spark, sf):
    frames = D.frames(spark, sf)
    gained = FR.apply_gain(frames, FR.deflicker(frames))
    return gained.select("video_id", "frame_idx", FR.plane_sum("px").alias("px_sum"))


@query("e20_every_kth_frame", f"SELECT video_id, frame_idx, {PX_SUM_SQL} FROM frames WHERE (frame_idx + 1) % 3 = 0")
def e20(spark, sf):
    return summed(FR.every_kth(D.frames(spark, sf), 3))


@query("e21_time_range", "SELECT video_id, frame_idx, frame_idx // 10 AS chunk_no FROM frames WHERE frame_idx >= 12 AND frame_idx < 96")
def e21(spark, sf):
    kept = FR.time_range(D.frames(spark, sf), D.FPS, 2.4, 19.2)
    return FR.time_chunks(kept, D.FPS, 2).select("video_id", "frame_idx", "chunk_no")


@query("f5_frame_cap", f"SELECT video_id, frame_idx, {PX_SUM_SQL} FROM frames WHERE frame_idx < 300")
def f5(spark, sf):
    return summed(FR.capped(D.frames(spark, sf), 300))


@query("f6_ordered_output", f"SELECT video_id, frame_idx, {PX_SUM_SQL} FROM frames")
def f6(spark, sf):
    path = scratch_path(spark, "ordered")
    FR.write_ordered(D.frames(spark, sf), path)
    return summed(spark.read.parquet(path))


@query("g4_random_split", """
SELECT video_id, frame_idx, rn <= floor(n * (1 - 0.95::DOUBLE)) AS is_validation FROM (
  SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY md5('7|' || video_id || '|' || frame_idx), frame_idx) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
""")
def g4(spark, sf):
    return FR.random_split(D.frames(spark, sf).select("video_id", "frame_idx"), 7)


@query("g5_shuffled_batches", """
SELECT video_id, batch_no, start, row_number() OVER (PARTITION BY video_id ORDER BY md5('7|' || video_id || '|' || batch_no), batch_no) - 1 AS new_pos
FROM (SELECT video_id, frame_idx // 8 AS batch_no, min(frame_idx) AS start FROM frames GROUP BY 1, 2)
""")
def g5(spark, sf):
    batches = B.batch_bounds(D.frames(spark, sf), ["video_id"], 8, "frame_idx").drop("end")
    return FR.shuffled_batches(batches, 7)
