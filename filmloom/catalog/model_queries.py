"""Queries with user functions (ids I1, I4, I7); numpy stand-ins take the model's place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from filmloom.catalog.registry import query
from filmloom.catalog.scene_queries import members, scenes
from filmloom.operators import frames as FR
from filmloom.operators import inference as I
from filmloom.operators import scenes as S
from filmloom.sources import derived as D


def ramp_model():
    """Loads once per worker; here the weights are 0..63."""
    weights = np.arange(64, dtype="float64")
    return lambda batch: batch.astype("float64") @ weights


@query("i1_batched_model", "SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * i)), 6) AS score FROM embeddings")
def i1(spark, sf):
    scored = I.with_prediction(D.table(spark, sf, "embeddings"), "embedding", ramp_model, [64], "score", DoubleType())
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query("i4_scene_fold", """
WITH RECURSIVE item AS (SELECT c.video_id, s.scene_id, c.frame_idx, s.start_frame, CAST(list_sum(f.px) AS BIGINT) AS light FROM cuts c
  JOIN scenes s ON s.video_id = c.video_id AND c.frame_idx >= s.start_frame AND c.frame_idx < s.end_frame JOIN frames f ON f.video_id = c.video_id AND f.frame_idx = c.frame_idx),
fold AS (SELECT video_id, scene_id, frame_idx, light // 2 AS carried FROM item WHERE frame_idx = start_frame
  UNION ALL SELECT i.video_id, i.scene_id, i.frame_idx, (i.light + f.carried) // 2 FROM fold f JOIN item i ON i.video_id = f.video_id AND i.scene_id = f.scene_id AND i.frame_idx = f.frame_idx + 1)
SELECT * FROM fold
""")
def i4(spark, sf):
    frames = D.frames(spark, sf)
    lights = frames.select("video_id", "frame_idx", FR.plane_sum("px").alias("light"))
    rows = FR.with_scene(S.detect(frames)[0]).join(lights, ["video_id", "frame_idx"]).select("video_id", "scene_id", "frame_idx", "light")

    def step(previous, row):
        value = (row["light"] + previous) // 2
        return value, value

    return I.fold_in_order(rows, ["video_id", "scene_id"], "frame_idx", step, 0, "carried", "bigint").drop("light")


@query("i7_grid_model", """
WITH pic AS (SELECT m.video_id, m.scene_id, m.pos, m.pos // 6 AS batch_no, m.n, CAST(list_sum(f.px) AS BIGINT) AS s, f.px FROM members m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.mid_frame),
whole AS (SELECT video_id, scene_id, batch_no, CAST(sum(s) + (6 - count(*)) * arg_max(s, pos) AS BIGINT) AS total FROM pic GROUP BY 1, 2, 3)
SELECT p.video_id, p.scene_id, p.batch_no, p.pos, CAST(i AS INTEGER) AS cell, CAST(p.px[i + 1] + w.total % 7 + i // 8 + 8 * (p.pos % 6 // 2) AS INTEGER) AS v
FROM pic p JOIN whole w ON w.video_id = p.video_id AND w.scene_id = p.scene_id AND w.batch_no = p.batch_no CROSS JOIN range(64) t(i)
""")
def i7(spark, sf):
    """The function sees the whole canvas: it adds the row number on it and a value from all its pixels."""
    pictures = members(scenes(spark, sf)).withColumnRenamed("mid_frame", "frame_idx").join(D.frames(spark, sf), ["video_id", "frame_idx"])
    keys = ["video_id", "scene_id"]

    def shade(canvas):
        return canvas + int(canvas.sum()) % 7 + np.arange(canvas.shape[0])[:, None]

    out = I.map_grids(pictures.select(*keys, "pos", "h", "w", "px"), keys, shade)
    return out.select(*keys, "batch_no", "pos", F.posexplode("px").alias("cell", "v"))
