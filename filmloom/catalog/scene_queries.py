"""Scene queries (ids C3, C4, C5, C10, D7, E1-E7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.catalog.registry import query
from filmloom.operators import scenes as S
from filmloom.sources import derived as D


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    return S.detect(D.frames(spark, sf))[1]


def placed(found: DataFrame) -> DataFrame:
    """Pieces of at most a second with the scene that holds them."""
    return S.first_enclosing(S.split_long(found.drop("scene_id"), D.FPS), found)


def members(found: DataFrame) -> DataFrame:
    return S.ordered_members(S.with_middle(placed(found)))


@query("e1_content_score", "SELECT * FROM scores")
def e1(spark, sf):
    return S.content_scores(D.frames(spark, sf))


@query("e2_adaptive_cuts", "SELECT video_id, frame_idx, score, round(ratio, 6) AS ratio, is_cut FROM cuts")
def e2(spark, sf):
    return S.detect(D.frames(spark, sf))[0].withColumn("ratio", F.round("ratio", 6))


@query("e3_scene_intervals", "SELECT * FROM scenes")
def e3(spark, sf):
    return scenes(spark, sf)


@query("e4_split_max_length", """
SELECT video_id, scene_id, s AS start_frame, least(s + 5, end_frame) AS end_frame
FROM (SELECT video_id, scene_id, end_frame, unnest(range(start_frame, end_frame, 5)) AS s FROM scenes)
""")
def e4(spark, sf):
    return S.split_long(scenes(spark, sf), D.FPS)


@query("c3_first_enclosing_scene", """
SELECT p.video_id, p.start_frame, p.end_frame, coalesce(min(s.scene_id), 0) AS scene_id
FROM (SELECT video_id, start_frame, end_frame FROM pieces
      UNION ALL SELECT video_id, start_frame + 2, end_frame + 2 FROM pieces) p
LEFT JOIN scenes s ON s.video_id = p.video_id AND p.start_frame >= s.start_frame AND p.end_frame <= s.end_frame
GROUP BY p.video_id, p.start_frame, p.end_frame
""")
def c3(spark, sf):
    found = scenes(spark, sf)
    pieces = S.split_long(found.drop("scene_id"), D.FPS)
    moved = pieces.select("video_id", *[(F.col(c) + 2).alias(c) for c in ("start_frame", "end_frame")])
    return S.first_enclosing(pieces.unionByName(moved).distinct(), found)


@query("e5_piece_middle_frame", """
SELECT p.video_id, p.start_frame, p.end_frame, f.frame_idx, CAST(list_sum(f.px) AS BIGINT) AS px_sum
FROM members p JOIN frames f ON f.video_id = p.video_id AND f.frame_idx = p.mid_frame
""")
def e5(spark, sf):
    pieces = S.split_long(scenes(spark, sf).drop("scene_id"), D.FPS)
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return S.at_middle(pieces, D.frames(spark, sf)).select(
        "video_id", "start_frame", "end_frame", "frame_idx", total.alias("px_sum")
    )


@query("e6_scene_representative", """
SELECT video_id, scene_id, mid_frame AS frame_idx, n AS pieces FROM members WHERE pos = (n - 1) // 2
""")
def e6(spark, sf):
    return S.representatives(D.frames(spark, sf), D.FPS)


@query("e7_reference_rule", """
SELECT video_id, scene_id, CAST(r AS INTEGER) AS ref_no,
       round(CASE WHEN d > 4 THEN CASE r WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN greatest(d / 2 - CAST(0.5 AS DOUBLE), 0) ELSE d - 1 END
            WHEN r = 1 THEN CAST(0 AS DOUBLE) END, 6) AS window_start,
       CASE WHEN d > 4 OR r = 1 THEN NULL WHEN r = 2 THEN n // 2 ELSE n - 1 END AS frame_no
FROM (SELECT *, end_frame - start_frame AS n, (end_frame - start_frame) / CAST(3 AS DOUBLE) AS d FROM scenes) CROSS JOIN range(1, 4) t(r)
""")
def e7(spark, sf):
    return S.reference_frames(scenes(spark, sf), 3).withColumn("window_start", F.round("window_start", 6))


@query("d7_names_per_scene", """
SELECT video_id, scene_id, pos // 1024 AS part, string_agg(printf('Scene-%03d', pos + 1), ',' ORDER BY pos) AS names FROM members GROUP BY 1, 2, 3
""")
def d7(spark, sf):
    return S.named_groups(members(scenes(spark, sf))).withColumn("names", F.array_join("names", ","))
