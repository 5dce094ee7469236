"""Plans: what reaches the scan, what is limited before a shuffle, what never appears."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from filmloom.operators import detections as DT
from filmloom.operators import frames as FR
from filmloom.operators import manifest as M
from filmloom.operators import scenes as S
from filmloom.plans.storage import scratch_path
from filmloom.sources import derived as D
from filmloom.sources import files as FS

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "plan-frames")
    D.frames(spark, FOLDER).withColumn("note", F.lit("unused")).write.parquet(path)
    return spark.read.parquet(path)


def test_frame_bounds_reach_the_scan(stored):
    assert "LessThan(frame_idx,30)" in formatted(FR.capped(stored, 30))
    text = formatted(FR.time_range(stored, 5, 2.4, 19.2))
    assert "GreaterThanOrEqual(frame_idx,12)" in text and "LessThan(frame_idx,96)" in text


def test_scan_reads_only_what_a_step_needs(stored):
    schema = re.findall(r"ReadSchema: (struct<[^\n]*>)", formatted(S.content_scores(stored)))
    assert schema == ["struct<video_id:bigint,frame_idx:bigint,px:array<int>>"]
    assert re.findall(r"ReadSchema: (struct<[^\n]*>)", formatted(FR.frame_counts(stored))) == ["struct<video_id:bigint>"]


def test_listing_does_not_read_contents(spark):
    path = scratch_path(spark, "plan-files")
    spark.range(3).selectExpr("cast(id as string)").write.text(path)
    text = formatted(FS.list_files(spark, path))
    assert "content" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_rank_limits_run_before_the_shuffle(spark):
    local, online = D.manifest_local(spark, FOLDER), D.manifest_online(spark, FOLDER)
    merged = plan_of(M.merge_sheets(local, online))
    assert merged.count("WindowGroupLimit") == 2 and merged.count("Exchange") == 1
    assert plan_of(DT.top_detections(D.detections(spark, FOLDER))).count("WindowGroupLimit") == 2


def test_one_shuffle_serves_all_thumbnail_steps(stored):
    assert plan_of(FR.thumbnails(stored, 10)).count("Exchange") == 2


def test_scores_move_each_frame_once(stored):
    assert plan_of(S.content_scores(stored)).count("Exchange") == 1


def test_placing_pieces_joins_on_equality(spark, stored):
    _, scenes = S.detect(stored)
    plan = plan_of(S.first_enclosing(S.split_long(scenes.drop("scene_id"), 5), scenes))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
