"""Versioned tables, growing files and exact draws."""

from __future__ import annotations

import hashlib
import os
import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from filmloom.operators import frames as FR
from filmloom.operators import steps as ST
from filmloom.plans import versions
from filmloom.plans.storage import scratch_path
from filmloom.sources import manifest_csv as CSV
from filmloom.sources.growing_files import GrowingLines
from filmloom.streaming import sinks


def manifest(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "a string")


def test_a_lost_writer_leaves_the_old_manifest(spark, monkeypatch):
    path = scratch_path(spark, "versions")
    CSV.replace_manifest(manifest(spark, "x", "y"), path)
    # Lost after its data, after its claim, and while it writes.
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        CSV.replace_manifest(manifest(spark, "z"), path)
    monkeypatch.undo()
    assert rows(CSV.read_manifest(spark, path)) == [("x",), ("y",)]
    broken = manifest(spark, "1").select(F.raise_error(F.lit("lost")).cast("string").alias("a"))
    with pytest.raises(Exception, match="lost"):
        CSV.replace_manifest(broken, path)
    assert rows(CSV.read_manifest(spark, path)) == [("x",), ("y",)]
    at, fs = versions._at(spark, f"{path}/_versions/claim-00000002")
    assert versions._created(fs, at) and not versions._created(fs, at)
    with pytest.raises(versions.ConcurrentWrite):
        CSV.replace_manifest(manifest(spark, "z"), path)
    monkeypatch.setattr(versions, "CLAIM_SECONDS", -1)  # the claim's writer is given up
    CSV.replace_manifest(CSV.read_manifest(spark, path).unionAll(manifest(spark, "w")), path)
    assert rows(CSV.read_manifest(spark, path)) == [("w",), ("x",), ("y",)]
    assert len(versions.expire(spark, path, keep=1)) == 1 and CSV.read_manifest(spark, path).count() == 3


def test_two_writers_of_one_version(spark):
    path = scratch_path(spark, "writers")
    items = spark.createDataFrame([(str(i),) for i in range(6)], "key string")

    def step(todo):
        return todo.withColumn("out", F.concat(F.lit("o"), "key"))

    ST.run_step(items.filter("key < '2'"), step, path, "key")

    def interrupted(todo):
        ST.run_step(items, step, path, "key")  # another run begins and ends meanwhile
        return step(todo)

    with pytest.raises(versions.ConcurrentWrite):
        ST.run_step(items, interrupted, path, "key")
    out = spark.read.parquet(*versions.resolve(spark, path))
    assert rows(out) == [(str(i), f"o{i}") for i in range(6)]


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_lines_of_files_that_grow(spark, part):
    folder = tempfile.mkdtemp(prefix="run-")
    os.mkdir(f"{folder}/sub")
    one, two = f"{folder}/job1.log", f"{folder}/sub/job2.log"
    steps = [
        {one: b"first\nsec", two: b""}, {one: b"ond\n", two: "ä line\r\n\n".encode()}, {one: b"", two: b"no end "}, {one: b"x" * 50 + b"\nlast\n", two: b"yet\nopen"}
    ]
    spark.dataSource.register(GrowingLines)
    root = scratch_path(spark, "grow")
    for step in steps:
        for path, text in step.items():
            with open(path, "ab") as file:
                file.write(text)
        lines = spark.readStream.format("growing_lines").option("partBytes", part).load(folder)
        sinks.start(lines, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    whole = {"job1": b"".join(s[one] for s in steps), "job2": b"".join(s[two] for s in steps)}
    want = []
    for job, text in whole.items():
        at = 0
        for line in text.split(b"\n")[:-1]:
            want.append((job, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    assert rows(spark.read.parquet(f"{root}/out"), "job_id", "line_at", "line") == sorted(want, key=repr)


@pytest.mark.parametrize("ratio", [0.95, 0.5, 1.0, 0.0])
def test_exact_split_without_ranking_all(spark, ratio):
    frames = [(v, i) for v, n in ((1, 300), (2, 1), (3, 40), (None, 21)) for i in range(n)]
    table = spark.createDataFrame(frames, "video_id bigint, frame_idx bigint")
    out = FR.random_split(table, 7, ratio)
    want = []
    for video in {v for v, _ in frames}:
        draw = sorted((hashlib.md5("|".join(str(x) for x in (7, video, i) if x is not None).encode()).hexdigest(), i) for v, i in frames if v == video)
        chosen = {i for _, i in draw[: int(len(draw) * (1 - ratio))]}
        want += [(video, i, i in chosen) for _, i in draw]
    assert rows(out) == sorted(want, key=repr)
