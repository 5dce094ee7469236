"""Streams replayed in several micro-batches against the batch result; late rows; restart."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from filmloom.operators import logs as L
from filmloom.plans.storage import scratch_path
from filmloom.sources import logs as SL
from filmloom.streaming import jobs as SJ
from filmloom.streaming import requests as SR
from filmloom.streaming import sinks
from filmloom.streaming import telemetry as ST

SECOND = 1_000_000


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Each partition of a keyed state starts a Python worker in each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


LOG = "job_id bigint, line_no bigint, ts_us bigint, line string"


def feed(spark, parts, schema):
    """Write each part as one file of a folder, in order, and read the folder one file at a time."""
    folder = scratch_path(spark, "feed")
    for i, part in enumerate(parts):
        add(spark, folder, part, schema, i)
    return folder


def add(spark, folder, part, schema, number):
    staged = f"{folder}-{number}"
    spark.createDataFrame(part, schema).coalesce(1).write.parquet(staged)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    (file,) = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(staged)) if f.getPath().getName().endswith(".parquet")]
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    fs.rename(file, jvm.org.apache.hadoop.fs.Path(f"{folder}/log-{number:03d}.parquet"))


def stream(spark, folder, schema):
    empty = spark.createDataFrame([], schema)
    return SL.stream_table(spark, folder, "log", empty.schema, files_per_trigger=1)


def expected(events, stall=10):
    state, out = {}, []
    for job, line_no, ts, kind, progress, code in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        now, refused = SJ.advance(state.get(job), kind, ts, progress, code, stall * SECOND)
        state[job] = now
        out.append((job, line_no, now[0], now[1], refused))
    return sorted(out, key=repr)


def tracked(spark, events, error=False, **how):
    ticks = sinks.Ticks(spark)
    out = sinks.drain(SJ.track(events, ticks=ticks.stream(), **how), "replay", ticks=ticks)
    return out if error else out.drop("error")


LINES = [
    (1, 0, 0, "start"), (1, 1, 5 * SECOND, "Progress: 20%"), (1, 2, 12 * SECOND, "x"), (1, 3, 16 * SECOND, "x"),
    (1, 4, 17 * SECOND, "x"), (1, 5, 40 * SECOND, "Task 4/5"), (2, 6, 0, "Progress: 99%"), (2, 7, 30 * SECOND, "x"),
    (3, 8, 1, "a"), (3, 9, 2, "b"),
]


def as_events(lines):
    found = {"Progress: 20%": 20, "Task 4/5": 80, "Progress: 99%": 95}
    return [(j, n, t, "line", found.get(l), 0) for j, n, t, l in lines]


def test_stall_bump_over_micro_batches(spark):
    parts = [LINES[:3] + LINES[6:7], LINES[3:5] + LINES[8:9], LINES[5:6] + LINES[7:8] + LINES[9:]]
    out = tracked(spark, SJ.events_of(stream(spark, feed(spark, parts, LOG), LOG)))
    assert rows(out) == expected(as_events(LINES))
    progress = {r.line_no: r.progress for r in out.collect()}
    assert [progress[i] for i in range(6)] == [5, 20, 20, 21, 21, 80]
    assert progress[6] == 95 and progress[7] == 95


def test_batch_jobs_wait_longer_before_a_bump(spark):
    lines = [(1, 0, 0, "a"), (1, 1, 12 * SECOND, "b"), (1, 2, 16 * SECOND, "c")]
    out = tracked(spark, SJ.events_of(stream(spark, feed(spark, [lines], LOG), LOG)), stall_seconds=SJ.BATCH_STALL_SECONDS)
    assert rows(out, "line_no", "progress") == [(0, 5), (1, 5), (2, 6)]


def test_finished_jobs_stay_and_refuse_cancel():
    stall = 10 * SECOND
    done, refused = SJ.advance(("running", 40, 0), "exit", 1, None, 0, stall)
    assert done == ("completed", 100, 1) and not refused
    assert SJ.advance(done, "cancel", 2, None, 0, stall) == (done, True)
    assert SJ.advance(done, "line", 2, 7, 0, stall) == (done, False)
    assert SJ.advance(("running", 40, 0), "exit", 1, None, 3, stall)[0] == ("failed", 40, 1)
    assert SJ.advance(("running", 40, 0), "cancel", 1, None, 0, stall) == (("cancelled", 0, 1), False)
    assert SJ.advance(("running", 90, 0), "line", 99 * SECOND, None, 0, stall)[0] == ("running", 90, 0)


EVENTS = "job_id bigint, line_no bigint, ts_us bigint, kind string, progress bigint, code bigint"


def life(n=120):
    """Two jobs, one with nine tenths of the events: created, started, lines with pauses, exits and cancels."""
    kinds = ["created", "started", "line", "line", "line", "line", "exit", "cancel"]
    out = []
    for i in range(n):
        job = 1 if i % 10 else 2
        kind = kinds[0] if i < 11 else kinds[2 + i * 7 % 4] if i < n - 12 else kinds[i * 5 % 8]
        out.append((job, i, i * SECOND + (i // 20) * 11 * SECOND, kind, i % 90 if i % 9 == 4 else None, i % 2 * 3))
    return out


@pytest.mark.parametrize("files", [1, 3, 20])
def test_job_states_do_not_depend_on_micro_batches(spark, files):
    # Shuffled inside the watermark: each file's events come in any order, and neighbouring files overlap.
    events = life()
    late = sorted(events, key=lambda e: e[1] + e[1] * 7919 % 13)
    size = -(-len(late) // files)
    parts = [late[i:i + size][::-1] for i in range(0, len(late), size)]
    out = tracked(spark, stream(spark, feed(spark, parts, EVENTS), EVENTS))
    assert rows(out) == expected(events)


def test_many_waiting_events_of_a_job_are_kept_by_slot(spark):
    # More than one packed value holds; equal times are ordered by line number.
    n = 3 * SJ.FEW
    events = [(1, i, (i // 7) * 40_000, "line", i % 97 if i % 50 == 0 else None, 0) for i in range(n)]
    parts = [events[n // 2:][::-1], events[: n // 2]]
    out = tracked(spark, stream(spark, feed(spark, parts, EVENTS), EVENTS), delay="10 minutes")
    assert rows(out) == expected(events)


def test_many_jobs_share_rows_of_state(spark):
    # A call of the state store for each job took longer than its events.
    n = 5 * SJ.GROUPS
    events = [(i, i, i, "line", i % 97, 0) for i in range(n)]
    states = SJ.track(stream(spark, feed(spark, [events], EVENTS), EVENTS))
    root = scratch_path(spark, "groups")
    query = sinks.start(states, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) < n


@pytest.mark.parametrize("files", [1, 4])
def test_subscribers_and_jobs_as_two_streams(spark, files):
    events = [(*e[:3], "exit", None, 3) if e[1] == 45 else e for e in life(60)]
    joins = [(10 + i, 1 if i % 3 else 2, i * 9 * SECOND) for i in range(12)] + [(90, 7, 5 * SECOND)]
    want = []
    for job in (1, 2, 7):
        now, error, there = None, None, []
        steps = [(e[2], 0, e[1], e) for e in events if e[0] == job] + [(at, 1, s, None) for s, j, at in joins if j == job]
        for ts, _, n, event in sorted(steps, key=lambda x: x[:3]):
            if event is None:
                want.append((job, n, -1, "hello", *(now[:2] if now else ("pending", 0)), error))
                there.append(n)
                continue
            was, (now, _) = now, SJ.advance(now, event[3], ts, event[4], event[5], 10 * SECOND)
            turned = was is None or was[0] != now[0]
            if turned and now[0] == "failed":
                error = f"{SJ.FAILURE}{event[5]}"
            kinds = ["progress"] * (was is None or was[1] != now[1]) + ["status"] * turned + ["error"] * (turned and error is not None)
            want += [(job, s, n, k, now[0], now[1], error if k == "error" else None) for s in there for k in kinds]
    ticks = sinks.Ticks(spark)
    cut = [events[i::files] for i in range(files)]
    told = stream(spark, feed(spark, cut, EVENTS), EVENTS)
    asks = "subscriber_id bigint, job_id bigint, joined_us bigint"
    asked = stream(spark, feed(spark, [joins[i::files][::-1] for i in range(files)], asks), asks)
    out = sinks.drain(SJ.broadcast_messages(told, asked, delay="10 minutes", ticks=ticks.stream()), "told", ticks=ticks)
    assert rows(out) == sorted(want, key=repr)
    assert {"hello", "progress", "status", "error"} == {r[3] for r in want}


def test_pending_started_failed_and_forgotten(spark):
    hour = 3600 * SECOND
    events = [
        (1, 0, 0, "created", None, 0), (1, 1, 1, "created", None, 0), (1, 2, 2, "started", None, 0), (1, 3, 3, "line", 40, 0), (1, 4, 4, "started", None, 0), (1, 5, 5, "exit", None, 3),
        (1, 6, 6, "cancel", None, 0), (2, 7, 7, "created", None, 0), (2, 8, 8, "cancel", None, 0), (3, 9, 9, "created", None, 0), (3, 10, 10, "line", None, 0),
    ]
    later = [(1, 20, 30 * hour, "line", None, 0), (4, 21, 31 * hour, "line", 7, 0), (4, 22, 32 * hour, "line", 7, 0), (1, 23, 40 * hour, "cancel", None, 0)]
    parts = [events, later[1:2], later[2:3], later[3:]]
    out = tracked(spark, stream(spark, feed(spark, parts, EVENTS), EVENTS), error=True)
    got = {r.line_no: (r.status, r.progress, r.refused, r.error) for r in out.collect()}
    failed = f"{SJ.FAILURE}3"
    assert [got[i] for i in range(7)] == [
        ("pending", 0, False, None), ("pending", 0, False, None), ("running", 5, False, None), ("running", 40, False, None), ("running", 40, False, None),
        ("failed", 40, False, failed), ("failed", 40, True, failed),
    ]
    assert [got[i][:2] for i in range(7, 11)] == [("pending", 0), ("cancelled", 0), ("pending", 0), ("running", 5)]
    assert got[23] == ("cancelled", 0, False, None)  # a day after its end the job is not known any more


def test_restart_continues_from_the_checkpoint(spark):
    folder = feed(spark, [LINES[:4]], LOG)
    root, ticks = scratch_path(spark, "restart"), sinks.Ticks(spark)

    def run():
        states = SJ.track(SJ.events_of(stream(spark, folder, LOG)), ticks=ticks.stream()).drop("error")
        sinks.start(states, f"{root}/out", f"{root}/checkpoint").awaitTermination()

    run()
    add(spark, folder, LINES[4:], LOG, 1)
    run()
    ticks.close()
    run()
    assert rows(spark.read.parquet(f"{root}/out")) == expected(as_events(LINES))


def test_update_sink_keeps_the_newest_row(spark):
    parts = [[(1, 0, 5, "a"), (2, 1, 6, "b")], [(1, 2, 9, "c")], [(1, 3, 7, "d")]]
    table = sinks.drain(ST.growing_logs(stream(spark, feed(spark, parts, LOG), LOG)), "growth", "update")
    assert rows(sinks.latest(table, ["job_id"]), "job_id", "n_lines", "updated_us") == [(1, 3, 9), (2, 1, 6)]


def test_late_sample_is_dropped_and_windows_keep_the_first(spark):
    parts = [[(1, 0, 1 * SECOND, "aa"), (1, 1, 2 * SECOND, "b")], [(1, 2, 300 * SECOND, "ccc")], [(1, 3, 301 * SECOND, "dddd")], [(1, 4, 0, "late")]]
    samples = ST.timed(stream(spark, feed(spark, parts, LOG), LOG)).select(
        F.lit(0).alias("node_id"), "at", F.col("line_no").alias("seq"), F.length("line").alias("value")
    )
    table = sinks.drain(ST.throttled(samples, ["node_id"]), "late", "update")
    assert rows(sinks.latest(table, ["node_id", "window_us"]), "window_us", "seq", "value") == [(0, 0, 2), (300 * SECOND, 2, 3)]


def test_deadline_on_two_streams(spark):
    asks = "prompt_id bigint, req_us bigint"
    answers = "prompt_id bigint, resp_us bigint, filename string"
    day = 86_400 * SECOND  # a stream starts with its watermark at the epoch
    # The last rows only move the watermark past the deadlines.
    a = feed(spark, [[(1, day), (2, day), (3, day)], [(99, day + 5000 * SECOND)], [(100, day + 5001 * SECOND)]], asks)
    b = feed(spark, [[(1, day + 600 * SECOND, "x"), (2, day + 601 * SECOND, "late")], [(98, day + 5000 * SECOND, "y")], [(97, day + 5001 * SECOND, "z")]], answers)
    asked = stream(spark, a, asks).withColumn("req_at", F.timestamp_micros("req_us"))
    given = stream(spark, b, answers).withColumn("resp_at", F.timestamp_micros("resp_us"))
    out = sinks.drain(SR.with_deadline(asked, given), "deadline").filter("prompt_id < 90")
    assert rows(out, "prompt_id", "filename", "timed_out") == [(1, "x", False), (2, None, True), (3, None, True)]


def test_duplicates_over_micro_batches(spark):
    answers = "prompt_id bigint, resp_us bigint, filename string"
    parts = [[(1, 1, "a"), (1, 2, "a")], [(1, 3, "a"), (1, 4, "b")]]
    given = stream(spark, feed(spark, parts, answers), answers).withColumn("resp_at", F.timestamp_micros("resp_us"))
    out = sinks.drain(SR.unique_outputs(given, ["prompt_id", "filename"]), "unique")
    assert rows(out, "filename") == [("a",), ("b",)]


def test_state_is_written_without_a_read_for_each_row(spark, monkeypatch):
    names = ["spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"]
    before, seen = [spark.conf.get(n, None) for n in names], []
    monkeypatch.setattr(sinks, "_start", lambda *_: seen.extend(spark.conf.get(n, None) for n in names))
    sinks.start(spark.range(1), "", "")
    assert seen == ["false", "true"] and [spark.conf.get(n, None) for n in names] == before


@pytest.mark.parametrize("present", [["clothes"], ["arms", "clothes", "faces", "neck"]])
def test_completeness(spark, present):
    df = spark.createDataFrame([(1, p) for p in present + present], "prompt_id bigint, part string")
    row = SR.completeness(df).first()
    assert row.is_complete == (len(present) == 4)
    assert row.missing == ",".join(sorted(set(SR.PARTS) - set(present)))


@pytest.mark.parametrize("files", [1, 3, 20])
def test_latest_state_does_not_depend_on_micro_batches(spark, files):
    texts = ["a", "[INFO] Running restoration...", "Progress: 37%", "[INFO] Starting scene detection for: x", "final video at: out.mp4", "b"]
    lines = [(job, n, n * SECOND, texts[(n + job) % 6]) for job in (1, 2, 3) for n in range(20)]
    mixed = [lines[(i * 37) % 60] for i in range(60)]
    parts = [mixed[i::files] for i in range(files)]
    batch = spark.createDataFrame(lines, LOG)
    got = sinks.latest(sinks.drain(L.latest_states(stream(spark, feed(spark, parts, LOG), LOG)), "states", "update"), ["job_id"])
    want = L.latest_states(batch)
    assert rows(got, *want.columns) == rows(want)


def test_snapshot_is_carried_over_hours(spark):
    hour = 3600 * SECOND
    log = spark.createDataFrame([(1, 0, 0, "5%"), (1, 1, 3 * hour, "20%"), (1, 2, 3 * hour + 5, "x"), (1, 3, 9 * hour, "50%"), (2, 4, 1, "7%")], LOG)
    joined = [(10, 1, 5 * hour), (11, 1, 3 * hour), (12, 1, 3 * hour - 1), (13, 1, 9 * hour + 1), (14, 3, 0), (15, 2, 0)]
    got = L.snapshots_and_updates(spark.createDataFrame(joined, "subscriber_id bigint, job_id bigint, joined_us bigint"), log)
    want = [(10, "hello", 20), (10, "progress", 50), (11, "hello", 20), (11, "progress", 50), (12, "hello", 5), (12, "progress", 20), (12, "progress", 50), (13, "hello", 50), (14, "hello", 0), (15, "hello", 0), (15, "progress", 7)]
    assert rows(got, "subscriber_id", "type", "progress") == sorted(want, key=repr)
