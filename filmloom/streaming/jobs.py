"""Job state over a stream of lines, exits and commands, one state per job, in the order of event time.

The state store keeps jobs in groups by hash, as each call of it from Python costs more than many events do.

Events: ``job_id, line_no, ts_us, kind, progress, code`` with kind ``created``, ``started``, ``line``, ``exit`` or
``cancel``. ``progress`` is parsed before the state function, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from filmloom.functions import progress as PR
from filmloom.streaming.telemetry import DEFAULT_DELAY

# First progress, silence before a bump (single and batch jobs), bump ceiling, text of a failure.
FIRST_PROGRESS = 5
STALL_SECONDS = 10
BATCH_STALL_SECONDS = 15
STALL_CEILING = 90
FAILURE = "Pipeline failed with exit code "

ENDED = ("completed", "failed", "cancelled")
SLOT_SECONDS = 10  # events wait and are released by slots of event time
FEW = 32_768  # waiting events of a group of jobs that are kept as one value, and rows handed on at once
GROUPS = 2048  # groups of jobs by hash; a job's state is kept with those of its group
RETAIN_SECONDS = 86_400  # how long the state of an ended job is kept, in event time
CLEAR_OF_EPOCH_US = 86_400_000_000  # a stream begins with its watermark at the epoch; times start a day later

KINDS = ["line", "exit", "cancel", "created", "started", "join"]
EVENT = np.dtype([("job_id", "i8"), ("ts_us", "i8"), ("line_no", "i8"), ("kind", "i1"), ("progress", "i8"), ("code", "i8")])
STATUSES = ["pending", "running", *ENDED]
JOB = np.dtype([("job_id", "i8"), ("status", "i1"), ("progress", "i8"), ("moved_us", "i8"), ("ended_us", "i8"), ("code", "i8")])
NOTHING = None, None, None  # a job without events: no state, error or end
NO_PROGRESS = -1
TICK = "tick"
NO_JOB = -(2**63)

OUTPUT = StructType(
    [
        StructField("job_id", LongType()), StructField("line_no", LongType()), StructField("status", StringType()),
        StructField("progress", LongType()), StructField("refused", BooleanType()), StructField("error", StringType()),
    ]
)


def events_of(log: DataFrame, kind: Column | None = None, code: Column | None = None) -> DataFrame:
    """Events of a log. Without ``kind`` every row is a line."""
    return log.select(
        "job_id", "line_no", "ts_us",
        (F.lit("line") if kind is None else kind).alias("kind"),
        PR.percent(F.col("line")).cast("bigint").alias("progress"),
        (F.lit(0) if code is None else code).cast("bigint").alias("code"),
    )


def advance(state: tuple | None, kind: str, ts_us: int, progress: int | None, code: int, stall_us: int) -> tuple[tuple, bool]:
    """One event. ``state`` is status, progress and the time it last moved; None before the first event.

    A job is created once, as ``pending`` at 0, and started once; a line shows that it runs. A finished job stays as it is; a
    cancel of it is refused.
    """
    if state is None or state[0] == "pending":
        if kind == "created":
            return state or ("pending", 0, ts_us), False
        if kind != "cancel" or state is None:
            state = ("running", FIRST_PROGRESS, ts_us)
    status, now, moved = state
    if status in ENDED:
        return state, kind == "cancel"
    if kind == "cancel":
        return ("cancelled", 0, ts_us), False
    if kind == "exit":
        return (("completed", 100, ts_us) if code == 0 else ("failed", now, ts_us)), False
    if kind in ("created", "started"):
        return state, False
    if progress is not None:
        return ("running", progress, ts_us), False
    if ts_us - moved > stall_us and now < STALL_CEILING:
        return ("running", min(now + 1, STALL_CEILING), ts_us), False
    return ("running", now, moved), False


class _Tracker(StatefulProcessor):
    """States of the jobs of one group, one row for each event.

    Events wait in the state until the watermark has passed their slot, then go through ``advance`` in order, job by job.

    The last states of a group's jobs are one packed value, as are few waiting events; more events are packed by slot in a map,
    so a task holds one slot of one group at a time. So a job costs no call of the state store and no frame of its own. One timer
    per group wakes it at the end of its first slot. The state of an ended job goes when ``retain`` has passed.
    """

    columns = OUTPUT.names

    def __init__(self, stall_us: int, slot_us: int, retain_us: int):
        self.stall_us, self.slot_us, self.retain_us = stall_us, slot_us, retain_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", StructType([StructField("jobs", BinaryType())]))
        packed = StructType([StructField("events", BinaryType())])
        self.few = handle.getValueState("few", packed)
        self.slots = handle.getMapState("slots", StructType([StructField("slot", LongType())]), packed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, first, spilled = [self._few()], None, False
        size = len(held[0])
        for frame in rows:
            frame = frame[frame["kind"] != TICK]
            came = np.empty(len(frame), EVENT)
            for name in ("job_id", "ts_us", "line_no", "code"):
                came[name] = frame[name]
            came["kind"] = frame["kind"].map(KINDS.index)
            came["progress"] = frame["progress"].fillna(NO_PROGRESS)
            if len(came):
                first = min(x for x in (first, int(came["ts_us"].min())) if x is not None)
            held.append(came)
            size += len(came)
            if size > FEW:
                self._spill(np.concatenate(held))
                held, size, spilled = [], 0, True
        if size or spilled:
            self.few.update((b"".join(events.tobytes() for events in held),))
        if first is not None:
            self._wake(first // self.slot_us)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000 - CLEAR_OF_EPOCH_US
        few, kept = self._few(), sorted(int(k[0]) for k in self.slots.keys())
        few_slots = few["ts_us"] // self.slot_us
        last = passed_us // self.slot_us  # slots before it have ended
        ended_slots = few_slots[few_slots < last]
        # Few events are one stretch; where others wait in slots, it goes slot by slot.
        due = sorted({*ended_slots.tolist(), *(s for s in kept if s < last)}) if kept else [None] * bool(len(ended_slots))
        out: list[tuple] = []
        jobs = self._jobs()
        for slot in due:
            events = few[few_slots == slot] if slot is not None else few[few_slots < last]
            if slot in kept:
                events = np.concatenate([np.frombuffer(self.slots.getValue((slot,))[0], EVENT), events])
                self.slots.removeKey((slot,))
            for job, ts_us, line_no, kind, progress, code in events[np.lexsort([events[c] for c in ("line_no", "ts_us", "job_id")])].tolist():
                now, error, ended = jobs.get(job, NOTHING)
                if KINDS[kind] == "join":
                    out += self.joined(job, code, now, error)
                    continue
                was = now
                now, refused = advance(now, KINDS[kind], ts_us, None if progress == NO_PROGRESS else progress, code, self.stall_us)
                if now[0] in ENDED and (not was or was[0] != now[0]):
                    ended, error = ts_us, f"{FAILURE}{code}" if now[0] == "failed" else None
                jobs[job] = now, error, ended
                out += self.rows(job, line_no, was, now, refused, error)
                if len(out) >= FEW:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=self.columns)
        rest = few[few_slots >= last]
        waiting = [*(few_slots[few_slots >= last].min(keepdims=True) if len(rest) else ()), *(s for s in kept if s >= last)]
        if due:
            self.few.update((rest.tobytes(),))
        # A job with waiting events stays; which those are is looked up only where a job could go.
        over = {job for job, (_, _, ended) in jobs.items() if ended is not None and passed_us >= ended + self.retain_us}
        if over:
            over -= set(rest["job_id"].tolist())
            for slot in (s for s in kept if s >= last):
                over -= set(np.frombuffer(self.slots.getValue((slot,))[0], EVENT)["job_id"].tolist())
            for job in over:
                del jobs[job]
            self.forget(over)
        if waiting:
            self._wake(int(min(waiting)))
        leaving = [ended + self.retain_us for _, _, ended in jobs.values() if ended is not None]
        later = [us for us in leaving if us > passed_us]
        if later:
            self.handle.registerTimer((min(later) + CLEAR_OF_EPOCH_US) // 1000 + 1)
        if not jobs and not waiting:
            self.now.clear()
            self.few.clear()
        elif due or over:
            self._keep(jobs)

    def rows(self, job: int, line_no: int, was: tuple | None, now: tuple, refused: bool, error: str | None) -> list[tuple]:
        return [(job, line_no, now[0], now[1], refused, error)]

    def joined(self, job: int, subscriber: int, now: tuple | None, error: str | None) -> list[tuple]:
        return []

    def forget(self, jobs: set[int]) -> None:
        pass

    def close(self) -> None:
        pass

    def _jobs(self) -> dict[int, tuple]:
        """Per job its state, error text and when it ended."""
        packed = np.frombuffer(self.now.get()[0], JOB).tolist() if self.now.exists() else []
        return {
            job: ((STATUSES[status], progress, moved), f"{FAILURE}{code}" if STATUSES[status] == "failed" else None, ended if STATUSES[status] in ENDED else None)
            for job, status, progress, moved, ended, code in packed
        }

    def _keep(self, jobs: dict[int, tuple]) -> None:
        rows = [
            (job, STATUSES.index(now[0]), now[1], now[2], ended or 0, int(error.removeprefix(FAILURE)) if error else 0)
            for job, (now, error, ended) in jobs.items()
        ]
        self.now.update((np.array(rows, JOB).tobytes(),))

    def _few(self) -> np.ndarray:
        return np.frombuffer(self.few.get()[0], EVENT) if self.few.exists() else np.empty(0, EVENT)

    def _spill(self, events: np.ndarray) -> None:
        slots = events["ts_us"] // self.slot_us
        by = np.argsort(slots, kind="stable")
        names, starts = np.unique(slots[by], return_index=True)
        for slot, part in zip(names.tolist(), np.split(events[by], starts[1:])):
            before = self.slots.getValue((slot,))[0] if self.slots.containsKey((slot,)) else b""
            self.slots.updateValue((slot,), (before + part.tobytes(),))

    def _wake(self, slot: int) -> None:
        self.handle.registerTimer(((slot + 1) * self.slot_us + CLEAR_OF_EPOCH_US) // 1000 + 1)


MESSAGES = StructType(
    [
        StructField("job_id", LongType()), StructField("subscriber_id", LongType()), StructField("line_no", LongType()), StructField("type", StringType()),
        StructField("status", StringType()), StructField("progress", LongType()), StructField("error", StringType()),
    ]
)


class _Broadcaster(_Tracker):
    """What the subscribers of a job are sent: the state when they join, then each change of it."""

    columns = MESSAGES.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.subscribers = handle.getMapState("subscribers", StructType([StructField("job_id", LongType())]), StructType([StructField("subscribers", BinaryType())]))
        self.there, self.known, self.grown = None, {}, set()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.there, self.known, self.grown = None, {}, set()  # read for each job when it is first needed
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        for job in self.grown:
            self.subscribers.updateValue((job,), (np.fromiter(self.known[job], np.int64).tobytes(),))

    def rows(self, job: int, line_no: int, was: tuple | None, now: tuple, refused: bool, error: str | None) -> list[tuple]:
        moved = was is None or was[1] != now[1]
        turned = was is None or was[0] != now[0]
        kinds = ["progress"] * moved + ["status"] * turned + ["error"] * bool(turned and error)
        return [(job, s, line_no, kind, now[0], now[1], error if kind == "error" else None) for s in self._known(job) for kind in kinds] if kinds else []

    def joined(self, job: int, subscriber: int, now: tuple | None, error: str | None) -> list[tuple]:
        if subscriber not in self._known(job):
            self.known[job][subscriber] = None
            self.grown.add(job)
        status, progress = now[:2] if now else ("pending", 0)
        return [(job, subscriber, -1, "hello", status, progress, error)]

    def forget(self, jobs: set[int]) -> None:
        for job in jobs:
            self.known[job] = {}
            self.grown.discard(job)
            if self.subscribers.containsKey((job,)):
                self.subscribers.removeKey((job,))

    def _known(self, job: int) -> dict[int, None]:
        if job not in self.known:
            if self.there is None:
                self.there = {int(k[0]) for k in self.subscribers.keys()}
            self.known[job] = dict.fromkeys(np.frombuffer(self.subscribers.getValue((job,))[0], np.int64).tolist()) if job in self.there else {}
        return self.known[job]


def _followed(events: DataFrame, tracker: _Tracker, schema: StructType, delay: str, ticks: DataFrame | None) -> DataFrame:
    timed = events.select("job_id", "line_no", "ts_us", "kind", "progress", "code", F.timestamp_micros(F.col("ts_us") + CLEAR_OF_EPOCH_US).alias("at"))
    if ticks is not None:
        timed = timed.unionByName(ticks.select("at", F.lit(TICK).alias("kind")), allowMissingColumns=True)
    # Ticks pass with the rows without a job: a filter would be pushed below the watermark.
    keyed = timed.withColumn("job_id", F.coalesce("job_id", F.lit(NO_JOB))).withColumn("jobs", F.pmod(F.xxhash64("job_id"), F.lit(GROUPS))).withWatermark("at", delay)
    states = keyed.groupBy("jobs").transformWithStateInPandas(tracker, schema, "append", "eventTime")
    return states.withColumn("job_id", F.nullif("job_id", F.lit(NO_JOB)))


def broadcast_messages(
    events: DataFrame, joins: DataFrame, stall_seconds: int = STALL_SECONDS, delay: str = DEFAULT_DELAY, ticks: DataFrame | None = None,
    slot_seconds: int = SLOT_SECONDS, retain_seconds: int = RETAIN_SECONDS,
) -> DataFrame:
    """Messages to each subscriber of a job, from a stream of events and one of subscribers (``subscriber_id, job_id, joined_us``).

    The first is ``hello`` (``line_no`` -1) with status and progress as of ``joined_us``, events of that moment included; a job without events is
    ``pending`` at 0. Later ones are ``progress``, ``status`` and ``error``, one for each change. Both streams may arrive in any order
    and cut, as in :func:`track`. The state holds a job's last state and its subscribers; the messages are not kept.
    """
    hello = joins.select(
        "job_id", F.lit(2**63 - 1).alias("line_no"), F.col("joined_us").alias("ts_us"), F.lit("join").alias("kind"),
        F.lit(None).cast("bigint").alias("progress"), F.col("subscriber_id").cast("bigint").alias("code"),
    )
    both = events.select("job_id", "line_no", "ts_us", "kind", "progress", "code").unionByName(hello)
    told = _Broadcaster(stall_seconds * 1_000_000, slot_seconds * 1_000_000, retain_seconds * 1_000_000)
    return _followed(both, told, MESSAGES, delay, ticks)


def as_json(messages: DataFrame) -> DataFrame:
    """The messages as the JSON texts that are sent."""
    body = F.struct("type", F.when(F.col("type").isin("hello", "status"), F.col("status")).alias("status"), F.when(F.col("type") != "error", F.col("progress")).alias("progress"), F.when(F.col("type") == "error", F.col("error")).alias("message"))
    return messages.select("job_id", "subscriber_id", "line_no", F.to_json(body).alias("message"))


def track(
    events: DataFrame, stall_seconds: int = STALL_SECONDS, delay: str = DEFAULT_DELAY, ticks: DataFrame | None = None,
    slot_seconds: int = SLOT_SECONDS, retain_seconds: int = RETAIN_SECONDS,
) -> DataFrame:
    """State after every event of a stream, and the error text of a failed job.

    Events are taken in the order of ``(ts_us, line_no)`` whatever order and micro-batches they arrive in, as long as they are at
    most ``delay`` late; later ones are dropped. An event's row appears when the watermark has passed its slot of
    ``slot_seconds``. The state is status, progress, the time progress last moved and the events that wait, never the log
    text. The silence before a bump is a gap in event time, seen when the next line comes. An ended job is forgotten after
    ``retain_seconds``; until then it refuses a cancel.

    ``ticks`` (a stream with ``at``, see ``sinks.Ticks``) moves the watermark where events pause. Needs the RocksDB state
    store (``plans.session``).
    """
    return _followed(events, _Tracker(stall_seconds * 1_000_000, slot_seconds * 1_000_000, retain_seconds * 1_000_000), OUTPUT, delay, ticks)


def closing_records(tracked: DataFrame, results: DataFrame, paths: DataFrame) -> DataFrame:
    """One record per job that has ended: status, progress, error, output path and number of processed inputs.

    ``tracked`` is the table of :func:`track`; ``results`` (session results) and ``paths`` (final paths) are those of the job's whole log.
    A path belongs to completed jobs only.
    """
    last = tracked.filter(F.col("status").isin(*ENDED)).groupBy("job_id").agg(
        F.min_by(F.struct("status", "progress", "error", "line_no"), "line_no").alias("v")
    )
    counts = results.groupBy("job_id").agg(F.count(F.lit(1)).alias("processed_count"))
    record = last.select("job_id", "v.*").join(counts, "job_id", "left").join(paths, "job_id", "left")
    return record.select(
        "job_id", "status", "progress", "error", F.when(F.col("status") == "completed", F.col("output_path")).alias("output_path"),
        F.coalesce("processed_count", F.lit(0)).alias("processed_count"),
    )
