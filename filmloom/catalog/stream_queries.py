"""Queries that run a stream over the events table (ids A6, A8, D24, H4-H7, H9-H11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.catalog.registry import RAW_SQL as ORACLES
from filmloom.catalog.registry import query
from filmloom.operators import logs as L
from filmloom.plans.storage import scratch_path
from filmloom.sources import derived as D
from filmloom.sources import logs as SL
from filmloom.sources.growing_files import GrowingLines
from filmloom.streaming import jobs as SJ
from filmloom.streaming import requests as SR
from filmloom.streaming import sinks
from filmloom.streaming import telemetry as ST
from filmloom.catalog.log_queries import PERCENT_SQL, RESULT_SQL, STAGE_SQL


def events(spark, sf):
    return SL.stream_table(spark, sf, "events", D.table(spark, sf, "events").schema)


def log(spark, sf):
    return events(spark, sf).select(*D.log_columns())


def whole(spark, sf, name="events"):
    """A whole table as one micro-batch: its files are not in the order of event time."""
    return SL.stream_table(spark, sf, name, D.table(spark, sf, name).schema, bytes_per_trigger=None)


def whole_log(spark, sf):
    return whole(spark, sf).select(*D.log_columns())


@query("a6_log_stream", "SELECT * FROM log")
def a6(spark, sf):
    return sinks.drain(log(spark, sf), "log-lines")


@query("a6_growing_files", "SELECT job_id, line_no, line FROM log")
def a6_files(spark, sf):
    """The log as text files, followed as files that grow."""
    folder = scratch_path(spark, "text-logs")
    lines = D.log(spark, sf).select(F.concat_ws("\t", "job_id", "line_no", "line").alias("value"))
    lines.write.text(folder)
    spark.dataSource.register(GrowingLines)
    followed = spark.readStream.format("growing_lines").option("suffix", ".txt").load(folder)
    parts = F.split("line", "\t", 3)
    table = sinks.drain(followed, "followed")
    return table.select(parts[0].cast("bigint").alias("job_id"), parts[1].cast("bigint").alias("line_no"), parts[2].alias("line"))


@query("a8_json_events", """
SELECT job_id, line_no, 0 AS part, CAST(to_json({'type': 'log', 'line': line}) AS VARCHAR) AS message FROM log
UNION ALL SELECT job_id, line_no, 1, CAST(to_json({'type': 'progress', 'progress': least(CAST(f AS BIGINT), 100)}) AS VARCHAR)
FROM (SELECT *, regexp_extract(line, '(\\d{1,3})%', 1) AS f FROM log) WHERE f <> ''
""")
def a8(spark, sf):
    return sinks.drain(L.messages(log(spark, sf)), "messages")


# One step per line and job; all jobs advance together.
STEPS_SQL = """
WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_us, line_no) AS rn FROM ({events})),
st AS (
  SELECT job_id, rn, line_no, ts_us, 'new' AS status, CAST(5 AS BIGINT) AS progress, ts_us AS moved, false AS refused FROM (SELECT job_id, 0 AS rn, CAST(-1 AS BIGINT) AS line_no, ts_us FROM ev WHERE rn = 1)
  UNION ALL
  SELECT e.job_id, e.rn, e.line_no, e.ts_us,
    CASE WHEN s.status IN ('completed', 'failed', 'cancelled') THEN s.status WHEN e.kind = 'cancel' THEN 'cancelled'
         WHEN e.kind = 'exit' THEN CASE WHEN e.code = 0 THEN 'completed' ELSE 'failed' END ELSE 'running' END,
    CASE WHEN s.status IN ('completed', 'failed', 'cancelled') THEN s.progress WHEN e.kind = 'cancel' THEN 0
         WHEN e.kind = 'exit' THEN CASE WHEN e.code = 0 THEN 100 ELSE s.progress END
         WHEN e.p IS NOT NULL THEN e.p WHEN e.ts_us - s.moved > 10000000 AND s.progress < 90 THEN s.progress + 1 ELSE s.progress END,
    CASE WHEN e.p IS NOT NULL OR (e.ts_us - s.moved > 10000000 AND s.progress < 90) THEN e.ts_us ELSE s.moved END,
    s.status IN ('completed', 'failed', 'cancelled') AND e.kind = 'cancel'
  FROM st s JOIN ev e ON e.job_id = s.job_id AND e.rn = s.rn + 1)
"""
LINES_SQL = f"SELECT job_id, line_no, ts_us, 'line' AS kind, 0 AS code, {PERCENT_SQL} AS p FROM log"
KINDS_SQL = f"""
SELECT job_id, line_no, ts_us, {PERCENT_SQL} AS p, CASE WHEN line LIKE 'remarks: code 9%' THEN 1 ELSE 0 END AS code,
  CASE WHEN line LIKE 'final video at: /workspace%' OR line LIKE 'remarks: code 9%' THEN 'exit' WHEN line = 'status: Error' THEN 'cancel' ELSE 'line' END AS kind FROM log"""


def tracked(spark, events, label):
    ticks = sinks.Ticks(spark)
    return sinks.drain(SJ.track(events, ticks=ticks.stream()), label, ticks=ticks, at_once=True)


@query("h4_stall_bump", STEPS_SQL.format(events=LINES_SQL) + "SELECT job_id, line_no, progress FROM st WHERE rn > 0")
def h4(spark, sf):
    return tracked(spark, SJ.events_of(whole_log(spark, sf)), "stall").select("job_id", "line_no", "progress")


def kinds(lines):
    line = F.col("line")
    failed = line.startswith("remarks: code 9")
    kind = F.when(line.startswith("final video at: /workspace") | failed, "exit").when(line == "status: Error", "cancel").otherwise("line")
    return SJ.events_of(lines, kind, failed.cast("int"))


@query("h5_job_states", STEPS_SQL.format(events=KINDS_SQL) + "SELECT job_id, line_no, status, progress FROM st WHERE rn > 0")
def h5(spark, sf):
    return tracked(spark, kinds(whole_log(spark, sf)), "states").select("job_id", "line_no", "status", "progress")


# A job's first lines create and start it here, so that it waits before it runs.
LIFE_SQL = KINDS_SQL.replace("ELSE 'line' END AS kind", "WHEN line_no % 3 = 1 THEN 'created' WHEN line_no % 5 = 1 THEN 'started' ELSE 'line' END AS kind")
LIFE_STEPS_SQL = """
WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_us, line_no) AS rn FROM ({events})),
st AS (
  SELECT job_id, rn, line_no, ts_us, 'new' AS status, CAST(0 AS BIGINT) AS progress, ts_us AS moved, CAST(NULL AS VARCHAR) AS error FROM (SELECT job_id, 0 AS rn, CAST(-1 AS BIGINT) AS line_no, ts_us FROM ev WHERE rn = 1)
  UNION ALL
  SELECT job_id, rn, line_no, ts_us,
    CASE WHEN waits AND kind = 'created' THEN 'pending' WHEN over THEN status WHEN kind = 'cancel' THEN 'cancelled'
         WHEN kind = 'exit' THEN CASE WHEN code = 0 THEN 'completed' ELSE 'failed' END ELSE 'running' END,
    CASE WHEN waits AND kind = 'created' OR over THEN progress WHEN kind = 'cancel' THEN 0 WHEN kind = 'exit' AND code = 0 THEN 100
         WHEN kind = 'line' AND p IS NOT NULL THEN p WHEN kind = 'line' AND ts_us - since > 10000000 AND now < 90 THEN now + 1 ELSE now END,
    CASE WHEN waits AND kind = 'created' AND status = 'pending' OR over THEN moved
         WHEN kind = 'line' AND NOT (p IS NOT NULL OR ts_us - since > 10000000 AND now < 90) OR kind IN ('created', 'started') THEN since ELSE ts_us END,
    CASE WHEN over THEN error WHEN kind = 'exit' AND code <> 0 THEN 'Pipeline failed with exit code ' || code END
  FROM (SELECT e.*, s.status, s.progress, s.moved, s.error, s.status IN ('new', 'pending') AS waits, s.status IN ('completed', 'failed', 'cancelled') AS over,
      CASE WHEN s.status IN ('new', 'pending') THEN 5 ELSE s.progress END AS now, CASE WHEN s.status IN ('new', 'pending') THEN e.ts_us ELSE s.moved END AS since
    FROM st s JOIN ev e ON e.job_id = s.job_id AND e.rn = s.rn + 1))
"""


def told(lines):
    n = F.col("line_no")
    line, other = F.col("line"), F.when(n % 3 == 1, "created").when(n % 5 == 1, "started").otherwise("line")
    failed = line.startswith("remarks: code 9")
    kind = F.when(line.startswith("final video at: /workspace") | failed, "exit").when(line == "status: Error", "cancel").otherwise(other)
    return SJ.events_of(lines, kind, failed.cast("int"))


def lifecycle(spark, sf):
    return tracked(spark, told(whole_log(spark, sf)), "lifecycle")


@query("h5_job_lifecycle", LIFE_STEPS_SQL.format(events=LIFE_SQL) + "SELECT job_id, line_no, status, progress, error FROM st WHERE rn > 0")
def h5_lifecycle(spark, sf):
    """From pending to the end, with the error text."""
    return lifecycle(spark, sf).select("job_id", "line_no", "status", "progress", "error")


@query("h5_closing_record", LIFE_STEPS_SQL.format(events=LIFE_SQL) + f"""
SELECT e.job_id, e.status, e.progress, e.error, CASE WHEN e.status = 'completed' THEN p.output_path END AS output_path, coalesce(r.n, 0) AS processed_count
FROM (SELECT job_id, arg_min(status, rn) AS status, arg_min(progress, rn) AS progress, arg_min({{'e': error}}, rn)['e'] AS error FROM st WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id) e
LEFT JOIN (SELECT job_id, count(*) AS n FROM ({RESULT_SQL}) GROUP BY job_id) r ON r.job_id = e.job_id
LEFT JOIN ({ORACLES["e9_last_output_path"]}) p ON p.job_id = e.job_id
""")
def h5_record(spark, sf):
    lines = D.log(spark, sf)
    return SJ.closing_records(lifecycle(spark, sf), L.session_results(L.sessions(lines)), L.final_paths(lines))


@query("h6_cancel_guard", STEPS_SQL.format(events=KINDS_SQL) + """
SELECT st.job_id, st.line_no, st.status, st.progress, refused FROM st JOIN ev ON ev.job_id = st.job_id AND ev.rn = st.rn WHERE kind = 'cancel'
""")
def h6(spark, sf):
    """Commands are in the same stream as the lines; the answer to each is the state after it."""
    done = tracked(spark, kinds(whole_log(spark, sf)), "cancel").drop("error")
    commands = D.log(spark, sf).filter("line = 'status: Error'").select("job_id", "line_no")
    return done.join(commands, ["job_id", "line_no"], "left_semi")


MESSAGES_SQL = LIFE_STEPS_SQL.format(events=LIFE_SQL) + """,
subs AS (SELECT c_custkey AS subscriber_id, c_custkey % 200 AS job_id, c_custkey % 40 * 60000000 AS joined_us FROM customer),
seen AS (SELECT subscriber_id, u.job_id, max(rn) AS rn FROM subs u JOIN st ON st.job_id = u.job_id AND st.rn > 0 AND ts_us <= joined_us GROUP BY ALL),
told AS (SELECT subscriber_id, u.job_id, n.line_no, n.status, n.progress, n.error, n.progress <> o.progress OR n.rn = 1 AS moved, n.status <> o.status AS turned
  FROM subs u JOIN st n ON n.job_id = u.job_id AND n.rn > 0 AND n.ts_us > joined_us JOIN st o ON o.job_id = n.job_id AND o.rn = n.rn - 1)
SELECT u.job_id, u.subscriber_id, -1 AS line_no, 'hello' AS type, coalesce(st.status, 'pending') AS status, coalesce(st.progress, 0) AS progress, st.error
FROM subs u LEFT JOIN seen USING (subscriber_id, job_id) LEFT JOIN st ON st.job_id = u.job_id AND st.rn = seen.rn
UNION ALL SELECT job_id, subscriber_id, line_no, 'progress', status, progress, NULL FROM told WHERE moved
UNION ALL SELECT job_id, subscriber_id, line_no, 'status', status, progress, NULL FROM told WHERE turned
UNION ALL SELECT job_id, subscriber_id, line_no, 'error', status, progress, error FROM told WHERE turned AND error IS NOT NULL
"""


def messages(spark, sf):
    key = F.col("c_custkey")
    joins = whole(spark, sf, "customer").select(key.alias("subscriber_id"), (key % 200).alias("job_id"), (key % 40 * 60_000_000).alias("joined_us"))
    ticks = sinks.Ticks(spark)
    sent = SJ.broadcast_messages(told(whole_log(spark, sf)), joins, ticks=ticks.stream())
    return sinks.drain(sent, "broadcast", ticks=ticks, at_once=True)


@query("h8_push_stream", MESSAGES_SQL)
def h8_stream(spark, sf):
    """Both sides are streams: subscribers meet the state of their job when they join, then its changes."""
    return messages(spark, sf)


@query("a8_state_events", f"""SELECT job_id, subscriber_id, line_no, CASE WHEN type = 'error' THEN '{{"type":"error","message":"' || error || '"}}'
  ELSE '{{"type":"' || type || '"' || CASE WHEN type <> 'progress' THEN ',"status":"' || status || '"' ELSE '' END || ',"progress":' || progress || '}}' END AS message FROM ({MESSAGES_SQL})""")
def a8_states(spark, sf):
    """Hello, status, progress and error events as the JSON that is sent."""
    return SJ.as_json(messages(spark, sf))


@query("h7_growing_log", "SELECT job_id, count(*) AS n_lines, max(ts_us) AS updated_us FROM log GROUP BY job_id")
def h7(spark, sf):
    return sinks.latest(sinks.drain(ST.growing_logs(log(spark, sf)), "growth", "update"), ["job_id"])


@query("e22_latest_state_stream", ORACLES["e22_latest_state"])
def e22_stream(spark, sf):
    """Stage, progress, output and last line of each job, kept up to date; one row of state per job, in any order of arrival."""
    return sinks.latest(sinks.drain(L.latest_states(log(spark, sf)), "latest", "update"), ["job_id"])


@query("h3_stage_stream", """SELECT job_id, stage FROM (SELECT job_id, line_no, stage, max(line_no) OVER (PARTITION BY job_id) AS last FROM (
  SELECT job_id, line_no, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'starting') AS stage
  FROM (SELECT *, """ + STAGE_SQL + """ AS s FROM log))) WHERE line_no = last""")
def h3_stream(spark, sf):
    return sinks.latest(sinks.drain(L.latest_states(log(spark, sf)), "stage", "update"), ["job_id"]).select("job_id", "stage")


@query("h12_live_output_stream", ORACLES["h12_live_output"])
def h12_stream(spark, sf):
    return sinks.latest(sinks.drain(L.live_outputs(log(spark, sf)), "outputs", "update"), ["job_id"])


@query("h9_telemetry_throttle", """
SELECT node_id, ts_us // 3000000 * 3000000 AS window_us, arg_min(line_no, (ts_us, line_no)) AS seq, arg_min(value, (ts_us, line_no)) AS value
FROM (SELECT job_id % 8 AS node_id, ts_us, line_no, length(line) AS value FROM log) GROUP BY 1, 2
""")
def h9(spark, sf):
    samples = ST.timed(log(spark, sf), start_us=D.START_US).select(
        (F.col("job_id") % 8).alias("node_id"), "at", F.col("line_no").alias("seq"), F.length("line").alias("value")
    )
    table = sinks.drain(ST.throttled(samples, ["node_id"]), "samples", "update")
    return sinks.latest(table, ["node_id", "window_us"]).withColumn("window_us", F.col("window_us") - D.START_US)


@query("h10_response_deadline", """
SELECT r.prompt_id, req_us, resp_us, part, s.prompt_id IS NULL AS timed_out
FROM requests r LEFT JOIN responses s ON s.prompt_id = r.prompt_id AND resp_us BETWEEN req_us AND req_us + 600000000
""")
def h10(spark, sf):
    """The same join as on two streams, here over the whole tables, so the last requests are closed too."""
    raw = D.table(spark, sf, "events")
    asked = raw.select(*D.request_columns()).withColumn("req_at", F.timestamp_micros("req_us"))
    given = D.responses_of(raw).withColumn("resp_at", F.timestamp_micros("resp_us"))
    return SR.with_deadline(asked, given).select("prompt_id", "req_us", "resp_us", "part", "timed_out")


@query("h10_deadline_stream", ORACLES["h10_response_deadline"])
def h10_stream(spark, sf):
    """On two streams: a request's timeout row leaves when the watermark of both has passed its deadline."""
    raw, ticks = whole(spark, sf), sinks.Ticks(spark)
    nobody = F.lit(-1).cast("bigint").alias("prompt_id")  # a null id would be filtered out below the watermark
    asked = raw.select(*D.request_columns()).withColumn("req_at", F.timestamp_micros(F.col("req_us") + D.START_US))
    given = D.responses_of(raw).withColumn("resp_at", F.timestamp_micros(F.col("resp_us") + D.START_US))
    asked = asked.unionByName(ticks.stream().select(nobody, F.col("at").alias("req_at")), allowMissingColumns=True)
    given = given.unionByName(ticks.stream().select(nobody, F.col("at").alias("resp_at")), allowMissingColumns=True)
    answered = SR.with_deadline(asked, given).select("prompt_id", "req_us", "resp_us", "part", "timed_out")
    return sinks.drain(answered, "deadline", ticks=ticks, at_once=True).filter("prompt_id <> -1")


@query("h11_unique_outputs", "SELECT prompt_id, part || '.png' AS filename, resp_us FROM responses")
def h11(spark, sf):
    given = D.responses_of(events(spark, sf)).select(
        "prompt_id", "resp_us", F.timestamp_micros(F.col("resp_us") + D.START_US).alias("resp_at"),
        F.explode(F.array_repeat(F.concat("part", F.lit(".png")), 2)).alias("filename"),
    )
    table = sinks.drain(SR.unique_outputs(given, ["prompt_id", "filename"]), "outputs")
    return table.select("prompt_id", "filename", "resp_us")


@query("d24_answer_completeness", """
SELECT prompt_id, count(*) = 4 AS is_complete, string_agg(part, ',' ORDER BY part) AS present, CASE WHEN count(*) = 4 THEN '' ELSE 'faces' END AS missing
FROM responses GROUP BY prompt_id
""")
def d24(spark, sf):
    return SR.completeness(D.responses_of(D.table(spark, sf, "events")))
