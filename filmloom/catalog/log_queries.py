"""Log, job and telemetry queries in batch (ids A7, A10, B8, B13, B17, B24, C11, D1-D3, E8-E10, E22, H1-H3, H8, H12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.catalog.registry import query
from filmloom.functions import progress as PR
from filmloom.functions import text as T
from filmloom.functions import timecode as TC
from filmloom.operators import jobs as J
from filmloom.operators import logs as L
from filmloom.sources import derived as D
from filmloom.sources import telemetry as G

@query("a7_gpu_text", "SELECT node_id, probe_no, gpu_index, name, utilization, memory_used, memory_total, temperature FROM gpus")
def a7(spark, sf):
    return G.parse_gpu_lines(D.gpu_lines(spark, sf)).drop("part")


@query("b8_request_aliases", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 1 THEN 'batch_csv' ELSE 'single' END AS job_type,
       CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 9 = 0 THEN 'alt-' || o_orderkey ELSE 'https://youtu.be/' || o_custkey END AS youtube_url,
       CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 7 ELSE o_orderkey % 3 END AS part_index,
       CASE WHEN o_orderkey % 7 = 0 THEN false WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN NULL ELSE true END AS unet_flag,
       false AS clahe_flag,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 4 WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 3 END AS DOUBLE) AS upscale_value
FROM orders
""")
def b8(spark, sf):
    return J.parse_requests(D.jobs(spark, sf)).select(
        "job_id", "job_type", "youtube_url", "part_index", "unet_flag", "clahe_flag", "upscale_value"
    )


@query("b13_archive_name", """
SELECT event_id, left(CASE WHEN s = '' THEN 'video' ELSE s END, 80) || '_' || n AS archive_name FROM (
  SELECT event_id, event_type || '.mp4' AS n, trim(regexp_replace(props || event_type || '/_', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s FROM events)
""")
def b13(spark, sf):
    url = F.concat("props", "event_type", F.lit("/_"))
    name = T.safe_archive_name(url, F.concat("event_type", F.lit(".mp4")))
    return D.table(spark, sf, "events").select("event_id", name.alias("archive_name"))


MARK_SQL = """SELECT job_id, line_no, CAST(h AS BIGINT) * 3600 + CAST(m AS BIGINT) * 60 + CAST(s AS BIGINT) + CAST(c AS BIGINT) / CAST(100 AS DOUBLE) AS seconds
FROM (SELECT job_id, line_no, regexp_extract(line, 'time=(\\d+):(\\d+):(\\d+).(\\d+)', 1) AS h, regexp_extract(line, 'time=(\\d+):(\\d+):(\\d+).(\\d+)', 2) AS m,
             regexp_extract(line, 'time=(\\d+):(\\d+):(\\d+).(\\d+)', 3) AS s, regexp_extract(line, 'time=(\\d+):(\\d+):(\\d+).(\\d+)', 4) AS c FROM log)
WHERE h <> ''"""


@query("b17_timecodes", f"SELECT job_id, line_no, round(seconds, 6) AS seconds, CAST(floor(25 * seconds) AS BIGINT) AS frame FROM ({MARK_SQL})")
def b17(spark, sf):
    seconds = TC.mark_seconds(F.col("line"))
    return D.log(spark, sf).select(
        "job_id", "line_no", F.round(seconds, 6).alias("seconds"), TC.frame_at(seconds, F.lit(25.0)).alias("frame")
    ).filter("seconds IS NOT NULL")


@query("b17_clock_text", """
SELECT line_no, CAST(CAST(split_part(t, ':', 1) AS BIGINT) * 3600 + CAST(split_part(t, ':', 2) AS BIGINT) * 60 + CAST(split_part(t, ':', 3) AS BIGINT) AS BIGINT) AS end_second
FROM (SELECT line_no, "end_time (01:22:33)" AS t FROM manifest_local)
""")
def b17_clock(spark, sf):
    return D.manifest_local(spark, sf).select("line_no", TC.clock_seconds(F.col("`end_time (01:22:33)`")).alias("end_second"))


@query("b24_memory_percent", """
SELECT node_id, probe_no, CASE WHEN memory_total > 0 THEN CAST(printf('%.1f', CAST(memory_used AS DOUBLE) / memory_total * 100) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS used_percent FROM gpus
""")
def b24(spark, sf):
    return G.parse_gpu_lines(D.gpu_lines(spark, sf)).select("node_id", "probe_no", G.memory_percent().alias("used_percent"))


@query("d1_job_counts", "SELECT status, count(*) AS n, status IN ('running', 'queued') AS is_active FROM jobs GROUP BY status")
def d1(spark, sf):
    return J.status_counts(D.jobs(spark, sf))


@query("d2_run_summary", """
SELECT count(*) FILTER (NOT is_done AND size >= 500) AS success, count(*) FILTER (is_done) AS skipped, count(*) FILTER (NOT is_done AND size < 500) AS failed FROM files
""")
def d2(spark, sf):
    return J.run_summary(D.files(spark, sf), F.col("is_done"), F.col("size") >= 500)


@query("d3_idle_gpus", """
SELECT node_id, count(*) AS gpus, count(*) FILTER (utilization < 10) AS idle_by_load,
       count(*) FILTER (CASE WHEN memory_total > 0 THEN CAST(memory_used AS DOUBLE) / memory_total * 100 ELSE 0 END < 20) AS idle_by_memory,
       count(*) FILTER (utilization < 10 AND memory_used < CAST(0.2 AS DOUBLE) * memory_total) AS idle_by_both
FROM gpus GROUP BY node_id
""")
def d3(spark, sf):
    rules = {"idle_by_load": G.idle_by_load(), "idle_by_memory": G.idle_by_memory(), "idle_by_both": G.idle_by_both()}
    return G.parse_gpu_lines(D.gpu_lines(spark, sf)).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("gpus"), *[F.count_if(r).alias(n) for n, r in rules.items()]
    )


@query("c11_fleet_view", """
SELECT n.node_id, g.gpus, g.idle_gpus, coalesce(b.running_jobs, 0) AS running_jobs, b.top_progress, 'online' AS status
FROM (SELECT CAST(n_nationkey AS BIGINT) AS node_id FROM nation) n
LEFT JOIN (SELECT node_id, count(*) AS gpus, count(*) FILTER (utilization < 10 AND memory_used < CAST(0.2 AS DOUBLE) * memory_total) AS idle_gpus FROM gpus GROUP BY 1) g USING (node_id)
LEFT JOIN (SELECT node_id, count(*) AS running_jobs, max(progress) AS top_progress FROM jobs WHERE status IN ('running', 'queued') GROUP BY 1) b USING (node_id)
""")
def c11(spark, sf):
    nodes = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node_id"))
    return J.fleet(nodes, G.parse_gpu_lines(D.gpu_lines(spark, sf)), D.jobs(spark, sf), G.idle_by_both())


SESSION_SQL = """
SELECT job_id, line_no, line, t, session_no FROM (
  SELECT job_id, line_no, line, trim(line) AS t, CAST(sum(CAST(contains(line, 'Video URL:') AS INTEGER)) OVER (PARTITION BY job_id ORDER BY line_no) AS BIGINT) AS session_no
  FROM log WHERE trim(line) <> '') WHERE session_no > 0
"""
RESULT_SQL = f"""
SELECT job_id, session_no, trim(split_part(max(t) FILTER (contains(t, 'Video URL:')), 'Video URL:', 2)) AS video_url,
       coalesce(arg_max(CASE WHEN starts_with(lower(t), 'final') THEN 'completed' ELSE trim(t[8:]) END, line_no)
                FILTER (starts_with(lower(t), 'final video at:') OR starts_with(lower(t), 'status:')), 'running') AS status,
       arg_max(trim(t[position(':' IN t) + 1:]), line_no) FILTER (contains(t, 'Resolved Path:')) AS input_path,
       arg_max(trim(t[position(':' IN t) + 1:]), line_no) FILTER (starts_with(lower(t), 'final video at:')) AS final_output,
       arg_max(trim(t[position(':' IN t) + 1:]), line_no) FILTER (starts_with(lower(t), 'remarks:')) AS remarks,
       count(*) AS n_lines
FROM ({SESSION_SQL}) GROUP BY job_id, session_no
"""


@query("e8_session_lines", f"SELECT job_id, line_no, line, session_no FROM ({SESSION_SQL})")
def e8_lines(spark, sf):
    return L.sessions(D.log(spark, sf)).select("job_id", "line_no", "line", "session_no")


@query("e8_session_results", RESULT_SQL)
def e8(spark, sf):
    return L.session_results(L.sessions(D.log(spark, sf)))


@query("a10_download_bundle", f"""
SELECT job_id, session_no, path, left(trim(regexp_replace(video_url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 80) || '_' || split_part(path, '/', -1) AS archive_name
FROM (SELECT *, CASE WHEN final_output LIKE '/%' THEN replace(final_output, '//', '/') ELSE '/workspace/' || replace(final_output, '/x/..', '') END AS path FROM ({RESULT_SQL}))
WHERE path IN (SELECT '/workspace/output_videos/' || event_id || '.mp4' FROM events WHERE value < 50)
""")
def a10(spark, sf):
    results = L.session_results(L.sessions(D.log(spark, sf)))
    existing = D.table(spark, sf, "events").filter("value < 50").select(
        F.concat(F.lit("/workspace/output_videos/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path")
    )
    return L.download_bundle(results, existing)


@query("e9_last_output_path", """
SELECT job_id, arg_max(CASE WHEN p LIKE '/%' THEN replace(p, '//', '/') ELSE '/workspace/' || replace(p, '/x/..', '') END, line_no) AS output_path
FROM (SELECT job_id, line_no, trim(regexp_extract(line, 'final video at: (.+)$', 1)) AS p FROM log WHERE contains(line, 'final video at:')) GROUP BY job_id
""")
def e9(spark, sf):
    return L.final_paths(D.log(spark, sf))


@query("e10_progress_increments", f"""
SELECT job_id, line_no, greatest(frame - coalesce(max(frame) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gained, false AS is_closing
FROM (SELECT job_id, line_no, CAST(floor(25 * seconds) AS BIGINT) AS frame FROM ({MARK_SQL}))
UNION ALL
SELECT job_id, max(line_no), 5000 - max(CAST(floor(25 * seconds) AS BIGINT)), true FROM ({MARK_SQL}) GROUP BY job_id
""")
def e10(spark, sf):
    return L.frame_increments(D.log(spark, sf), 25.0, 5000)


PERCENT_SQL = """least(coalesce(TRY_CAST(regexp_extract(line, '(?i)Progress:\\s*(\\d+)%', 1) AS BIGINT),
  CASE WHEN TRY_CAST(regexp_extract(line, '(?i)Task\\s+(\\d+)\\s*/\\s*(\\d+)', 2) AS BIGINT) > 0 THEN
  CAST(floor(CAST(regexp_extract(line, '(?i)Task\\s+(\\d+)\\s*/\\s*(\\d+)', 1) AS DOUBLE) / CAST(regexp_extract(line, '(?i)Task\\s+(\\d+)\\s*/\\s*(\\d+)', 2) AS DOUBLE) * 100) AS BIGINT) END), 95)"""
# least() of DuckDB skips nulls, so a line without progress is set back to null.
PERCENT_SQL = f"CASE WHEN regexp_matches(line, '(?i)Progress:\\s*\\d+%') OR (regexp_matches(line, '(?i)Task\\s+\\d+\\s*/\\s*\\d+') AND NOT regexp_matches(line, '(?i)Task\\s+\\d+\\s*/\\s*0+$')) THEN {PERCENT_SQL} END"
STAGE_SQL = """CASE WHEN contains(line, 'Running restoration') THEN 'restore' WHEN contains(line, 'Starting scene detection') THEN 'scene_split'
  WHEN contains(line, 'ComfyUI') THEN 'comfyui' WHEN contains(lower(line), 'colorized') THEN 'colorize'
  WHEN contains(lower(line), 'postprocessed') THEN 'postprocess' WHEN contains(lower(line), 'final video at:') THEN 'finalize' END"""
OUTPUT_SQL = "CASE WHEN contains(line, 'final video at:') THEN trim(split_part(line, 'final video at:', 2)) END"


@query("e22_latest_state", f"""
SELECT job_id, max(line_no) AS line_no, arg_max(ts_us, line_no) AS updated_us, arg_max(line, line_no) AS last_line,
       coalesce(arg_max(p, line_no) FILTER (p IS NOT NULL), 0) AS progress, coalesce(arg_max(s, line_no) FILTER (s IS NOT NULL), 'starting') AS stage,
       arg_max(o, line_no) FILTER (o IS NOT NULL) AS output
FROM (SELECT *, {PERCENT_SQL} AS p, {STAGE_SQL} AS s, {OUTPUT_SQL} AS o FROM log) GROUP BY job_id
""")
def e22(spark, sf):
    return L.latest_states(D.log(spark, sf))


@query("h1_progress_percent", f"SELECT job_id, line_no, {PERCENT_SQL} AS progress FROM log")
def h1(spark, sf):
    return D.log(spark, sf).select("job_id", "line_no", PR.percent(F.col("line")).alias("progress"))


@query("h2_progress_dialects", """
SELECT job_id, line_no, least(TRY_CAST(f AS BIGINT), CASE WHEN f <> '' THEN 100 END) AS first_percent,
       TRY_CAST(b AS BIGINT) AS bar_percent, TRY_CAST(b AS BIGINT) AS bar_digits,
       CASE WHEN fr <> '' THEN least(CAST(floor(CAST(fr AS DOUBLE) / 1000 * 100) AS BIGINT), 100) END AS frame_percent
FROM (SELECT *, regexp_extract(line, '(\\d{1,3})%', 1) AS f, regexp_extract(line, '(\\d+)%\\|', 1) AS b, regexp_extract(line, 'frame=\\s*(\\d+) fps', 1) AS fr FROM log)
""")
def h2(spark, sf):
    rules = {"first_percent": PR.first_percent, "bar_percent": PR.bar_percent, "bar_digits": PR.bar_digits, "frame_percent": PR.frame_percent}
    return D.log(spark, sf).select("job_id", "line_no", *[rule(F.col("line")).alias(n) for n, rule in rules.items()])


@query("h3_stage_of_line", f"""
SELECT job_id, line_no, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'starting') AS stage
FROM (SELECT *, {STAGE_SQL} AS s FROM log)
""")
def h3(spark, sf):
    return L.stages(D.log(spark, sf)).select("job_id", "line_no", "stage")


@query("h8_snapshot_then_updates", """
WITH subs AS (SELECT c_custkey AS subscriber_id, c_custkey AS job_id, 1000000000 AS joined_us FROM customer),
     moves AS (SELECT job_id, line_no, ts_us, least(CAST(f AS BIGINT), 100) AS progress FROM (SELECT *, regexp_extract(line, '(\\d{1,3})%', 1) AS f FROM log) WHERE f <> '')
SELECT subscriber_id, s.job_id, 'hello' AS type, -1 AS line_no, coalesce(arg_max(progress, line_no) FILTER (ts_us <= joined_us), 0) AS progress
FROM subs s LEFT JOIN moves m ON m.job_id = s.job_id GROUP BY 1, 2
UNION ALL SELECT subscriber_id, s.job_id, 'progress', line_no, progress FROM subs s JOIN moves m ON m.job_id = s.job_id WHERE ts_us > joined_us
""")
def h8(spark, sf):
    subscribers = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subscriber_id"), F.col("c_custkey").alias("job_id"), F.lit(1_000_000_000).cast("bigint").alias("joined_us")
    )
    return L.snapshots_and_updates(subscribers, D.log(spark, sf))


@query("h12_live_output", f"SELECT job_id, arg_max(o, line_no) FILTER (o IS NOT NULL) AS output_path FROM (SELECT *, {OUTPUT_SQL} AS o FROM log) GROUP BY job_id HAVING count(o) > 0")
def h12(spark, sf):
    return L.live_outputs(D.log(spark, sf))
