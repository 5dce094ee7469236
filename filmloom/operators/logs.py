"""Job logs: sessions, results, progress, latest state. Columns: job_id, line_no, ts_us, line.

``line_no`` is the arrival order within a job. One job may own most of a log, so nothing here
sorts a whole job in one task: running values go through blocks of lines, and "last" values are
``max_by`` aggregates, which combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions import paths as P
from filmloom.functions import progress as PR
from filmloom.functions import text as T
from filmloom.functions import timecode as TC
from filmloom.plans.ordering import DEFAULT_BLOCK, running

SESSION_MARK = "Video URL:"
FIRST_STAGE = "starting"


def _block(block: int) -> Column:
    return F.floor(F.col("line_no") / block)


def sessions(log: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Non-blank lines with the number of the session they belong to.

    A line with the mark opens a session; lines before the first one are left out.
    """
    lines = log.withColumn("text", T.strip(F.col("line"))).filter("text <> ''")
    opened = running(
        lines, ["job_id"], "line_no", _block(block),
        session_no=("sum", F.when(F.col("text").contains(SESSION_MARK), F.lit(1).cast("bigint"))),
    )
    return opened.filter("session_no > 0")


def session_results(session_lines: DataFrame) -> DataFrame:
    """One row per session: url, input path, final output, status, remarks, line count. Last value wins.

    The lines themselves stay in :func:`sessions`, keyed by session, so no row grows with a session.
    """
    text, low = F.col("text"), F.lower("text")
    value = T.strip(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    kind = (
        F.when(low.startswith("📥 resolved path:") | text.contains("Resolved Path:"), "input")
        .when(low.startswith("final video at:"), "final")
        .when(low.startswith("status:"), "status")
        .when(low.startswith("remarks:"), "remarks")
    )
    tagged = session_lines.withColumns({"kind": kind, "value": value})

    def last(kinds: list[str], what: Column) -> Column:
        hit = F.col("kind").isin(kinds)
        return F.max_by(F.when(hit, what), F.when(hit, F.col("line_no")))

    opens = text.contains(SESSION_MARK)
    url = F.max_by(
        F.when(opens, T.strip(F.substring_index(text, SESSION_MARK, -1))), F.when(opens, F.col("line_no"))
    )
    status = last(["final", "status"], F.when(F.col("kind") == "final", "completed").otherwise(F.col("value")))
    return tagged.groupBy("job_id", "session_no").agg(
        url.alias("video_url"),
        F.coalesce(status, F.lit("running")).alias("status"),
        last(["input"], F.col("value")).alias("input_path"),
        last(["final"], F.col("value")).alias("final_output"),
        last(["remarks"], F.col("value")).alias("remarks"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def final_paths(log: DataFrame) -> DataFrame:
    """The last announced final video per job, as an absolute path."""
    found = log.select("job_id", "line_no", PR.final_path(F.col("line")).alias("path")).filter("path IS NOT NULL")
    return found.groupBy("job_id").agg(F.max_by("path", "line_no").alias("output_path"))


def download_bundle(results: DataFrame, existing: DataFrame, root: str = P.WORKSPACE) -> DataFrame:
    """Outputs that lie inside ``root`` and exist, with their archive names."""
    full = P.resolve_under(F.col("final_output"), root)
    wanted = (
        results.filter("final_output <> ''")
        .withColumn("path", full)
        .filter(P.is_inside(F.col("path"), root))
    )
    name = T.safe_archive_name(F.col("video_url"), P.base_name(F.col("path")))
    return wanted.join(existing.select("path"), "path", "left_semi").select(
        "job_id", "session_no", "path", name.alias("archive_name")
    )


def frame_increments(log: DataFrame, fps: float, total_frames: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Frames gained at each time mark, never negative, and a closing row that completes the total."""
    marks = log.select(
        "job_id", "line_no", TC.frame_at(TC.mark_seconds(F.col("line")), F.lit(float(fps))).alias("frame")
    ).filter("frame IS NOT NULL")
    seen = running(marks, ["job_id"], "line_no", _block(block), seen_before=("max_before", F.col("frame")))
    before = F.coalesce("seen_before", F.lit(0))
    steps = seen.select("job_id", "line_no", F.greatest(F.col("frame") - before, F.lit(0)).alias("gained"), F.lit(False).alias("is_closing"))
    closing = marks.groupBy("job_id").agg(
        F.max("line_no").alias("line_no"), (F.lit(total_frames) - F.max("frame")).alias("gained"), F.lit(True).alias("is_closing")
    )
    return steps.unionByName(closing)


def stages(log: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Each line with the stage its job is in; a stage holds until the next one is announced."""
    known = running(log, ["job_id"], "line_no", _block(block), stage=("last", PR.stage(F.col("line"))))
    return known.withColumn("stage", F.coalesce("stage", F.lit(FIRST_STAGE)))


def latest_states(log: DataFrame) -> DataFrame:
    """Last line, progress, stage and output of each job."""
    line = F.col("line")
    parsed = log.select(
        "job_id", "line_no", "ts_us", "line", PR.percent(line).alias("p"), PR.stage(line).alias("s"), PR.live_output(line).alias("o")
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no")))

    return parsed.groupBy("job_id").agg(
        F.max("line_no").alias("line_no"),
        F.max_by("ts_us", "line_no").alias("updated_us"),
        F.max_by("line", "line_no").alias("last_line"),
        F.coalesce(last("p"), F.lit(0)).alias("progress"),
        F.coalesce(last("s"), F.lit(FIRST_STAGE)).alias("stage"),
        last("o").alias("output"),
    )


def live_outputs(log: DataFrame) -> DataFrame:
    found = log.select("job_id", "line_no", PR.live_output(F.col("line")).alias("path")).filter("path IS NOT NULL")
    return found.groupBy("job_id").agg(F.max_by("path", "line_no").alias("output_path"))


def messages(log: DataFrame) -> DataFrame:
    """JSON events of a log: every line, then the progress it carries."""
    line = F.col("line")
    p = PR.first_percent(line)
    told = F.to_json(F.struct(F.lit("log").alias("type"), line.alias("line")))
    moved = F.to_json(F.struct(F.lit("progress").alias("type"), p.alias("progress")))
    out = F.filter(F.array(told, F.when(p.isNotNull(), moved)), lambda m: m.isNotNull())
    return log.select("job_id", "line_no", F.posexplode(out).alias("part", "message"))


def snapshots_and_updates(subscribers: DataFrame, log: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """What each subscriber is sent: the progress when joining, then each later change.

    Subscribers have ``subscriber_id, job_id, joined_us``. The progress when joining is carried from hour to hour,
    one row per job and hour, so a subscriber meets only the lines of the hour it joins in. The later changes
    are the result itself, one row for each subscriber and change.
    """
    moves = log.select(
        "job_id", "line_no", "ts_us", PR.first_percent(F.col("line")).alias("progress"), F.floor(F.col("ts_us") / bucket_us).alias("hour")
    ).filter("progress IS NOT NULL")
    joins = subscribers.select("subscriber_id", "job_id", "joined_us", F.floor(F.col("joined_us") / bucket_us).alias("hour"))
    keys = ["subscriber_id", "job_id"]
    newest = F.struct("line_no", "progress")
    hours = moves.select("job_id", "hour", newest.alias("m")).unionByName(joins.select("job_id", "hour"), allowMissingColumns=True)
    hours = hours.groupBy("job_id", "hour").agg(F.max("m").alias("m"))
    carried = running(hours, ["job_id"], "hour", F.floor(F.col("hour") / DEFAULT_BLOCK), before=("max_before", F.col("m")))
    this_hour = moves.join(joins, ["job_id", "hour"]).filter("ts_us <= joined_us").groupBy(*keys).agg(F.max(newest).alias("m"))
    known = joins.join(carried.select("job_id", "hour", "before"), ["job_id", "hour"]).join(this_hour, keys, "left")
    hello = known.select(
        *keys, F.lit("hello").alias("type"), F.lit(-1).cast("bigint").alias("line_no"),
        F.coalesce(F.greatest("before", "m")["progress"], F.lit(0)).alias("progress"),
    )
    later = moves.join(subscribers, "job_id").filter("ts_us > joined_us").select(*keys, F.lit("progress").alias("type"), "line_no", "progress")
    return hello.unionByName(later)
