"""Scene cuts, intervals, pieces and representative frames.

Frames carry a dense ``frame_idx`` per video, so ordered steps cut a video into segments
instead of putting a whole video in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.plans.ordering import DEFAULT_BLOCK, number_rows, running, with_halo
from filmloom.plans.storage import write_through

SEGMENT = 256  # frames per segment


def content_scores(frames: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Mean absolute change of luma from the previous frame; the first frame scores 0."""
    cut = with_halo(frames.select("video_id", "frame_idx", "px"), "frame_idx", segment, before=1)
    w = Window.partitionBy("video_id", "segment").orderBy("frame_idx")
    change = F.aggregate(
        F.zip_with("px", "previous", lambda a, b: F.abs(a - b)), F.lit(0), lambda total, v: total + v
    )
    return (
        cut.withColumn("previous", F.lag("px").over(w))
        .filter("is_own")
        .select("video_id", "frame_idx", F.coalesce(change / F.size("px"), F.lit(0.0)).alias("score"))
    )


def adaptive_cuts(
    scores: DataFrame, threshold: float = 2.5, floor: float = 15.0, reach: int = 2, segment: int = 16 * SEGMENT
) -> DataFrame:
    """Cut where the score is ``threshold`` times its neighbours' mean and at least ``floor``.

    Up to ``reach`` neighbours on each side count. Still neighbours give a ratio of 255, or 0
    below the floor.
    """
    cut = with_halo(scores, "frame_idx", segment, before=reach, after=reach)
    w = Window.partitionBy("video_id", "segment").orderBy("frame_idx")
    sides = [w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)]
    total = sum(F.coalesce(F.sum("score").over(s), F.lit(0.0)) for s in sides)
    count = sum(F.count("score").over(s) for s in sides)
    ratio = (
        F.when(F.col("near_sum") > 0, F.col("score") / (F.col("near_sum") / F.col("near_n")))
        .when(F.col("score") >= floor, 255.0)
        .otherwise(0.0)
    )
    return (
        cut.withColumns({"near_sum": total, "near_n": count})
        .filter("is_own")
        .select("video_id", "frame_idx", "score", ratio.alias("ratio"))
        .withColumn("is_cut", (F.col("ratio") >= threshold) & (F.col("score") >= floor))
    )


def scene_intervals(cuts: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``[start, end)`` per scene, numbered from 1. Without a cut the whole video is one scene."""
    numbered = running(
        cuts.select("video_id", "frame_idx", "is_cut"), ["video_id"], "frame_idx",
        F.floor(F.col("frame_idx") / block), cuts_so_far=("sum", F.when(F.col("is_cut"), F.lit(1).cast("bigint"))),
    )
    return numbered.groupBy("video_id", (F.col("cuts_so_far") + 1).alias("scene_id")).agg(
        F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame")
    )


def split_long(intervals: DataFrame, max_frames: int) -> DataFrame:
    """Pieces of at most ``max_frames``; empty pieces are left out."""
    pieces = intervals.filter("end_frame > start_frame").withColumn(
        "piece_start", F.explode(F.sequence("start_frame", F.col("end_frame") - 1, F.lit(max_frames).cast("bigint")))
    )
    return pieces.select(
        *[c for c in intervals.columns if c not in ("start_frame", "end_frame")],
        F.col("piece_start").alias("start_frame"),
        F.least(F.col("piece_start") + max_frames, "end_frame").alias("end_frame"),
    )


def first_enclosing(pieces: DataFrame, scenes: DataFrame, bin_frames: int = 4 * SEGMENT) -> DataFrame:
    """Add the lowest ``scene_id`` whose interval holds the whole piece, or 0.

    Scenes are listed in every bin of frames they cover and pieces in the bin they start in, so
    the join is on ``(video_id, bin)`` and a piece only meets scenes near it.
    """
    keys = ["video_id", "start_frame", "end_frame"]
    bins = scenes.select(
        "video_id", "scene_id", F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"),
        F.explode(F.sequence(F.floor(F.col("start_frame") / bin_frames), F.floor((F.col("end_frame") - 1) / bin_frames))).alias("bin"),
    )
    placed = pieces.withColumn("bin", F.floor(F.col("start_frame") / bin_frames))
    near = placed.select(*keys, "bin").join(bins, ["video_id", "bin"])
    inside = near.filter((F.col("start_frame") >= F.col("lo")) & (F.col("end_frame") <= F.col("hi")))
    first = inside.groupBy(*keys).agg(F.min("scene_id").alias("scene_id"))
    return pieces.join(first, keys, "left").withColumn("scene_id", F.coalesce("scene_id", F.lit(0).cast("bigint")))


def with_middle(pieces: DataFrame) -> DataFrame:
    """The middle frame of an interval: start plus half the length, cut."""
    half = F.floor((F.col("end_frame") - F.col("start_frame")) / 2)
    return pieces.withColumn("mid_frame", F.col("start_frame") + half)


def at_middle(pieces: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame rows at the middle of each piece."""
    mids = with_middle(pieces).withColumnRenamed("mid_frame", "frame_idx")
    return mids.join(frames, ["video_id", "frame_idx"])


def ordered_members(pieces: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """0-based position of each piece in its scene, and the scene's size ``n``."""
    return number_rows(
        pieces, ["video_id", "scene_id"], ["start_frame"], [F.floor(F.col("start_frame") / block)], "pos", total="n"
    )


def lower_middle(members: DataFrame) -> DataFrame:
    """One member per group: ``n // 2`` of an odd count, the lower of the two middles of an even one."""
    return members.filter(F.col("pos") == F.floor((F.col("n") - 1) / 2))


def detect(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts and scene intervals of all videos.

    Scores and intervals are written once, one narrow row per frame and per scene: everything
    after them reads those tables and the pictures are scanned a single time.
    """
    scores = write_through(content_scores(frames), "scores")
    cuts = adaptive_cuts(scores)
    return cuts, write_through(scene_intervals(cuts), "scenes")


def representatives(frames: DataFrame, fps: int, max_seconds: float = 1.0) -> DataFrame:
    """Scenes, pieces, middle frames, one piece per scene: the representative frame of each scene.

    Pieces keep the number of the scene they were cut from, which is what
    :func:`first_enclosing` would find for them.
    """
    _, scenes = detect(frames)
    pieces = split_long(scenes, max(1, int(fps * max_seconds)))
    members = ordered_members(with_middle(pieces))
    return lower_middle(members).select("video_id", "scene_id", F.col("mid_frame").alias("frame_idx"), F.col("n").alias("pieces"))


def named_groups(members: DataFrame, per_row: int = 1024) -> DataFrame:
    """Piece names of a scene in order, as lists of at most ``per_row`` names numbered by ``part``."""
    name = F.format_string("Scene-%03d", F.col("pos") + 1)
    ordered = F.array_sort(F.collect_list(F.struct("pos", name.alias("name"))))
    return members.groupBy("video_id", "scene_id", F.floor(F.col("pos") / per_row).alias("part")).agg(
        F.transform(ordered, lambda m: m["name"]).alias("names")
    )


def reference_frames(intervals: DataFrame, fps: float) -> DataFrame:
    """First, middle and last reference of each clip.

    A clip longer than 4 s gets 1 s windows at 1.0, at half minus 0.5 and at the end minus 1. A
    shorter one gets a window at 0, the frame ``n // 2`` and the last frame.
    """
    n = F.col("end_frame") - F.col("start_frame")
    seconds = n / F.lit(float(fps))
    is_long = seconds > 4
    no_second, no_frame = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def ref(number: int, at_long: Column, second: Column, frame: Column) -> Column:
        return F.struct(
            F.lit(number).alias("ref_no"),
            F.when(is_long, at_long).otherwise(second).alias("window_start"),
            F.when(~is_long, frame).alias("frame_no"),
        )

    refs = F.array(
        ref(1, F.lit(1.0), F.lit(0.0), no_frame),
        ref(2, F.greatest(seconds / 2 - 0.5, F.lit(0.0)), no_second, F.floor(n / 2)),
        ref(3, seconds - 1.0, no_second, n - 1),
    )
    return intervals.select("video_id", "scene_id", F.inline(refs))
