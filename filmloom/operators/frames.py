"""Frame relations: sync joins, masked merges, blends, order and sampling.

Columns: video_id, frame_idx (dense per video), h, w, px (row-major array). Work on one frame
stays in its row through array functions, so only frames, strips of them or words of 64 mask cells are shuffled,
never single pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions.color import to_byte
from filmloom.functions.geometry import deflicker_size
from filmloom.operators.packed import is_set, united
from filmloom.operators.scenes import SEGMENT
from filmloom.plans.ordering import DEFAULT_BLOCK, join_on, number_rows, running, with_halo

KEYS = ["video_id", "frame_idx"]
STRIP = 4096  # cells of a picture in one row, where pictures meet several masks


def plane_sum(px: str | Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("bigint"), lambda total, v: total + v)


def plane_mean(px: str | Column) -> Column:
    return plane_sum(px) / F.size(px)


# joins


def zip_positions(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str],
    left_buckets: Sequence[Column], right_buckets: Sequence[Column], strict: bool,
) -> DataFrame:
    """Pair the n-th rows of both sides within a key.

    ``strict`` fails when the counts differ; otherwise the longer side is cut.
    """
    a = number_rows(left, keys, left_order, left_buckets, "pos").withColumn("__left", F.lit(True))
    b = number_rows(right, keys, right_order, right_buckets, "pos").withColumn("__right", F.lit(True))
    joined = a.join(b, [*keys, "pos"], "full_outer" if strict else "inner")
    if strict:
        unpaired = F.col("__left").isNull() | F.col("__right").isNull()
        message = F.concat(F.lit("counts differ at position "), F.col("pos").cast("string"))
        joined = joined.filter(F.when(unpaired, F.raise_error(message).cast("boolean")).otherwise(True))
    return joined.drop("__left", "__right")


def in_sync(*videos: DataFrame) -> DataFrame:
    """Frames with the same index in every input; the shortest input ends the result."""
    out = videos[0]
    for other in videos[1:]:
        out = out.join(other, KEYS)
    return out


def with_scene(cuts: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The scene number of every frame."""
    found = running(
        cuts.select(*KEYS, "is_cut"), ["video_id"], "frame_idx", F.floor(F.col("frame_idx") / block),
        scene_id=("sum", F.when(F.col("is_cut"), F.lit(1).cast("bigint"))),
    )
    return found.select(*KEYS, (F.col("scene_id") + 1).alias("scene_id"))


def with_reference(scene_frames: DataFrame, references: DataFrame) -> DataFrame:
    """Put the one reference of a scene beside each of its frames.

    References are one row per scene. Spark broadcasts them when they are small and otherwise
    joins on ``(video_id, scene_id)``, splitting scenes that hold many frames.
    """
    return scene_frames.join(references, ["video_id", "scene_id"])


def explode_plane(df: DataFrame, plane: str, keys: Sequence[str] = KEYS, name: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(plane).alias("pos", name))


def pack_plane(cells: DataFrame, value: str, keys: Sequence[str] = KEYS, name: str = "plane") -> DataFrame:
    """Cells of a frame back to one array in position order; as long as the frame has cells."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["v"]).alias(name))


def masked_replace(source: DataFrame, target: DataFrame, masks: DataFrame) -> DataFrame:
    """The source pixel where any mask of the frame is set, the target pixel elsewhere.

    Frames without masks keep the target. Masks are united as words of 64 cells; the two pictures stay packed.
    """
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    union = united(masks).groupBy(*KEYS).agg(F.transform(ordered, lambda w: w["bits"]).alias("mask"))
    both = in_sync(
        source.select(*KEYS, F.col("px").alias("source")), target.select(*KEYS, F.col("px").alias("target"))
    ).join(union, KEYS, "left")
    picked = F.transform(
        F.arrays_zip("source", "target"), lambda p, i: F.when(is_set(F.col("mask"), i), p["source"]).otherwise(p["target"])
    )
    return both.select(*KEYS, F.when(F.col("mask").isNull(), F.col("target")).otherwise(picked).alias("px"))


def in_strips(df: DataFrame, planes: Sequence[str], keep: Sequence[str] = (), cells: int = STRIP) -> DataFrame:
    """Planes cut into strips of ``cells``, one row for each ``strip``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(planes[0]) - 1, F.lit(0)), F.lit(cells))
    cut = df.select(*KEYS, *keep, *planes, F.posexplode(starts).alias("strip", "__at"))
    return cut.select(*KEYS, *keep, "strip", *[F.slice(p, F.col("__at") + 1, cells).alias(p) for p in planes])


def alpha_blend(base: DataFrame, overlay: DataFrame, masks: DataFrame) -> DataFrame:
    """``m * new + (1 - m) * old``, cut to a whole number after each instance, in instance order.

    The steps do not commute, so the masks of one pixel are applied one after the other; masks of 0 change nothing. Pictures
    and masks meet in strips of ``STRIP`` cells: a row holds that many cells of each instance of a frame. ``inst`` may be any
    whole number; a null one fails the query.
    """
    numbered = F.coalesce("inst", F.raise_error(F.lit("a mask without an instance")).cast("bigint"))
    steps = in_strips(masks.withColumn("inst", numbered), ["mask"], ["inst"]).groupBy(*KEYS, "strip").agg(
        F.array_sort(F.collect_list(F.struct("inst", "mask"))).alias("steps")
    )
    both = in_sync(base.select(*KEYS, F.col("px").alias("old")), overlay.select(*KEYS, F.col("px").alias("new")))
    strips = in_strips(both, ["old", "new"]).join(steps, [*KEYS, "strip"], "left")

    def blended(cell: Column, i: Column) -> Column:
        def step(v: Column, s: Column) -> Column:
            m = F.get(s["mask"], i)
            return F.when(m > 0, F.floor(m * cell["new"] + (F.lit(1.0) - m) * v).cast("double")).otherwise(v)

        return F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), cell["old"].cast("double"), step).cast("int")

    out = strips.select(*KEYS, "strip", F.transform(F.arrays_zip("old", "new"), blended).alias("v"))
    return out.select(*KEYS, "strip", F.posexplode("v").alias("__i", "v")).select(*KEYS, (F.col("strip") * STRIP + F.col("__i")).alias("pos"), "v")


# aggregates


def scene_brightness(scene_frames: DataFrame, dark_below: int = 55, mean_limit: float = 55, share_limit: float = 0.6) -> DataFrame:
    """Mean brightness and mean share of dark pixels per scene, and whether both say dark."""
    dark = F.size(F.filter("px", lambda v: v < dark_below)) / F.size("px")
    per_frame = scene_frames.select("video_id", "scene_id", plane_mean("px").alias("mean"), dark.alias("dark"))
    scenes = per_frame.groupBy("video_id", "scene_id").agg(F.avg("mean").alias("brightness"), F.avg("dark").alias("dark_share"))
    return scenes.withColumn("is_dark", (F.col("brightness") <= mean_limit) & (F.col("dark_share") >= share_limit))


def lab_blend(sources: DataFrame, n: int = 3) -> DataFrame:
    """Blend packed planes ``l1, a1, b1, l2, ...`` of n sources.

    Lightness is the mean; both chroma planes come from the source with the strongest chroma
    (around 128), the first one on ties.
    """
    planes = [f"{p}{s}" for s in range(1, n + 1) for p in "lab"]

    def strength(p: Column, s: int) -> Column:
        a, b = p[f"a{s}"] - 128, p[f"b{s}"] - 128
        return a * a + b * b

    def pixel(p: Column) -> Column:
        light = F.floor(sum(p[f"l{s}"] for s in range(1, n + 1)) / n)
        best = F.greatest(*[strength(p, s) for s in range(1, n + 1)])
        a, b = p[f"a{n}"], p[f"b{n}"]
        for s in range(n - 1, 0, -1):
            a = F.when(strength(p, s) == best, p[f"a{s}"]).otherwise(a)
            b = F.when(strength(p, s) == best, p[f"b{s}"]).otherwise(b)
        return F.struct(light.cast("int").alias("l"), a.alias("a"), b.alias("b"))

    return sources.select(*KEYS, F.transform(F.arrays_zip(*planes), pixel).alias("lab"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


def with_fallback(restored: DataFrame, original: DataFrame, minimum: int = 5) -> DataFrame:
    """Restored frames, except that a video with fewer than ``minimum`` of them keeps its original."""
    enough = frame_counts(restored).filter(F.col("n") >= minimum).select("video_id")
    return restored.join(enough, "video_id", "left_semi").unionByName(original.join(enough, "video_id", "left_anti"))


def thumbnails(frames: DataFrame, window: int) -> DataFrame:
    """Per window of frames, the one whose histogram is closest to the window's mean histogram.

    Squared errors are compared after multiplying by the squared frame count, in whole
    numbers, so ties are real; the earlier frame wins them. Histograms are shuffled once to
    their window, at most 256 rows per frame, and every later step stays there.
    """
    keys = ["video_id", "win"]
    tagged = frames.select("video_id", F.floor(F.col("frame_idx") / window).alias("win"), "frame_idx", F.explode("px").alias("v"))
    hist = tagged.groupBy(*keys, "frame_idx", "v").agg(F.count(F.lit(1)).alias("c")).repartition(*keys)
    with_sum = hist.withColumn("s", F.sum("c").over(Window.partitionBy(*keys, "v")))
    per_frame = with_sum.groupBy(*keys, "frame_idx").agg(
        F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("s")).alias("cs")
    )
    whole = Window.partitionBy(*keys)
    scored = per_frame.withColumns({"n": F.count(F.lit(1)).over(whole), "ss": F.sum("cs").over(whole)})
    n = F.col("n")
    error = n * n * F.col("cc") - n * 2 * F.col("cs") + F.col("ss")
    return scored.groupBy(*keys).agg(F.min_by("frame_idx", F.struct(error, "frame_idx")).alias("frame_idx"))


# order and sampling


def deflicker(frames: DataFrame, exponent: float = 3.0, longest: int = 16, segment: int = SEGMENT) -> DataFrame:
    """Scale each frame to the power mean of luma over the coming frames, itself included.

    The window holds a quarter of the video's frames, from 4 to ``longest``.
    """
    sizes = frame_counts(frames).select("video_id", deflicker_size(F.col("n")).alias("size"))
    luma = frames.select(*KEYS, plane_mean("px").alias("luma"))
    cut = with_halo(luma, "frame_idx", segment, after=longest - 1)
    w = Window.partitionBy("video_id", "segment").orderBy("frame_idx").rowsBetween(0, longest - 1)
    near = cut.withColumn("near", F.collect_list("luma").over(w)).filter("is_own").join(sizes, "video_id")
    used = F.slice("near", F.lit(1), F.col("size").cast("int"))
    powers = F.aggregate(used, F.lit(0.0), lambda total, v: total + F.pow(v, F.lit(exponent)))
    level = F.pow(powers / F.size(used), F.lit(1.0 / exponent))
    return near.select(*KEYS, "luma", level.alias("level"), F.when(F.col("luma") > 0, level / F.col("luma")).otherwise(1.0).alias("gain"))


def apply_gain(frames: DataFrame, gains: DataFrame) -> DataFrame:
    scaled = F.transform("px", lambda v: to_byte(v * F.col("gain")))
    return frames.join(gains.select(*KEYS, "gain"), KEYS).withColumn("px", scaled).drop("gain")


def reversed_frames(frames: DataFrame) -> DataFrame:
    """Last frame first. Needs each video's length only, no ordering."""
    counted = frames.join(frame_counts(frames), "video_id")
    return counted.withColumn("frame_idx", F.col("n") - 1 - F.col("frame_idx")).drop("n")


def concatenated(groups: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """One index over all groups of a video, in numeric group order and then by ``idx``."""
    return number_rows(
        groups, ["video_id"], ["scene_num", "idx"], [F.col("scene_num"), F.floor(F.col("idx") / block)], "frame_no"
    )


def equal_chunks(frames: DataFrame, chunks: int) -> DataFrame:
    """``ceil(n / chunks)`` frames per chunk."""
    counted = frames.join(frame_counts(frames), "video_id")
    per_chunk = F.ceil(F.col("n") / chunks)
    return counted.withColumn("chunk_no", F.floor(F.col("frame_idx") / per_chunk)).drop("n")


def every_kth(frames: DataFrame, k: int) -> DataFrame:
    """Frames k, 2k, ... counted from 1."""
    return frames.filter((F.col("frame_idx") + 1) % k == 0)


def time_range(frames: DataFrame, fps: float, start: float, end: float) -> DataFrame:
    """Frames from ``start`` to before ``end``, as whole bounds on the frame index so they reach the scan."""
    first, after = (math.ceil(Fraction(second) * Fraction(fps)) for second in (start, end))
    return frames.filter((F.col("frame_idx") >= first) & (F.col("frame_idx") < after))


def time_chunks(frames: DataFrame, fps: float, seconds: float) -> DataFrame:
    return frames.withColumn("chunk_no", F.floor(F.col("frame_idx") / F.lit(float(fps * seconds))))


def capped(frames: DataFrame, max_frames: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") < max_frames)


def write_ordered(frames: DataFrame, path: str, files: int | None = None) -> None:
    """Frames in order: ranges of frames per file, sorted inside."""
    ranged = frames.repartitionByRange(files, *KEYS) if files else frames.repartitionByRange(*KEYS)
    ranged.sortWithinPartitions(*KEYS).write.parquet(path)


def _draw(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def _draw_bucket() -> Column:
    """One of 65,536 equal ranges of the draw, for a table of any size."""
    return F.substring("__draw", 1, 4)


def random_split(frames: DataFrame, seed: int, ratio: float = 0.95) -> DataFrame:
    """Mark ``floor(n * (1 - ratio))`` frames of each video as validation, drawn by hash order.

    The limit of a video is found in a histogram of draws: ranges below it are in, ranges above are out, and only the
    frames of the one range that the limit falls into are ranked. Null videos are one video.
    """
    drawn = frames.withColumn("__draw", _draw(seed, *KEYS)).withColumn("__range", _draw_bucket())
    counts = drawn.groupBy("video_id", "__range").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("video_id")
    upto = counts.select("video_id", "__range", "n", F.sum("n").over(own.orderBy("__range")).alias("upto"), F.floor(F.sum("n").over(own) * (1.0 - ratio)).alias("__k"))
    limit = upto.filter("upto >= __k").groupBy("video_id").agg(
        F.min("__range").alias("__edge"), F.min_by(F.col("__k") - (F.col("upto") - F.col("n")), "__range").alias("__rest")
    )
    placed = join_on(drawn, limit, ["video_id"])
    clear = placed.filter("__range <> __edge").withColumn("is_validation", F.col("__range") < F.col("__edge"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("__draw", "frame_idx"))
    edge = placed.filter("__range = __edge").withColumn("is_validation", rank <= F.col("__rest"))
    return clear.unionByName(edge).select(*frames.columns, "is_validation")


def shuffled_batches(batches: DataFrame, seed: int) -> DataFrame:
    """A new position for every batch by hash order; what is in a batch stays."""
    drawn = batches.withColumn("__draw", _draw(seed, "video_id", "batch_no"))
    return number_rows(drawn, ["video_id"], ["__draw", "batch_no"], [_draw_bucket()], "new_pos").drop("__draw")


def tone(px: Column, rule) -> Column:
    """Apply a per-value column rule to a packed plane."""
    return F.transform(px, lambda v: rule(v))
