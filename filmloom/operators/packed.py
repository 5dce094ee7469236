"""Masks as bits and boxes as spans of lines, so that no step has a row for each cell.

A mask of a frame (row-major) becomes words of 64 cells: ``word`` is the position divided by 64, bit ``i`` of
``bits`` is the cell at ``64 * word + i``. Masks are united, cut and counted on words. A box becomes one row
per line it crosses; overlapping boxes of a line are merged to disjoint spans ``[from, to)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["video_id", "frame_idx"]
WORD = 64


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def bits_of(mask: str | Column) -> Column:
    """The words of a mask array; a cell above 0 is set, a null cell is not."""
    mask = F.col(mask) if isinstance(mask, str) else mask

    def word(w: Column) -> Column:
        return F.aggregate(
            F.slice(mask, w * WORD + 1, WORD), F.struct(_zero().alias("bits"), F.lit(0).alias("i")),
            lambda s, m: F.struct(F.when(m > 0, s["bits"].bitwiseOR(_bit(s["i"]))).otherwise(s["bits"]).alias("bits"), (s["i"] + 1).alias("i")),
            lambda s: s["bits"],
        )

    n = F.size(mask)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / WORD).cast("int")), word)).otherwise(F.array().cast("array<bigint>"))


def is_set(words: Column, position: Column) -> Column:
    """Whether a cell is set in an array of words; cells outside are not."""
    word = F.get(words, F.floor(position / WORD).cast("int"))
    return F.coalesce(F.getbit(word, (position % WORD).cast("int")) == 1, F.lit(False))


def mask_words(masks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``video_id, frame_idx, *keep, cells, word, bits`` of packed masks; ``cells`` is the length of the mask."""
    return masks.select(*KEYS, *keep, F.size("mask").alias("cells"), F.posexplode(bits_of("mask")).alias("word", "bits"))


def united(masks: DataFrame) -> DataFrame:
    """Words of the union of all masks of a frame, combined before the shuffle."""
    return mask_words(masks).groupBy(*KEYS, "word").agg(F.bit_or("bits").alias("bits"), F.max("cells").alias("cells"))


def by_instance(masks: DataFrame, instances: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """One column of words per instance, ``m1`` and so on; an absent mask is empty."""
    own = [F.coalesce(F.bit_or(F.when(F.col("inst") == i, F.col("bits"))), _zero()).alias(f"m{i}") for i in instances]
    return mask_words(masks, ["inst"]).groupBy(*KEYS, "word").agg(F.max("cells").alias("cells"), *own)


def unpacked(words: DataFrame, masks: Sequence[str]) -> DataFrame:
    """``pos`` and a boolean per mask for every cell: the last step, where cells are wanted as rows."""
    cells = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("__i")).withColumn("pos", F.col("word") * WORD + F.col("__i"))
    return cells.filter("pos < cells").select(*KEYS, "pos", *[(F.getbit(m, F.col("__i")) == 1).alias(m) for m in masks])


def lines_of(boxes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each line of a box: ``y, x1, x2``. Empty boxes have none."""
    there = boxes.filter("x2 > x1 AND y2 > y1")
    return there.select(*KEYS, *keep, "x1", "x2", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))


def line_spans(boxes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``spans``: the disjoint stretches of each line under any box, in order.

    Equal stretches are dropped before the shuffle, so the list of a line is bounded by its width, not by the boxes.
    """
    each = lines_of(boxes, keep).distinct().groupBy(*KEYS, *keep, "y").agg(F.array_sort(F.collect_list(F.struct("x1", "x2"))).alias("all"))
    span = "array<struct<from:int,to:int>>"

    def put(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        joined = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["x2"]).alias("to"))))
        return F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["to"] >= x["x1"]), joined).otherwise(F.concat(s, F.array(F.struct(x["x1"].alias("from"), x["x2"].alias("to")))))

    return each.select(*KEYS, *keep, "y", F.aggregate("all", F.array().cast(span), lambda s, x: put(s, x).cast(span)).alias("spans"))


def cover_words(boxes: DataFrame, width: int) -> DataFrame:
    """Words of the cells under any box, for frames of ``width``."""
    spans = line_spans(boxes).select(*KEYS, "y", F.inline("spans"))
    first, last = F.col("y") * width + F.col("from"), F.col("y") * width + F.col("to") - 1
    word = F.explode(F.sequence(F.floor(first / WORD).cast("int"), F.floor(last / WORD).cast("int"))).alias("word")
    parts = spans.select(*KEYS, first.alias("first"), last.alias("last"), word)
    low = F.greatest(F.col("first") - F.col("word") * WORD, F.lit(0)).cast("int")
    high = F.least(F.col("last") - F.col("word") * WORD, F.lit(WORD - 1)).cast("int")
    ones = F.lit(-1).cast("bigint")
    bits = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(WORD - 1) - high))
    return parts.select(*KEYS, "word", bits.alias("bits")).groupBy(*KEYS, "word").agg(F.bit_or("bits").alias("cover"))
