"""Batches of frames for grid-wise model calls: fixed, overlapping, filled, placed on a grid.

Members carry ``pos``, their dense position in a group; sizes and slots follow from it without
ordering anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions.geometry import fitted, grid_cell

# Slots per grid, grid columns, frames shared by neighbouring batches.
SLOTS, COLUMNS, OVERLAP = 6, 2, 2


def fixed_batches(members: DataFrame, size: int, position: str = "pos") -> DataFrame:
    return members.withColumns({"batch_no": F.floor(F.col(position) / size), "slot": F.col(position) % size})


def batch_bounds(members: DataFrame, keys: Sequence[str], size: int, position: str = "pos") -> DataFrame:
    """``[start, end)`` of every batch; the last one may be short."""
    return fixed_batches(members, size, position).groupBy(*keys, "batch_no").agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end")
    )


def overlapping_batches(members: DataFrame, size: int = SLOTS, overlap: int = OVERLAP) -> DataFrame:
    """Every batch a member appears in, its slot there, and whether it is saved from it.

    Batches start every ``size - overlap`` members. The first slots of a later batch repeat
    members that the batch before has already saved, so each member is saved once.
    """
    stride = size - overlap
    own = F.floor(F.col("pos") / stride)
    earlier = F.when((F.col("pos") % stride < overlap) & (own > 0), own - 1)
    tagged = members.withColumn("batch_no", F.explode(F.array(own, earlier))).filter("batch_no IS NOT NULL")
    slot = F.col("pos") - F.col("batch_no") * stride
    return tagged.withColumn("slot", slot).withColumn("is_saved", (F.col("batch_no") == 0) | (F.col("slot") >= overlap))


def filled_slots(batched: DataFrame, keys: Sequence[str], size: int = SLOTS, repeat_last: bool = True) -> DataFrame:
    """All slots of every batch. Free slots repeat the last member, or stay blank; ``is_fill`` marks them."""
    sizes = batched.groupBy(*keys, "batch_no").agg((F.max("slot") + 1).alias("used"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(*[F.lit(i).cast("bigint") for i in (0, size - 1)])))
    source = F.least("slot", F.col("used") - 1) if repeat_last else F.col("slot")
    wanted = slots.select(
        *keys, "batch_no", F.col("slot").alias("to_slot"), source.alias("slot"), (F.col("slot") >= F.col("used")).alias("is_fill")
    )
    return wanted.join(batched, [*keys, "batch_no", "slot"], "left").drop("slot").withColumnRenamed("to_slot", "slot")


def without_fill(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("is_fill"))


def placed_on_grid(
    members: DataFrame, width: Column, height: Column, cell_width: Column, cell_height: Column, columns: int = COLUMNS
) -> DataFrame:
    """Grid row and column of a slot, the fitted size and the pixel offset of its picture."""
    row, column = grid_cell(F.col("slot"), columns)
    w, h, pad_x, pad_y = fitted(width, height, cell_width, cell_height)
    return members.withColumns(
        {
            "grid_row": row, "grid_col": column, "fit_w": w, "fit_h": h,
            "x": column * cell_width + pad_x, "y": row * cell_height + pad_y,
        }
    )
