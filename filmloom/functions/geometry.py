"""Sizes of videos, canvases, grids and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(frame_count: Column, fps: Column) -> Column:
    return F.try_divide(frame_count.cast("double"), fps)


def default_scale(height: Column) -> Column:
    return F.when(height > 500, "2").otherwise("1")


def downscaled(width: Column, height: Column, scale: int = 4, minimum: int = 256) -> tuple[Column, Column]:
    """Divide both sides; if one falls below the minimum, set the short side to it and keep the aspect."""
    w, h = F.floor(width / scale), F.floor(height / scale)
    small = (w < minimum) | (h < minimum)
    upright = width < height
    aspect = width / height
    new_w = F.when(~small, w).when(upright, minimum).otherwise(F.rint(minimum * aspect).cast("bigint"))
    new_h = F.when(~small, h).when(upright, F.rint(minimum / aspect).cast("bigint")).otherwise(minimum)
    return new_w, new_h


def should_shrink(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Only when the target is smaller on at least one side."""
    return ~((width <= to_width) & (height <= to_height))


def deflicker_size(frame_count: Column) -> Column:
    return F.least(F.greatest(F.floor(frame_count / 4), F.lit(4)), F.lit(16))


def mix_size(frame_count: Column) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(frame_count / 10)))


def stacked_canvas(
    width: Column, height: Column, other_width: Column, other_height: Column
) -> tuple[Column, Column, Column]:
    """Layout, width and height when a third-size second video sits below (landscape) or beside."""
    small_w, small_h = F.floor(other_width * (1 / 3.0)), F.floor(other_height * (1 / 3.0))
    landscape = width > height
    return (
        F.when(landscape, "landscape").otherwise("portrait"),
        F.when(landscape, F.greatest(width, small_w)).otherwise(width + small_w),
        F.when(landscape, height + small_h).otherwise(F.greatest(height, small_h)),
    )


def side_by_side(w1: Column, h1: Column, w2: Column, h2: Column) -> tuple[Column, Column]:
    height = F.least(h1, h2)
    return F.floor(w1 * height / h1) + F.floor(w2 * height / h2), height


def grid_cell(slot: Column, columns: int) -> tuple[Column, Column]:
    return F.floor(slot / columns), slot % columns


def fitted(
    width: Column, height: Column, cell_width: Column, cell_height: Column
) -> tuple[Column, Column, Column, Column]:
    """Size after fitting a cell with the aspect kept, and the padding that centres it."""
    scale = F.least(cell_width / width, cell_height / height)
    w, h = F.floor(width * scale), F.floor(height * scale)
    return w, h, F.floor((cell_width - w) / 2), F.floor((cell_height - h) / 2)
