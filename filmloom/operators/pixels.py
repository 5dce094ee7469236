"""Pixel relations: masks, regions, tiles, local contrast, sharpness, stacks.

Columns: video_id, frame_idx, y, x and values. All keys hold the frame, so work spreads over
frames, tiles and positions and never gathers a video.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.functions import color as C
from filmloom.plans.graph import smallest_reachable
from filmloom.plans.storage import write_through

KEYS = ["video_id", "frame_idx"]
CELL = [*KEYS, "y", "x"]


# masks


def exclusive_masks(words: DataFrame) -> DataFrame:
    """From the words of masks m1..m4: A is m1 alone; B is m2 or m3 without m1 and m4."""
    m1, m2, m3, m4 = (F.col(f"m{i}") for i in range(1, 5))
    a = m1.bitwiseAND(F.bitwise_not(m2.bitwiseOR(m3).bitwiseOR(m4)))
    return words.withColumns({"mask_a": a, "mask_b": m2.bitwiseOR(m3).bitwiseAND(F.bitwise_not(m1.bitwiseOR(m4)))})


def gray_masks(named: DataFrame) -> DataFrame:
    """The gray form: A is g1 minus the largest of the others, not below 0; B is the larger of g2 and g3."""
    g = [F.col(f"g{i}") for i in range(1, 5)]
    body = g[1].bitwiseOR(g[2])
    return named.withColumns(
        {"gray_a": F.greatest(g[0] - body.bitwiseOR(g[3]), F.lit(0)), "gray_b": body}
    )


def restricted(words: DataFrame, cover: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Masks cleared outside the covered cells (``packed.cover_words``)."""
    marked = words.join(cover, [*KEYS, "word"], "left").withColumn("cover", F.coalesce("cover", F.lit(0).cast("bigint")))
    return marked.withColumns({m: F.col(m).bitwiseAND(F.col("cover")) for m in masks}).drop("cover")


def without_empty(words: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Set-cell counts per frame and mask, and whether the frame's masks are all empty and discarded."""
    counts = words.groupBy(*KEYS).agg(*[F.sum(F.bit_count(m).cast("bigint")).alias(f"n_{m}") for m in masks])
    empty = F.lit(True)
    for m in masks:
        empty = empty & (F.col(f"n_{m}") == 0)
    return counts.withColumn("discarded", empty)


# regions


def _label(masks: np.ndarray) -> np.ndarray:
    """Per picture of a stack: the smallest position of each 8-connected region, plus 1; 0 outside.

    Every pixel takes the smallest label around it, then its label's own label, until nothing changes.
    """
    n, h, w = masks.shape
    far = h * w + 1
    label = np.where(masks, np.arange(1, far).reshape(h, w), far)
    while True:
        padded = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        best = label
        for dy in range(3):
            for dx in range(3):
                best = np.minimum(best, padded[:, dy : dy + h, dx : dx + w])
        best = np.where(masks, best, far).reshape(n, -1)
        own = np.concatenate([best, np.full((n, 1), far)], axis=1)
        new = np.take_along_axis(own, best - 1, axis=1).reshape(n, h, w)
        if np.array_equal(new, label):
            return np.where(masks, label, 0)
        label = new


def connected_regions(frames: DataFrame, mask: str = "mask") -> DataFrame:
    """Add ``labels``: per pixel the number of its 8-neighbour region, 0 outside the mask.

    A frame is one row, so a region never crosses rows: no shuffle, no rounds of joins. The
    loop needs a fixed point, which column expressions cannot state, hence an Arrow UDF. Frames
    of one size are labelled together, a few million pixels at a time.
    """

    @F.pandas_udf("array<int>")
    def label(masks: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(masks), dtype=object)
        sizes = pd.DataFrame({"h": heights, "w": widths}).groupby(["h", "w"]).indices
        for (h, w), where in sizes.items():
            step = max(1, 4_000_000 // max(1, h * w))
            for start in range(0, len(where), step):
                part = where[start : start + step]
                stack = np.stack([np.asarray(masks.iloc[i]) for i in part]).reshape(-1, h, w) > 0
                for i, labels in zip(part, _label(stack).reshape(len(part), -1).astype("int32")):
                    out.iloc[i] = labels
        return out

    # Not repeatable in Spark's eyes, so no filter that Spark derives from the result calls it a second time.
    return frames.withColumn("labels", label.asNondeterministic()(F.col(mask), F.col("h"), F.col("w")))


TILE = [*KEYS, "top", "left"]


def connected_regions_of_tiles(tiles: DataFrame, width: int, mask: str = "mask") -> DataFrame:
    """Add ``labels`` to tiles of pictures of ``width``: the same numbers as :func:`connected_regions` gives whole pictures.

    ``tiles`` has ``video_id, frame_idx, top, left`` (where it lies), ``h, w`` and the mask; tiles do not overlap. Each tile is labelled
    by itself; regions that touch over tile borders, cell by cell of the borders, are edges of a graph, and its components give a region
    its smallest label. So a picture never has to fit one row; rows beyond the tiles grow with the length of the borders.
    """
    def at(label: Column) -> Column:
        """Label in the tile to position in the picture, plus 1; order is kept."""
        return (F.floor((label - 1) / F.col("w")) + F.col("top")) * width + (label - 1) % F.col("w") + F.col("left") + 1

    own = connected_regions(tiles, mask).withColumn("labels", F.transform("labels", lambda x: F.when(x > 0, at(x)).otherwise(0).cast("bigint")))
    own = write_through(own, "tile-labels")
    h, w = F.col("h"), F.col("w")
    # Positions of the four borders, corners once.
    border = F.array_distinct(F.concat(
        F.sequence(F.lit(0), w - 1), F.sequence((h - 1) * w, h * w - 1), F.sequence(F.lit(0), (h - 1) * w, w), F.sequence(w - 1, h * w - 1, w)
    ))
    cells = own.filter("h > 0 AND w > 0").select(*TILE, "w", "labels", F.explode(border).alias("i")).select(
        *TILE, (F.floor(F.col("i") / w) + F.col("top")).alias("y"), (F.col("i") % w + F.col("left")).alias("x"), F.get("labels", F.col("i")).alias("label")
    ).filter("label > 0")
    node = F.struct(*KEYS, "label")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    here = cells.select(*KEYS, node.alias("a"), F.struct("top", "left").alias("tile_a"), "y", "x", F.inline(steps)).select(
        *KEYS, "a", "tile_a", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")
    )
    there = cells.select(*KEYS, "y", "x", node.alias("b"), F.struct("top", "left").alias("tile_b"))
    # Merged, not broadcast: the written labels pack into a small part of what their cells take, so Spark would take them for small.
    edges = here.join(there.hint("merge"), [*KEYS, "y", "x"]).filter("tile_a <> tile_b AND a <> b").select("a", "b").distinct()
    roots = smallest_reachable(edges).filter("node <> root").select("node.*", F.col("root.label").alias("root"))
    named = cells.select(*TILE, "label").distinct().join(roots.hint("merge"), [*KEYS, "label"]).groupBy(*TILE).agg(
        F.array_sort(F.collect_list(F.struct("label", "root"))).alias("merged")
    )

    @F.pandas_udf("array<bigint>")
    def renamed(labels: pd.Series, merged: pd.Series) -> pd.Series:
        out = []
        for cells, pairs in zip(labels, merged, strict=True):
            if pairs is not None and len(pairs):
                old, new = (np.array([p[k] for p in pairs]) for k in ("label", "root"))
                place = np.minimum(np.searchsorted(old, cells), len(old) - 1)
                cells = np.where(old[place] == cells, new[place], cells)
            out.append(cells)
        return pd.Series(out)

    return own.join(named.hint("merge"), TILE, "left").withColumn("labels", renamed("labels", "merged")).drop("merged")


def region_color_transfer(
    cells: DataFrame, fixed: tuple[int, int] | None = None, planes: Sequence[str] = ("a", "b"), donors: Sequence[str] = ("new_a", "new_b")
) -> DataFrame:
    """Inside regions set both chroma planes to the donor's mean per region, cut, or to fixed values.

    ``cells`` has ``region`` (0 outside), lightness and both pairs of planes.
    """
    names = cells.columns
    inside = F.col("region") > 0
    if fixed is not None:
        values = [F.lit(v) for v in fixed]
    else:
        # Aggregates of regions only: the background, most of a frame, is no group.
        means = cells.filter(inside).groupBy(*KEYS, "region").agg(*[F.floor(F.avg(d)).cast("int").alias(f"__{d}") for d in donors])
        cells = cells.join(means, [*KEYS, "region"], "left")
        values = [F.col(f"__{d}") for d in donors]
    return cells.withColumns({p: F.when(inside, v).otherwise(F.col(p)) for p, v in zip(planes, values)}).select(*names)


# color


def color_cast(cells: DataFrame) -> DataFrame:
    """Mean a and b of a frame in 8-bit scale against the warm limits."""
    means = cells.groupBy(*KEYS).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return means.withColumn("is_warm", (F.col("mean_a") > C.WARM_A) | (F.col("mean_b") > C.WARM_B))


def finished(cells: DataFrame) -> DataFrame:
    """Cooler chroma, more saturation and value, contrast: b, g, r in and out, 8-bit at every step."""
    lab = C.with_lab(cells)
    cool = lab.withColumns(
        {
            "__l8": C.nearest_byte(F.col("lab_l") * 255.0 / 100.0),
            "__a8": C.clip(C.nearest_byte(F.col("lab_a") + 128.0) - C.COOL_A),
            "__b8": C.clip(C.nearest_byte(F.col("lab_b") + 128.0) - C.COOL_B),
        }
    )
    back = cool.withColumns({"__l": F.col("__l8") * 100.0 / 255.0, "__a": F.col("__a8") - 128.0, "__b": F.col("__b8") - 128.0})
    rgb = C.with_rgb_from_lab(back, "__l", "__a", "__b", ("__r1", "__g1", "__b1"))
    rgb8 = rgb.withColumns({c: C.nearest_byte(F.col(c) * 255.0) for c in ("__r1", "__g1", "__b1")})
    bgr = gained(rgb8, "__r1", "__g1", "__b1", C.SATURATION_GAIN, C.VALUE_GAIN, names=("__b2", "__g2", "__r2"))
    return bgr.withColumns({c: C.scale_abs(F.col(f"__{c}2")) for c in "bgr"}).select(*cells.columns)


def gained(
    cells: DataFrame, r: str, g: str, b: str, saturation: float = 1.1, value: float = 1.1,
    max_saturation: int = 255, max_value: int = 255, names: Sequence[str] = ("b", "g", "r"),
) -> DataFrame:
    """Saturation and value times a gain, held at a cap and cut to bytes."""
    hsv = C.with_hsv(cells, r, g, b, ("__h", "__s8", "__v8"))
    hsv = hsv.withColumns(
        {
            "__s8": F.floor(F.least(F.col("__s8") * saturation, F.lit(float(max_saturation))) + C.NUDGE).cast("int"),
            "__v8": F.floor(F.least(F.col("__v8") * value, F.lit(float(max_value))) + C.NUDGE).cast("int"),
        }
    )
    return C.with_bgr_from_hsv(hsv, "__h", "__s8", "__v8", tuple(names)).drop("__h", "__s8", "__v8")


# tiles


def tile_grid(frames: DataFrame, tile: int, stride: int, keep: Sequence[str] = ()) -> DataFrame:
    """Tiles of a stride walk over a frame, cut at the edges, numbered row by row."""
    kept = [*keep, "w"] if keep else []
    rows = frames.select(*KEYS, "h", "w", *keep, F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(stride))).alias("ty"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(stride))).alias("tx"))
    per_row = F.ceil(F.col("w") / stride)
    return cells.select(
        *KEYS,
        (F.floor(F.col("ty") / stride) * per_row + F.floor(F.col("tx") / stride)).alias("tile_no"), "ty", "tx",
        F.least(F.lit(tile), F.col("h") - F.col("ty")).alias("th"), F.least(F.lit(tile), F.col("w") - F.col("tx")).alias("tw"),
        *kept,
    )


def tile_cells(cells: DataFrame, tile: int, stride: int, height: int, width: int) -> DataFrame:
    """Each pixel once per tile it lies in. The tiles follow from the position, so nothing is joined."""
    back = -(-tile // stride)

    def starts(axis: str) -> Column:
        last = F.floor(F.col(axis) / stride)
        options = F.sequence(F.greatest(last - back, F.lit(0).cast("bigint")), last)
        return F.filter(F.transform(options, lambda i: i * stride), lambda s: F.col(axis) < s + tile)

    per_row = -(-width // stride)
    out = cells.withColumn("ty", F.explode(starts("y"))).withColumn("tx", F.explode(starts("x")))
    return out.withColumns(
        {
            "tile_no": F.floor(F.col("ty") / stride) * per_row + F.floor(F.col("tx") / stride),
            "th": F.least(F.lit(tile), F.lit(height) - F.col("ty")), "tw": F.least(F.lit(tile), F.lit(width) - F.col("tx")),
        }
    )


def feather(tile: int, fade: int, y: Column, x: Column) -> Column:
    """Weight of a tile position: ramps 0..1 over ``fade`` positions at each of the four edges."""
    step = F.lit(float(max(fade - 1, 1)))

    def edge(p: Column) -> Column:
        near = F.when(p < fade, p / step).otherwise(1.0)
        far = F.when(p >= tile - fade, (F.lit(tile - 1) - p) / step).otherwise(1.0)
        return near * far

    return edge(y) * edge(x)


def merge_feathered(tiled: DataFrame, tile: int, fade: int, value: str = "v") -> DataFrame:
    """Weighted mean of overlapping tiles; where all weights are 0 the sum counts as is."""
    weight = feather(tile, fade, F.col("y") - F.col("ty"), F.col("x") - F.col("tx"))
    weighted = tiled.withColumn("__w", weight)
    sums = weighted.groupBy(*CELL).agg(F.sum(F.col(value) * F.col("__w")).alias("__s"), F.sum("__w").alias("__t"))
    return sums.select(*CELL, (F.col("__s") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))).alias(value))


def merge_strongest(tiled: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per pixel the values of the tile with the largest magnitude, the earlier tile on ties; zero stays zero."""
    magnitude = F.col(a) * F.col(a) + F.col(b) * F.col(b)
    best = F.max_by(F.struct(a, b), F.struct(magnitude, -F.col("tile_no"))).alias("best")
    return tiled.groupBy(*CELL).agg(best).select(*CELL, f"best.{a}", f"best.{b}")


def map_tiles(frames: DataFrame, tile: int, stride: int, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Cut packed frames into tiles, call ``function`` on each tile's array, and list the tile cells.

    A tile is cut out of its own row, so nothing is shuffled before the function; the tiles of
    an Arrow batch are handed over together.
    """
    per_row = F.ceil(F.col("w") / stride)

    def cut(ty: Column, tx: Column) -> Column:
        th, tw = F.least(F.lit(tile), F.col("h") - ty), F.least(F.lit(tile), F.col("w") - tx)
        crop = F.flatten(F.transform(F.sequence(ty, ty + th - 1), lambda y: F.slice("px", y * F.col("w") + tx + 1, tw)))
        number = F.floor(ty / stride) * per_row + F.floor(tx / stride)
        return F.struct(number.alias("tile_no"), ty.alias("ty"), tx.alias("tx"), th.alias("th"), tw.alias("tw"), crop.alias("crop"))

    def starts(side: str) -> Column:
        return F.sequence(F.lit(0), F.col(side) - 1, F.lit(stride))

    # The crops are made before the rows are spread, so a row carries its crop and never the whole picture.
    cuts = F.flatten(F.transform(starts("h"), lambda ty: F.transform(starts("w"), lambda tx: cut(ty, tx))))
    tiles = frames.select(*KEYS, F.inline(cuts))

    @F.pandas_udf("array<double>")
    def call(crops: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series(
            [np.asarray(function(np.asarray(c, dtype="float64").reshape(h, w))).ravel() for c, h, w in zip(crops, heights, widths)]
        )

    called = tiles.withColumn("out", call.asNondeterministic()("crop", "th", "tw"))  # called once per tile, see connected_regions
    cells = called.select(*KEYS, "tile_no", "ty", "tx", "tw", F.posexplode("out").alias("i", "v"))
    return cells.select(
        *KEYS, "tile_no", "ty", "tx", (F.col("ty") + F.floor(F.col("i") / F.col("tw"))).cast("int").alias("y"),
        (F.col("tx") + F.col("i") % F.col("tw")).alias("x"), "v",
    )


def block_mean(cells: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Area downscale by a whole factor."""
    return cells.groupBy(*KEYS, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(
        F.avg(value).alias(value)
    )


# frame measures


def sharpness(frames: DataFrame) -> DataFrame:
    """Variance of the 4-neighbour Laplacian, mirrored at the edges without repeating them."""

    def at(y: Column, x: Column) -> Column:
        y = F.when(y < 0, -y).when(y >= F.col("h"), F.col("h") * 2 - 2 - y).otherwise(y)
        x = F.when(x < 0, -x).when(x >= F.col("w"), F.col("w") * 2 - 2 - x).otherwise(x)
        y, x = F.least(y, F.col("h") - 1), F.least(x, F.col("w") - 1)
        return F.get("px", (y * F.col("w") + x).cast("int"))

    def laplacian(v: Column, i: Column) -> Column:
        y, x = F.floor(i / F.col("w")), i % F.col("w")
        return (at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - v * 4).cast("bigint")

    edges = frames.select(*KEYS, F.transform("px", laplacian).alias("e"))
    zero = F.lit(0).cast("bigint")
    sums = edges.select(
        *KEYS, F.size("e").alias("n"), F.aggregate("e", zero, lambda t, v: t + v).alias("s"), F.aggregate("e", zero, lambda t, v: t + v * v).alias("ss")
    )
    mean = F.col("s") / F.col("n")
    return sums.select(*KEYS, (F.col("ss") / F.col("n") - mean * mean).alias("sharpness"))


def loss(batches: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean absolute chroma error ``ab_loss`` per batch; with ``weights``, the weighted sum of it and named losses."""
    error = (F.abs(F.col("a") - F.col("pred_a")) + F.abs(F.col("b") - F.col("pred_b"))) / 2
    named = [n for n in (weights or {}) if n != "ab_loss"]
    out = batches.groupBy("video_id", "batch_no").agg(F.avg(error).alias("ab_loss"), *[F.avg(n).alias(n) for n in named])
    if not weights:
        return out
    return out.withColumn("total_loss", sum(F.col(n) * w for n, w in weights.items()))


def local_contrast(frames: DataFrame, grid: tuple[int, int] = (8, 8), clip_limit: float = 2.0) -> DataFrame:
    """Locally equalized contrast: clipped tile histograms, lookup tables, blend of the four nearest tiles.

    Only histograms are shuffled (at most 256 rows per tile); a frame's tables come back to it as
    one array per tile and the picture stays packed. If a side does not divide by the grid, both sides are
    mirrored on, without the edge, up to the next whole number of tiles, for the histograms only.
    """
    gy, gx = grid
    whole = (F.col("h") % gy == 0) & (F.col("w") % gx == 0)
    full_h = F.when(whole, F.col("h")).otherwise(F.col("h") + gy - F.col("h") % gy)
    full_w = F.when(whole, F.col("w")).otherwise(F.col("w") + gx - F.col("w") % gx)
    th, tw = F.floor(full_h / gy), F.floor(full_w / gx)

    def mirrored(p: Column, side: str) -> Column:
        round_trip = F.greatest(2 * (F.col(side) - 1), F.lit(1))
        p = p % round_trip
        return F.when(p < F.col(side), p).otherwise(round_trip - p)

    padded = F.transform(
        F.sequence(F.lit(0), full_h * full_w - 1),
        lambda i: F.get("px", (mirrored(F.floor(i / full_w).cast("int"), "h") * F.col("w") + mirrored(i % full_w, "w")).cast("int")),
    )
    cells = frames.select(*KEYS, (th * tw).alias("area"), F.posexplode(F.when(whole, F.col("px")).otherwise(padded)).alias("i", "v"), full_w.alias("w"), th.alias("th"), tw.alias("tw"))
    tile = F.floor(F.floor(F.col("i") / F.col("w")) / F.col("th")) * gx + F.floor(F.col("i") % F.col("w") / F.col("tw"))
    limit = F.greatest(F.floor(F.lit(clip_limit) * F.col("area") / 256), F.lit(1))
    # After the histogram everything is grouped inside a frame, so one shuffle by frame serves it all.
    counts = cells.groupBy(*KEYS, "area", tile.alias("tile_no"), "v").agg(F.count(F.lit(1)).alias("c")).repartition(*KEYS)
    in_tile = Window.partitionBy(*KEYS, "tile_no")
    by_value = in_tile.orderBy("v")
    running = counts.select(
        *KEYS, "area", "tile_no", "v", F.sum(F.least("c", limit)).over(by_value).alias("upto"),
        (F.lead("v", 1, 256).over(by_value) - F.col("v")).alias("span"), F.sum(F.greatest(F.col("c") - limit, F.lit(0))).over(in_tile).alias("excess"),
    )
    per_tile = running.groupBy(*KEYS, "area", "tile_no", "excess").agg(
        F.array_sort(F.collect_list(F.struct("v", "upto", "span"))).alias("steps")
    )
    # 256 running sums: each one repeats until the next value that occurs.
    sums = F.concat(
        F.array_repeat(F.lit(0).cast("bigint"), F.get("steps", F.lit(0))["v"]),
        F.flatten(F.transform("steps", lambda s: F.array_repeat(s["upto"], s["span"]))),
    )
    share = F.floor(F.col("excess") / 256)
    rest = F.col("excess") - share * 256
    every = F.greatest(F.floor(F.lit(256) / F.greatest(rest, F.lit(1))), F.lit(1))
    # What was cut off comes back evenly, and the rest of it one by one.
    table = F.transform(
        sums,
        lambda s, v: F.least(F.rint((s + share * (v + 1) + F.least(rest, F.floor(v / every) + 1)) * (F.lit(255.0) / F.col("area"))), F.lit(255.0)).cast("int"),
    )
    tables = per_tile.select(*KEYS, F.struct("tile_no", table.alias("lut")).alias("t"))
    luts = tables.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["lut"]).alias("luts"))
    joined = frames.join(luts, KEYS)

    def look(ty: Column, tx: Column, v: Column) -> Column:
        ty = F.least(F.greatest(ty, F.lit(0)), F.lit(gy - 1))
        tx = F.least(F.greatest(tx, F.lit(0)), F.lit(gx - 1))
        return F.get(F.get("luts", (ty * gx + tx).cast("int")), v)

    def blend(v: Column, i: Column) -> Column:
        fy = F.floor(i / F.col("w")) / th - 0.5
        fx = i % F.col("w") / tw - 0.5
        ty, tx = F.floor(fy), F.floor(fx)
        wy, wx = fy - ty, fx - tx
        upper = look(ty, tx, v) * (F.lit(1.0) - wx) + look(ty, tx + 1, v) * wx
        lower = look(ty + 1, tx, v) * (F.lit(1.0) - wx) + look(ty + 1, tx + 1, v) * wx
        return C.nearest_byte(upper * (F.lit(1.0) - wy) + lower * wy)

    return joined.withColumn("px", F.transform("px", blend)).drop("luts")


def channel_stack(base: DataFrame, planes: DataFrame, names: Sequence[str]) -> DataFrame:
    """One vector per pixel with the named planes in order. A missing plane is an error.

    ``planes`` has ``name`` and ``v``. Planes of a pixel meet in one aggregate instead of one join per plane.
    """
    wide = planes.filter(F.col("name").isin(list(names))).groupBy(*CELL).agg(
        *[F.max(F.when(F.col("name") == n, F.col("v"))).alias(f"__{n}") for n in names]
    )
    joined = base.select(*CELL).join(wide, CELL, "left")
    values = [
        F.coalesce(F.col(f"__{n}"), F.raise_error(F.lit(f"plane {n} is missing")).cast("double")) for n in names
    ]
    return joined.select(*CELL, F.array(*values).alias("stack"))

