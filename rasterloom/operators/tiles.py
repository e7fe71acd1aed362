"""Window grids over rasters, tile/pixel joins, and merging of tile results.

Rasters are (raster_id, width, height); tiles are (raster_id, tile_no, x0, y0, w, h, ...).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import sigmoid, softmax
from .joins import lookup_join


def _range(length: Column, stride: int) -> Column:
    """0, stride, 2*stride, ... below length."""
    return F.sequence(F.lit(0), length.cast("int") - 1, F.lit(stride))


def _strict_starts(length: Column, size: int, stride: int) -> Column:
    """Starts whose window fits, plus one that ends at the border."""
    last = (length - size).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def _number(df: DataFrame, nx: Column) -> DataFrame:
    return df.withColumn("tile_no", (F.col("iy") * nx + F.col("ix")).cast("int")).drop("ix", "iy")


def _cross(rasters: DataFrame, ys: Column, xs: Column) -> DataFrame:
    """Row-major product of the start lists of both axes."""
    d = rasters.withColumn("_xs", xs).withColumn("_nx", F.size("_xs"))
    d = d.select("*", F.posexplode(ys).alias("iy", "_y")).select("*", F.posexplode("_xs").alias("ix", "_x")).drop("_xs")
    return _number(d, F.col("_nx")).drop("_nx")


GRID = ("raster_id", "tile_no", "x0", "y0", "w", "h", "crop_x", "crop_y", "crop_w", "crop_h", "width", "height")


def grid_centered(rasters: DataFrame, window: int, stride: int = 0) -> DataFrame:
    """Every window writes its centre: windows over the border are shifted back (the offset may be negative)."""
    stride = stride or window
    half = (window - stride + 1) // 2
    d = _cross(rasters, _range(F.col("height"), stride), _range(F.col("width"), stride))
    for a, size, pos in (("x", F.col("width"), F.col("_x")), ("y", F.col("height"), F.col("_y"))):
        end = pos + window >= size
        d = d.withColumn(f"{a}0", F.when(end, size - window).otherwise(pos).cast("int")).withColumn(f"_{a}end", end)
        d = d.withColumn(f"crop_{a}", F.when(F.col(f"{a}0") == 0, 0).otherwise(half))
        name = "crop_w" if a == "x" else "crop_h"
        d = d.withColumn(name, F.when(F.col(f"_{a}end"), window).otherwise(window - F.col(f"crop_{a}")))
    return d.withColumn("w", F.lit(window)).withColumn("h", F.lit(window)).select(*GRID)


def grid_strict(rasters: DataFrame, window: int, stride: int) -> DataFrame:
    """Windows stay inside the image and the last one ends at the border. Smaller rasters are left out (see ``too_small``)."""
    half = (window - stride + 1) // 2
    fit = rasters.filter((F.col("width") >= window) & (F.col("height") >= window))
    d = _cross(fit, _strict_starts(F.col("height"), window, stride), _strict_starts(F.col("width"), window, stride))
    for a, size, name in (("x", F.col("width"), "crop_w"), ("y", F.col("height"), "crop_h")):
        pos = F.col(f"_{a}")
        off = F.when(pos == 0, 0).otherwise(half)
        d = d.withColumn(f"{a}0", pos).withColumn(f"crop_{a}", off).withColumn(
            name, F.when(pos == size - window, size - pos - off).otherwise(window - off).cast("int"))
    return d.withColumn("w", F.lit(window)).withColumn("h", F.lit(window)).select(*GRID)


def too_small(rasters: DataFrame, window: int) -> DataFrame:
    return rasters.filter((F.col("width") < window) | (F.col("height") < window))


def slide_grid(rasters: DataFrame, crop: int, stride: int) -> DataFrame:
    """Sliding windows: ceil count, clamped to the border, shortened only when the image is smaller."""
    def starts(length):
        n = F.floor(F.greatest(length - crop + stride - 1, F.lit(0)) / stride).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.least(i * stride + crop, length) - crop, F.lit(0)).cast("int"))
    d = _cross(rasters, starts(F.col("height")), starts(F.col("width")))
    return d.select("raster_id", "tile_no", F.col("_x").alias("x0"), F.col("_y").alias("y0"),
                    F.least(F.lit(crop), F.col("width") - F.col("_x")).cast("int").alias("w"),
                    F.least(F.lit(crop), F.col("height") - F.col("_y")).cast("int").alias("h"), "width", "height")


def clip_grid(rasters: DataFrame, size: int, stride: int, legacy: bool = False) -> DataFrame:
    """Clip boxes; the last ones end at the border. ``legacy`` steps by the clip size whatever the stride; boxes are distinct."""
    step = size if legacy else stride

    def starts(length):
        n = F.greatest(F.ceil((length - size) / stride), F.lit(0)).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.least(i * step, length - size), F.lit(0)).cast("int")))
    d = _cross(rasters, starts(F.col("height")), starts(F.col("width")))
    return d.select("raster_id", "tile_no", F.col("_x").alias("x0"), F.col("_y").alias("y0"),
                    F.least(F.lit(size), F.col("width") - F.col("_x")).cast("int").alias("w"),
                    F.least(F.lit(size), F.col("height") - F.col("_y")).cast("int").alias("h"), "width", "height")


def patch_grid(rasters: DataFrame, patch_h: int = 896, patch_w: int = 896, overlap: int = 384) -> DataFrame:
    """Overlapping patches of pre-padded images with their y0_y1_x0_x1 names.

    An axis is padded when it is short and the other axis is not exactly one patch long.
    """
    h, w = F.col("height"), F.col("width")
    d = rasters.withColumn("_h", F.when((h < patch_h) & (w != patch_w), patch_h).otherwise(h)).withColumn(
        "_w", F.when((w < patch_w) & (h != patch_h), patch_w).otherwise(w))

    def starts(length, size):
        return F.array_distinct(F.transform(_range(length, size - overlap), lambda p: F.greatest(F.least(p, length.cast("int") - size), F.lit(0)).cast("int")))
    d = _cross(d, starts(F.col("_h"), patch_h), starts(F.col("_w"), patch_w))
    y1, x1 = F.least(F.col("_y") + patch_h, F.col("_h")).cast("int"), F.least(F.col("_x") + patch_w, F.col("_w")).cast("int")
    return d.select("raster_id", "tile_no", F.col("_x").alias("x0"), F.col("_y").alias("y0"), (x1 - F.col("_x")).alias("w"), (y1 - F.col("_y")).alias("h"),
                    F.format_string("%s_%d_%d_%d_%d", F.col("raster_id").cast("string"), "_y", y1, "_x", x1).alias("name"), "width", "height")


def crop_tiles(pixels: DataFrame, tiles: DataFrame, bucket: int, raster: str = "raster_id") -> DataFrame:
    """Pixels inside each tile, by equi-join on raster and coarse cell plus a range filter.

    Both sides are keyed by cells of ``bucket`` pixels, so one huge raster is spread over its cells.
    """
    def cells(a, size):
        return F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(a) + F.col(size) - 1) / bucket)))
    right = tiles.withColumn("_cy", cells("y0", "h")).withColumn("_cx", cells("x0", "w"))
    left = pixels.withColumn("_cy", F.floor(F.col("y") / bucket)).withColumn("_cx", F.floor(F.col("x") / bucket))
    both = left.join(right.drop("width", "height"), [raster, "_cy", "_cx"])
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w"))
    return both.filter(inside).drop("_cy", "_cx")


def slide_crop(pixels: DataFrame, rasters: DataFrame, patch: int, overlap: int, fill: int = 255, value: str = "label") -> DataFrame:
    """Patch pixels in patch coordinates, padding included: (raster_id, name, y, x, value)."""
    tiles = patch_grid(rasters, patch, patch, overlap)
    real = crop_tiles(pixels, tiles, patch).select("raster_id", "name", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), value)
    pad = (tiles.filter((F.col("y0") + F.col("h") > F.col("height")) | (F.col("x0") + F.col("w") > F.col("width")))
           .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
           .filter((F.col("y0") + F.col("y") >= F.col("height")) | (F.col("x0") + F.col("x") >= F.col("width"))))
    return real.unionByName(pad.select("raster_id", "name", "y", "x", F.lit(fill).alias(value)))


def overlap_pixels(tile: int, overlap: float) -> int:
    if tile <= 0 or overlap < 0:
        raise ValueError("tile must be positive and overlap not negative")
    n = int(round(tile * overlap)) if overlap < 1 else int(round(overlap))
    if n >= tile:
        raise ValueError(f"overlap {n} must be smaller than the tile {tile}")
    return n


def feature_tiles(rasters: DataFrame, tile: int, overlap: float, stride: int = 1) -> DataFrame:
    """Tiles for a feature grid of ``stride`` pixels; rasters not divisible by it are left out (see ``indivisible``)."""
    return feature_overlaps(rasters, tile, overlap, stride).drop("left", "right", "top", "bottom")


def feature_overlaps(rasters: DataFrame, tile: int, overlap: float, stride: int = 1) -> DataFrame:
    """``tile_overlaps`` of ``feature_tiles``, read off the start lists: nothing moves, so the tiles of a raster stay together."""
    step = tile - overlap_pixels(tile, overlap)
    if tile % stride or step % stride:
        raise ValueError(f"tile {tile} and tile step {step} must be divisible by {stride}")
    ok = rasters.filter((F.col("height") % stride == 0) & (F.col("width") % stride == 0))

    def starts(length):
        return F.when(length <= tile, F.array(F.lit(0))).otherwise(_strict_starts(F.greatest(length, F.lit(tile)), tile, step))
    def around(start, axis_starts, size, before, after):
        """Overlaps with the starts next to this one."""
        lo = F.array_max(F.filter(axis_starts, lambda s: s < start))
        hi = F.array_min(F.filter(axis_starts, lambda s: s > start))
        zero = F.lit(0)
        return [F.greatest(zero, F.coalesce(lo + F.col(size) - start, zero)).alias(before), F.greatest(zero, F.coalesce(start + F.col(size) - hi, zero)).alias(after)]
    d = _cross(ok, starts(F.col("height")), starts(F.col("width")))
    d = d.select("raster_id", "tile_no", F.col("_x").alias("x0"), F.col("_y").alias("y0"), F.least(F.lit(tile), F.col("width") - F.col("_x")).cast("int").alias("w"),
                 F.least(F.lit(tile), F.col("height") - F.col("_y")).cast("int").alias("h"), "width", "height")
    return d.select("*", *around(F.col("x0"), starts(F.col("width")), "w", "left", "right"), *around(F.col("y0"), starts(F.col("height")), "h", "top", "bottom"))


def indivisible(rasters: DataFrame, stride: int) -> DataFrame:
    return rasters.filter((F.col("height") % stride != 0) | (F.col("width") % stride != 0))


def tile_overlaps(tiles: DataFrame) -> DataFrame:
    """Overlap with the previous and next tile in the same row and column, in pixels.

    Windows run along one row or one column of tiles of a raster.
    """
    row, col = Window.partitionBy("raster_id", "y0").orderBy("x0"), Window.partitionBy("raster_id", "x0").orderBy("y0")
    zero = F.lit(0)
    return (tiles.withColumn("left", F.greatest(zero, F.coalesce(F.lag(F.col("x0") + F.col("w")).over(row) - F.col("x0"), zero)))
                 .withColumn("right", F.greatest(zero, F.coalesce(F.col("x0") + F.col("w") - F.lead("x0").over(row), zero)))
                 .withColumn("top", F.greatest(zero, F.coalesce(F.lag(F.col("y0") + F.col("h")).over(col) - F.col("y0"), zero)))
                 .withColumn("bottom", F.greatest(zero, F.coalesce(F.col("y0") + F.col("h") - F.lead("y0").over(col), zero))))


def _ramp(pos: Column, length: Column, before: Column, after: Column, first: Column, last: Column) -> Column:
    """1-D blend weight: linear ramps over the overlaps, 1 elsewhere and at image borders."""
    one = F.lit(1.0)
    b, a = F.least(before, length), F.least(after, length)
    lo = one / (b + 1)
    up = F.when(b == 1, lo).otherwise(lo + pos * (one - lo) / F.nullif((b - 1).cast("double"), F.lit(0.0)))
    i = pos - (length - a)
    end = one / (a + 1)
    down = F.when(a == 1, one).otherwise(one + i * (end - one) / F.nullif((a - 1).cast("double"), F.lit(0.0)))
    return F.least(F.when((b > 0) & ~first & (pos < b), up).otherwise(one), F.when((a > 0) & ~last & (i >= 0), down).otherwise(one))


TILE_FACTS = ("left", "right", "top", "bottom", "x0", "y0", "w", "h", "width", "height")


def blend_tiles(tiles: DataFrame, values: DataFrame, stride: int = 1) -> DataFrame:
    """Weighted merge of overlapping tiles; ``tiles`` come from ``tile_overlaps``, values are (raster_id, tile_no, y, x, class_id, value)."""
    v = values.select("raster_id", "tile_no", "y", "x", "class_id", "value")
    return blend_carried(lookup_join(v, tiles.select("raster_id", "tile_no", *TILE_FACTS), ["raster_id", "tile_no"], "inner"), stride)


def blend_carried(values: DataFrame, stride: int = 1) -> DataFrame:
    """The same for values that carry the columns ``TILE_FACTS`` of their tile: they are not joined, and move once, as sums by pixel."""
    d = values.select("raster_id", "y", "x", "class_id", "value", *[F.floor(F.col(c) / stride).alias(c) for c in TILE_FACTS])
    wy = _ramp(F.col("y"), F.col("h"), F.col("top"), F.col("bottom"), F.col("y0") == 0, F.col("y0") + F.col("h") == F.col("height"))
    wx = _ramp(F.col("x"), F.col("w"), F.col("left"), F.col("right"), F.col("x0") == 0, F.col("x0") + F.col("w") == F.col("width"))
    d = d.withColumn("_w", wy * wx).withColumn("y", F.col("y") + F.col("y0")).withColumn("x", F.col("x") + F.col("x0"))
    return d.groupBy("raster_id", "y", "x", "class_id").agg((F.sum(F.col("value") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("value"))


def merge_windows(values: DataFrame, keys: Sequence[str] = ("raster_id", "y", "x", "class_id"), value: str = "value") -> DataFrame:
    """Sum of window scores over the number of windows."""
    return values.groupBy(*keys).agg((F.sum(value) / F.count("*")).alias(value), F.count("*").alias("windows"))


def uncovered(rasters: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rasters whose tiles leave pixels uncovered (window merging needs at least one window per pixel).

    The starts of each axis are checked for gaps; grids are products, so two axis checks suffice.
    """
    def gaps(start, size, length):
        w = Window.partitionBy("raster_id").orderBy(start)
        axis = tiles.select("raster_id", start, size, length).distinct()
        nxt = F.coalesce(F.lead(start).over(w), F.col(length))
        gap = (nxt > F.col(start) + F.col(size))
        return axis.withColumn("_g", gap).filter("_g").select("raster_id").distinct()
    return rasters.join(gaps("x0", "w", "width").union(gaps("y0", "h", "height")).distinct(), "raster_id", "left_semi")


BOX = ("x0", "y0", "ax", "ay", "bx", "by")


def owned_boxes(tiles: DataFrame) -> DataFrame:
    """Grid windows with the part no later window overwrites, in raster coordinates: their columns and [ax, bx) x [ay, by).

    Grids are products of two axes and later windows win, so a window owns its crop up to where the
    crop of the next column or row starts. Of windows shifted onto the same place the last one stays.
    """
    spot = ["raster_id", "x0", "y0"]
    rest = [c for c in tiles.columns if c not in (*spot, "tile_no")]
    last = tiles.groupBy(*spot).agg(F.max(F.struct("tile_no", *rest)).alias("t")).select(*spot, "t.*")
    ax, ay = F.col("x0") + F.col("crop_x"), F.col("y0") + F.col("crop_y")
    row, col = Window.partitionBy("raster_id", "y0").orderBy("x0"), Window.partitionBy("raster_id", "x0").orderBy("y0")
    last = last.withColumn("ax", ax).withColumn("ay", ay)
    bx, by = F.col("ax") + F.col("crop_w"), F.col("ay") + F.col("crop_h")
    return last.select(*tiles.columns, "ax", "ay", F.least(bx, F.coalesce(F.lead("ax").over(row), bx)).alias("bx"),
                       F.least(by, F.coalesce(F.lead("ay").over(col), by)).alias("by"))


def stitch(tiles: DataFrame, values: DataFrame, label: str = "label", grid: bool = True) -> DataFrame:
    """Raster labels from window labels: only the crop part of a window is written, the later window wins.

    Grid windows know beforehand which pixels they own, so nothing is aggregated; ``grid=False`` takes
    any list of windows and picks the last writer of each pixel.
    """
    v = values.select("raster_id", "tile_no", "y", "x", label)
    if grid:
        return stitch_carried(lookup_join(v, owned_boxes(tiles).select("raster_id", "tile_no", *BOX), ["raster_id", "tile_no"], "inner"), label)
    t = tiles.select("raster_id", "tile_no", "x0", "y0", "crop_x", "crop_y", "crop_w", "crop_h")
    d = lookup_join(v, t, ["raster_id", "tile_no"], "inner")
    own = (F.col("y") >= F.col("crop_y")) & (F.col("y") < F.col("crop_y") + F.col("crop_h")) & (F.col("x") >= F.col("crop_x")) & (F.col("x") < F.col("crop_x") + F.col("crop_w"))
    d = d.filter(own).select("raster_id", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), label, "tile_no")
    return d.groupBy("raster_id", "y", "x").agg(F.max_by(label, "tile_no").alias(label))


def stitch_carried(values: DataFrame, label: str = "label") -> DataFrame:
    """The same for values that carry the columns ``BOX`` of their window: no pixel moves."""
    d = values.withColumn("y", F.col("y") + F.col("y0")).withColumn("x", F.col("x") + F.col("x0"))
    mine = (F.col("y") >= F.col("ay")) & (F.col("y") < F.col("by")) & (F.col("x") >= F.col("ax")) & (F.col("x") < F.col("bx"))
    return d.filter(mine).select("raster_id", "y", "x", label)


def own_pixels(frame):
    """``stitch_carried`` inside the task that scores the windows (pandas)."""
    y, x = frame["y"] + frame["y0"], frame["x"] + frame["x0"]
    mine = (y >= frame["ay"]) & (y < frame["by"]) & (x >= frame["ax"]) & (x < frame["bx"])
    return frame.assign(y=y, x=x).drop(columns=list(BOX))[mine]


def _merge(df: DataFrame, keys: Sequence[str], transform, scores: str) -> DataFrame:
    long = df.select(*keys, F.posexplode(transform(F.col(scores))).alias("class_id", "p"))
    return long.groupBy(*keys, "class_id").agg(F.avg("p").alias("p"))


def _decide(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(F.max_by("class_id", F.struct("p", -F.col("class_id"))).alias("pred"), F.max("p").alias("p"))


def merge_views(df: DataFrame, keys: Sequence[str], scores: str, threshold: float | None = None) -> DataFrame:
    """Test-time views: mean softmax and argmax, or (one class) mean sigmoid and threshold. Un-flip the views first."""
    if threshold is not None:
        merged = df.groupBy(*keys).agg(F.avg(sigmoid(F.col(scores)[0])).alias("p"))
        return merged.select(*keys, (F.col("p") > threshold).cast("int").alias("pred"), "p")
    return _decide(_merge(df, keys, softmax, scores), keys)


def mean_logits(df: DataFrame, keys: Sequence[str], scores: str) -> DataFrame:
    """Plain mean of scores over views or time steps, argmax."""
    return _decide(_merge(df, keys, lambda c: c.cast("array<double>"), scores), keys)


