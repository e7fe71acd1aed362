"""Geometry on pixel tables (sample_id, h, w, y, x, values ...): rows are moved, never gathered.

Operators that move pixels update ``h`` and ``w``; padding adds generated rows instead of joining a grid.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import drawn, hash_order
from .stencil import BLOCK, differing, dilated, over_blocks

S = "sample_id"


def flip(df: DataFrame, direction: str = "horizontal") -> DataFrame:
    if direction not in ("horizontal", "vertical", "diagonal"):
        raise ValueError(f"unknown direction {direction}")
    if direction in ("horizontal", "diagonal"):
        df = df.withColumn("x", F.col("w") - 1 - F.col("x"))
    if direction in ("vertical", "diagonal"):
        df = df.withColumn("y", F.col("h") - 1 - F.col("y"))
    return df


def rot90(df: DataFrame, k: int) -> DataFrame:
    """Counter-clockwise quarter turns."""
    k %= 4
    h, w, y, x = (F.col(c) for c in ("h", "w", "y", "x"))
    moved = {0: (h, w, y, x), 1: (w, h, w - 1 - x, y), 2: (h, w, h - 1 - y, w - 1 - x), 3: (w, h, x, h - 1 - y)}[k]
    rest = [c for c in df.columns if c not in ("h", "w", "y", "x")]
    return df.select(*rest, *[c.alias(n) for n, c in zip(("h", "w", "y", "x"), moved)])


def crop(df: DataFrame, y0: Column | int, x0: Column | int, h: Column | int, w: Column | int) -> DataFrame:
    """Pixels of a box, in box coordinates. Boxes must lie inside (see ``crop_too_large``)."""
    y0, x0, h, w = (v if isinstance(v, Column) else F.lit(v) for v in (y0, x0, h, w))
    d = df.withColumn("_y", y0.cast("int")).withColumn("_x", x0.cast("int")).withColumn("_h", h.cast("int")).withColumn("_w", w.cast("int"))
    d = d.filter((F.col("y") >= F.col("_y")) & (F.col("y") < F.col("_y") + F.col("_h")) & (F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + F.col("_w")))
    return (d.withColumn("y", F.col("y") - F.col("_y")).withColumn("x", F.col("x") - F.col("_x"))
             .withColumn("h", F.col("_h")).withColumn("w", F.col("_w")).drop("_y", "_x", "_h", "_w"))


def center_crop(df: DataFrame, size: int) -> DataFrame:
    """Centre box; samples smaller than the box are left out (see ``crop_too_large``)."""
    fit = df.filter((F.col("h") >= size) & (F.col("w") >= size))
    return crop(fit, F.floor((F.col("h") - size) / 2), F.floor((F.col("w") - size) / 2), size, size)


def crop_too_large(rasters: DataFrame, h: int, w: int) -> DataFrame:
    return rasters.filter((F.col("h") < h) | (F.col("w") < w))


def crop_ratio(df: DataFrame, start: tuple[float, float], size: tuple[float, float]) -> DataFrame:
    """Box given as ratios of height and width, rounded half to even."""
    h, w = F.col("h"), F.col("w")
    box = [F.rint(d * r).cast("int") for d, r in ((h, start[0]), (w, start[1]), (h, size[0]), (w, size[1]))]
    return crop(df, *box)


def cut_padding(df: DataFrame, left: str, right: str, top: str, bottom: str) -> DataFrame:
    """Drop padded margins (columns per sample) before scoring."""
    l, r, t, b = (F.col(c) for c in (left, right, top, bottom))
    return crop(df, t, l, F.col("h") - t - b, F.col("w") - l - r).drop(left, right, top, bottom)


def pad_to(df: DataFrame, rasters: DataFrame, h: int, w: int, fills: Mapping[str, object], mode: str = "right_bottom") -> DataFrame:
    """Pad to h x w (larger samples are cropped to it): right/bottom or centred; ``fills`` names the fill of each column.

    ``rasters`` holds (sample_id, h, w). Only the missing margin is generated.
    """
    oh, ow = F.col("h"), F.col("w")

    def shift(old, new):
        return F.floor((F.lit(new) - old) / 2).cast("int") if mode == "center" else F.lit(0)
    sy, sx = shift(oh, h), shift(ow, w)
    kept = df.withColumn("y", F.col("y") + sy).withColumn("x", F.col("x") + sx)
    kept = kept.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    margin = (rasters.select(S, "h", "w", sy.alias("_sy"), sx.alias("_sx")).filter((oh < h) | (ow < w))
              .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
              .filter(~(((F.col("y") - F.col("_sy")) >= 0) & ((F.col("y") - F.col("_sy")) < oh) & ((F.col("x") - F.col("_sx")) >= 0) & ((F.col("x") - F.col("_sx")) < ow))))
    values = [F.lit(fills[c]).cast(t).alias(c) if c in fills else F.col(c) for c, t in df.dtypes]
    out = kept.unionByName(margin.select(*values))
    return out.withColumn("h", F.lit(h)).withColumn("w", F.lit(w))


def _targets(pos: Column, src: Column, dst: Column) -> Column:
    """Target positions i with floor(i * src / dst) = pos."""
    lo, hi = F.ceil(pos * dst / src), F.ceil((pos + 1) * dst / src) - 1
    return F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def resize_nearest(df: DataFrame, h: Column | int, w: Column | int) -> DataFrame:
    """Nearest resize: every source pixel fills its own target pixels, so no join is needed."""
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (h, w))
    d = df.withColumn("_h", h.cast("int")).withColumn("_w", w.cast("int"))
    d = d.withColumn("y", F.explode(_targets(F.col("y"), F.col("h"), F.col("_h")))).withColumn("x", F.explode(_targets(F.col("x"), F.col("w"), F.col("_w"))))
    return d.withColumn("h", F.col("_h")).withColumn("w", F.col("_w")).drop("_h", "_w")


def short_edge_size(df: DataFrame, short: int, max_size: int) -> DataFrame:
    """Target size with the short edge at ``short`` and the long edge at most ``max_size``, +0.5 rounding."""
    h, w = F.col("h").cast("double"), F.col("w").cast("double")
    scale = F.lit(float(short)) / F.least(h, w)
    nh, nw = F.when(h < w, float(short)).otherwise(scale * h), F.when(h < w, scale * w).otherwise(float(short))
    cap = F.least(F.lit(1.0), F.lit(float(max_size)) / F.greatest(nh, nw))
    return df.withColumn("new_h", F.floor(nh * cap + 0.5).cast("int")).withColumn("new_w", F.floor(nw * cap + 0.5).cast("int"))


def pad_shapes(df: DataFrame, batch: str, divisor: int) -> DataFrame:
    """Common padded size of each batch: largest sides, rounded up to the divisor."""
    top = df.groupBy(batch).agg(F.max("h").alias("_h"), F.max("w").alias("_w"))
    up = [(F.ceil(F.col(c) / divisor) * divisor).cast("int").alias(n) for c, n in (("_h", "pad_h"), ("_w", "pad_w"))]
    return df.join(top.select(batch, *up), batch)


def _inside(df: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """Pixels covered by any box (sample_id, x1, y1, x2, y2), by cell equi-join."""
    def cells(a, b):
        return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / cell)))
    b = boxes.withColumn("_cy", cells("y1", "y2")).withColumn("_cx", cells("x1", "x2"))
    p = df.select(S, "y", "x", F.floor(F.col("y") / cell).alias("_cy"), F.floor(F.col("x") / cell).alias("_cx"))
    hit = p.join(b, [S, "_cy", "_cx"]).filter((F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")))
    return hit.select(S, "y", "x").distinct()


def cutout(df: DataFrame, boxes: DataFrame, fills: Mapping[str, object], cell: int = 64) -> DataFrame:
    """Replace the named columns inside the boxes."""
    marked = df.join(_inside(df, boxes, cell).withColumn("_hit", F.lit(True)), [S, "y", "x"], "left")
    for c, v in fills.items():
        marked = marked.withColumn(c, F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)))
    return marked.drop("_hit")


def _draw(n: int, *parts: object) -> int:
    """``ordering.drawn`` in Python."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n


def _try_counts(size: int, seed: int, tries: int):
    """Rows (sample, h, w, _s: the sample as text, y, x, label, _use: the label counts) to (sample, h, w, label, counts): pixels of the label in the box of each try."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            if not b.num_rows:
                continue
            # a sample of the batch: a run of rows with equal sample and size
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in range(3):
                new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            at = pa.array(first)
            keys = list(zip(*(b.column(c).take(at).to_pylist() for c in (3, 1, 2))))
            boxes = {(k, h, w): [(_draw(h - min(h, size) + 1, seed, k, t, "y"), _draw(w - min(w, size) + 1, seed, k, t, "x")) for t in range(tries)] for k, h, w in set(keys)}
            corner = np.array([boxes[k] for k in keys], np.int64)
            high, wide = (np.array([min(k[i], size) for k in keys], np.int64)[of] for i in (1, 2))
            y, x = (b.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in (4, 5))
            coded = b.column(6).dictionary_encode()
            counted = b.column(7).to_numpy(zero_copy_only=False)
            label, n = coded.indices.fill_null(0).to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            code, place = np.unique(of * n + label, return_inverse=True)
            counts = np.zeros((len(code), tries), np.int64)
            for t in range(tries):
                oy, ox = corner[of, t, 0], corner[of, t, 1]
                inside = counted & (y >= oy) & (y < oy + high) & (x >= ox) & (x < ox + wide)
                counts[:, t] = np.bincount(place[inside], minlength=len(code))
            hit = counts.any(axis=1)
            owner, found = code[hit] // n, code[hit] % n
            # a sample without a counted pixel has a row of zeros
            none = np.setdiff1d(np.arange(len(first)), owner)
            rows = pa.array(first[np.concatenate([owner, none])])
            labels = pa.concat_arrays([coded.dictionary.take(pa.array(found)), pa.nulls(len(none), coded.dictionary.type)])
            flat = np.concatenate([counts[hit].ravel(), np.zeros(len(none) * tries, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tries), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in range(3)], labels, lists], names=[S, "h", "w", "label", "counts"])
    return run


def random_crop(df: DataFrame, size: int, max_ratio: float, label: str, seed: int, tries: int = 10, ignore: int = 255, cell: int = 64) -> DataFrame:
    """Seeded crop offsets, the first of ``tries`` whose largest class stays below ``max_ratio`` (else the last).

    A side shorter than ``size`` is kept whole. Boxes follow from the sample and its size, which every pixel carries: tasks count
    the pixels of each label in each try where they lie, and only counts are shuffled before the pixels meet the chosen box. So a
    pixel moves once, and a large sample is no single key (``cell`` is no longer needed).
    """
    kinds = dict(df.dtypes)
    slim = df.dropna(subset=[S, "h", "w"]).select(S, "h", "w", F.col(S).cast("string").alias("_s"), "y", "x", label, F.coalesce(F.col(label) != ignore, F.lit(False)).alias("_use"))
    part = slim.mapInArrow(_try_counts(size, seed, tries), f"{S} {kinds[S]}, h {kinds['h']}, w {kinds['w']}, label {kinds[label]}, counts array<int>")
    dims = [S, "h", "w"]
    # one shuffle by sample serves all groupings
    each = part.repartition(S).select(*dims, "label", F.posexplode("counts").alias("try", "c"))
    per = each.groupBy(*dims, "try", "label").agg(F.sum("c").alias("c")).groupBy(*dims, "try").agg(
        ((F.count_if(F.col("c") > 0) > 1) & (F.try_divide(F.max("c"), F.sum("c")) < max_ratio)).alias("ok"))
    chosen = per.groupBy(*dims).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("try"))), F.lit(tries - 1)).alias("try"))
    high, wide = F.least(F.col("h"), F.lit(size)), F.least(F.col("w"), F.lit(size))
    offsets = [drawn(F.col(d) - n + 1, seed, F.col(S).cast("string"), F.col("try").cast("string"), a).cast("int").alias(f"o{a}") for a, d, n in (("y", "h", high), ("x", "w", wide))]
    pick = chosen.select(S, *offsets, high.alias("bh"), wide.alias("bw"))
    # a chosen box is one narrow row a sample: hashed, so pixels are not sorted
    return crop(df.join(pick.hint("shuffle_hash"), S), F.col("oy"), F.col("ox"), F.col("bh"), F.col("bw")).drop("oy", "ox", "bh", "bw")


def mosaic(df: DataFrame, partners: DataFrame, scale: tuple[int, int], center: tuple[int, int], label: str, fill: int = 255) -> DataFrame:
    """Four samples on a 2H x 2W canvas around ``center`` (x, y): (sample_id, y, x, label).

    ``partners`` has (sample_id, slot 1..3, partner); slots run top right, bottom left, bottom right. A resized sample, at most
    H x W pixels, moves as one row of positions and labels; the quarters of a canvas do not overlap, so none meets another.
    """
    sh, sw = scale
    cx, cy = center
    members = (df.select(S).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(partners.select(S, "slot", "partner"), [S, "slot"], "left")
               .select(S, "slot", F.when(F.col("slot") == 0, F.col(S)).otherwise(F.col("partner")).alias("_src")))
    r = F.least(F.lit(float(sh)) / F.col("h"), F.lit(float(sw)) / F.col("w"))
    small = resize_nearest(df.select(F.col(S).alias("_src"), "h", "w", "y", "x", label), F.floor(F.col("h") * r), F.floor(F.col("w") * r))
    packed = (small.groupBy("_src", "h", "w").agg(F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).alias("at"), F.col(label).alias("v"))).alias("l"))
              .select("_src", "h", "w", F.col("l.at").alias("_at"), F.col("l.v").alias("_v")))
    d = members.join(packed, "_src", "left")
    # left/top parts end at the centre, right/bottom parts start there; the canvas cuts the rest
    dx, dy = F.when(F.col("slot").isin(0, 2), cx - F.col("w")).otherwise(cx), F.when(F.col("slot").isin(0, 1), cy - F.col("h")).otherwise(cy)
    place = lambda y, x, v: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), v.alias(label))
    parts = F.transform(F.arrays_zip("_at", "_v"), lambda p: place(F.floor(p["_at"] / F.col("w")) + dy, p["_at"] % F.col("w") + dx, p["_v"]))
    d = d.withColumn("_put", F.coalesce(F.filter(parts, lambda p: p["x"].between(0, 2 * sw - 1) & p["y"].between(0, 2 * sh - 1)), F.array().cast(f"array<struct<y:int,x:int,{label}:{dict(df.dtypes)[label]}>>")))
    empty, quarter = F.array().cast("array<int>"), F.lit(None)
    for slot in range(4):
        ys = (max(cy, 0), 2 * sh) if slot > 1 else (0, min(cy, 2 * sh))
        xs = (max(cx, 0), 2 * sw) if slot % 2 else (0, min(cx, 2 * sw))
        n_y, n_x = (max(0, hi - lo) for lo, hi in (ys, xs))
        cells = F.transform(F.sequence(F.lit(0), F.lit(n_y * n_x - 1)), lambda i: ((F.floor(i / n_x) + ys[0]) * 2 * sw + i % n_x + xs[0]).cast("int")) if n_y * n_x else empty  # noqa: B023
        quarter = F.when(F.col("slot") == slot, cells).otherwise(quarter)
    free = F.array_except(quarter, F.transform("_put", lambda p: p["y"] * 2 * sw + p["x"]))
    rest = F.transform(free, lambda i: place(F.floor(i / (2 * sw)), i % (2 * sw), F.lit(fill).cast(dict(df.dtypes)[label])))
    return d.select(S, F.inline(F.concat("_put", rest)))


def depth_mix(img: DataFrame, depth: DataFrame, left: str, width: str, value: str = "value", factor: float = 1.0) -> DataFrame:
    """Columns left..left+width-1 of the image show the rescaled depth instead."""
    d = depth.select(S, "y", "x", (F.col("depth") / factor).alias("_d"))
    inside = (F.col("x") >= F.col(left)) & (F.col("x") < F.col(left) + F.col(width))
    return img.join(d, [S, "y", "x"]).withColumn(value, F.when(inside, F.col("_d")).otherwise(F.col(value))).drop("_d")


def depth_strip(df: DataFrame, seed: int, ratio: float = 0.75) -> DataFrame:
    """Seeded strip per sample: left = int(w*u1), width = int(max(1, (w-left)*ratio*u2))."""
    def u(i):
        return F.pmod(hash_order(seed + i, S), F.lit(2 ** 31)) / float(2 ** 31)
    d = df.withColumn("left", F.floor(F.col("w") * u(0)).cast("int"))
    return d.withColumn("width", F.floor(F.greatest(F.lit(1.0), (F.col("w") - F.col("left")) * ratio * u(1))).cast("int"))


# Neighbours a pixel is compared with (up, right, down-right, down-left), as (dy, dx).
EDGE_NEIGHBOURS = ((-1, 0), (0, 1), (1, 1), (1, -1))


def edge_map(df: DataFrame, label: str, width: int = 3, ignore: int = 255) -> DataFrame:
    """Boundary pixels (sample_id, y, x) after dilation by a width x width square, in one shuffle by blocks of pixels."""
    lo, hi = width // 2 - (width - 1), width // 2
    slim = df.select(S, "y", "x", "h", "w", F.col(label).alias("v")).filter(F.col("v") != ignore)
    types = dict(slim.dtypes)

    def grow(table):
        import numpy as np
        import pyarrow as pa
        b, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("_block", "y", "x"))
        first = np.searchsorted(b, np.arange(b[-1] + 1))                    # a row of each block: its sample, size and position
        marked = np.zeros(len(b), bool)
        marked[differing(table, "v", EDGE_NEIGHBOURS, None)[0]] = True
        at = np.flatnonzero(marked)
        gb, gy, gx = dilated(b[at], y[at], x[at], lo, hi)
        h, w, yb, xb = (table.column(c).to_numpy()[first][gb] for c in ("h", "w", "_yb", "_xb"))
        mine = (gy >= 0) & (gx >= 0) & (gy < h) & (gx < w) & (gy // BLOCK == yb) & (gx // BLOCK == xb)
        out = table.select([S]).take(pa.array(first[gb[mine]]))
        for name, pos in (("y", gy), ("x", gx)):
            out = out.append_column(name, pa.array(pos[mine]).cast(table.schema.field(name).type))
        return out

    # a mark reaches lo..hi, and whether a pixel is marked depends on one pixel more
    reach = (-hi - 1, -lo + 1)
    return over_blocks(slim, S, reach, reach, grow, f"{S} {types[S]}, y {types['y']}, x {types['x']}", from_zero=True)


# --- volumes: the same with a z axis of size d ----------------------------------------------------
def flip3d(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    size = {"z": "d", "y": "h", "x": "w"}
    for a in axes:
        df = df.withColumn(a, F.col(size[a]) - 1 - F.col(a))
    return df


def crop3d(df: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Box in (z, y, x) order."""
    for a, n, s, k in zip("zyx", "dhw", start, size):
        df = df.filter((F.col(a) >= s) & (F.col(a) < s + k)).withColumn(a, F.col(a) - s).withColumn(n, F.lit(k))
    return df


def pad3d(df: DataFrame, volumes: DataFrame, size: tuple[int, int, int], fills: Mapping[str, object]) -> DataFrame:
    """Pad each axis at its end to its own target size; ``volumes`` holds (sample_id, d, h, w)."""
    d, h, w = size
    outside = (F.col("z") >= F.col("d")) | (F.col("y") >= F.col("h")) | (F.col("x") >= F.col("w"))
    m = volumes.select(S, "d", "h", "w").filter((F.col("d") < d) | (F.col("h") < h) | (F.col("w") < w))
    for a, n, k in zip("zyx", "dhw", size):
        m = m.withColumn(a, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(k), F.col(n)) - 1)))
    m = m.filter(outside).select(*[F.lit(fills[c]).cast(t).alias(c) if c in fills else F.col(c) for c, t in df.dtypes])
    out = df.unionByName(m)
    for n, k in zip("dhw", size):
        out = out.withColumn(n, F.greatest(F.col(n), F.lit(k)))
    return out
