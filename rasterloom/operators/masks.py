"""Instance masks and boxes: run-length codes, boxes, small regions, crop pyramids, suppression."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, dealt
from .graph import connected_components
from .ordering import running


def rle_encode(df: DataFrame, mask: str = "sample_id", value: str = "v") -> DataFrame:
    """Column-major run lengths (mask, h, w, counts), starting with the zero run.

    Runs are found column by column (windows never exceed one column) and joined at the column
    ends; only run starts, which are the output, meet per mask.
    """
    col = Window.partitionBy(mask, "x").orderBy("y")
    inner = df.select(mask, "h", "w", "y", "x", F.col(value).alias("v"), F.lag(value).over(col).alias("_prev"))
    ends = df.filter(F.col("y") == F.col("h") - 1).select(mask, (F.col("x") + 1).alias("x"), F.col(value).alias("_end"))
    first = inner.filter("y = 0").join(ends, [mask, "x"], "left").withColumn("_prev", F.coalesce("_end", F.lit(0))).drop("_end")
    starts = inner.filter("y > 0").unionByName(first).filter(F.col("v") != F.col("_prev"))
    pos = starts.groupBy(mask).agg(F.array_sort(F.collect_list((F.col("x") * F.col("h") + F.col("y")).cast("bigint"))).alias("_p"))
    dims = df.groupBy(mask).agg(F.first("h").alias("h"), F.first("w").alias("w"))
    n = (F.col("h") * F.col("w")).cast("bigint")
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("_p", F.array().cast("array<bigint>")), F.array(n))
    counts = F.zip_with(F.slice(edges, 2, F.size(edges) - 1), F.slice(edges, 1, F.size(edges) - 1), lambda b, a: b - a)
    return dims.join(pos, mask, "left").select(mask, "h", "w", counts.alias("counts"))


def rle_decode(df: DataFrame, mask: str = "sample_id", counts: str = "counts") -> DataFrame:
    """Set pixels (mask, y, x) of column-major run lengths."""
    runs = df.select(mask, "h", F.posexplode(counts).alias("i", "n"))
    runs = running(runs, ["i"], [mask], rank=None, sums={"end": "n"}).filter((F.col("i") % 2 == 1) & (F.col("n") > 0))
    pos = F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1))
    return runs.select(mask, "h", pos.alias("p")).select(mask, (F.col("p") % F.col("h")).cast("int").alias("y"), F.floor(F.col("p") / F.col("h")).cast("int").alias("x"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda v, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, v: a + v)


def stability(df: DataFrame, mask: Sequence[str], score: str, t: float, delta: float) -> DataFrame:
    """Pixels above t + delta over pixels above t - delta."""
    high, low = F.count_if(F.col(score) > t + delta), F.count_if(F.col(score) > t - delta)
    return df.groupBy(*mask).agg(F.try_divide(high.cast("double"), low.cast("double")).alias("stability"))


def mask_to_box(df: DataFrame, mask: str = "sample_id", value: str = "v") -> DataFrame:
    """Tight inclusive box of the set pixels; an empty mask gives 0, 0, 0, 0."""
    on = F.col(value) != 0
    aggs = [F.coalesce(f(F.when(on, F.col(a))), F.lit(0)).alias(n) for n, f, a in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))]
    return df.groupBy(mask).agg(*aggs)


def region_runs(df: DataFrame, mask: str, value: str) -> DataFrame:
    """Horizontal runs of set pixels: (mask, y, island, x0, x1)."""
    row = Window.partitionBy(mask, "y").orderBy("x")
    on = dealt(df.filter(F.col(value) != 0).select(mask, "y", "x"), mask, "y").select(mask, "y", "x", (F.col("x") - F.row_number().over(row)).alias("island"))
    return on.groupBy(mask, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))


RUNS_PER_CALL = 50_000


def _label_block(runs):
    """Runs of whole row blocks (``_k`` names the block) with ``local``, the smallest node of their region inside the block."""
    runs = runs.sort_values(["_k", "y", "x0"], ignore_index=True)
    block = runs.pop("_k").tolist()
    y, x0, x1, node = (runs[c].tolist() for c in ("y", "x0", "x1", "node"))
    root = list(range(len(y)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above, start, at = [], 0, 0
    for i in range(len(y)):
        if i and (y[i] != y[i - 1] or block[i] != block[i - 1]):
            above = list(range(start, i)) if y[i] == y[i - 1] + 1 and block[i] == block[i - 1] else []
            start, at = i, 0
        while at < len(above) and x1[above[at]] < x0[i] - 1:
            at += 1
        k = at
        while k < len(above) and x0[above[k]] <= x1[i] + 1:
            p, q = find(i), find(above[k])
            root[max(p, q)] = min(p, q)
            k += 1
    least = {}
    for i in range(len(y)):
        least[find(i)] = min(least.get(find(i), node[i]), node[i])
    return runs.assign(local=[least[find(i)] for i in range(len(y))])


def regions(df: DataFrame, mask: str = "sample_id", value: str = "v", cell: int = 64, block: int = 64) -> DataFrame:
    """8-connected regions of set pixels: each run with the number of its region.

    Runs are labelled inside blocks of ``block`` rows; only regions that touch across a block border enter the graph.
    Runs are numbered after they were written out, so the numbers are the same wherever they are read.
    """
    runs = cut_lineage(region_runs(df, mask, value)).withColumn("node", F.monotonically_increasing_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields) + ", local bigint"
    # many small blocks share a task call; a block is never split
    groups = 1 + runs.count() // RUNS_PER_CALL
    keyed = runs.withColumn("_k", F.struct(F.col(mask).alias("m"), F.floor(F.col("y") / block).alias("b"))).withColumn("_k", F.to_json("_k"))
    called = dealt(keyed.withColumn("_g", F.pmod(F.xxhash64("_k"), F.lit(groups))), "_g").groupBy("_g")
    local = cut_lineage(called.applyInPandas(lambda runs: _label_block(runs.drop(columns="_g")), schema).drop("node"))
    edge = F.pmod(F.col("y"), F.lit(block))
    reach = F.explode(F.sequence(F.floor((F.col("x0") - 1) / cell), F.floor((F.col("x1") + 1) / cell)))
    a = local.filter(edge == 0).select(mask, "y", "x0", "x1", F.col("local").alias("src"), reach.alias("_c"))
    b = local.filter(edge == block - 1).select(mask, (F.col("y") + 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("local").alias("dst"), reach.alias("_c"))
    touch = a.join(b, [mask, "y", "_c"]).filter((F.col("x0") <= F.col("bx1") + 1) & (F.col("x1") >= F.col("bx0") - 1)).select("src", "dst").distinct()
    touch = cut_lineage(touch)
    if not touch.take(1):
        return local.withColumnRenamed("local", "component")
    comp = connected_components(touch).withColumnRenamed("node", "local")
    return local.join(comp, "local", "left").withColumn("component", F.coalesce("component", "local")).drop("local")


def drop_small_regions(df: DataFrame, area: int, mode: str, mask: str = "sample_id", value: str = "v", cell: int = 64) -> DataFrame:
    """Fill holes or drop islands below ``area`` pixels; when every island is small, the largest stays.

    Returns the pixels with the new value and ``changed`` per mask.
    """
    if mode not in ("holes", "islands"):
        raise ValueError(f"unknown mode {mode}")
    work = df.withColumn("_v", F.when(F.col(value) != 0, 0).otherwise(1) if mode == "holes" else F.col(value))
    runs = cut_lineage(regions(work, mask, "_v", cell))
    size = runs.groupBy(mask, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"), F.min(F.struct("y", "x0")).alias("_at"))
    # the largest region, the first in reading order among equals
    best = F.max_by(F.struct("_n", "component"), F.struct("_n", -F.col("_at.y"), -F.col("_at.x0"))).alias("_b")
    top = size.groupBy(mask).agg(best, F.count_if(F.col("_n") < area).alias("_small"))
    top = cut_lineage(top.select(mask, F.col("_b._n").alias("_top"), F.col("_b.component").alias("_first"), "_small"))
    fate = size.join(top, mask)
    small = F.col("_n") < area
    gone = small if mode == "holes" else small & ~((F.col("_top") < area) & (F.col("component") == F.col("_first")))
    hit = runs.join(fate.filter(gone).select(mask, "component"), [mask, "component"])
    # facts of the mask and its runs reach the pixels by pieces of rows, which are dealt to as many partitions as the pixels ask for
    piece = [mask, "y", "_c"]
    by_piece = dealt(df.withColumn("_c", F.floor(F.col("x") / cell)), *piece)
    reach = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
    runs_of = hit.select(mask, "y", reach.alias("_c"), F.struct("x0", "x1").alias("_r")).groupBy(*piece).agg(F.collect_list("_r").alias("_runs"))
    facts = by_piece.select(*piece).distinct().join(top.select(mask, (F.col("_small") > 0).alias("changed")), mask).join(runs_of, piece, "left")
    inside = F.exists("_runs", lambda r: (F.col("x") >= r["x0"]) & (F.col("x") <= r["x1"]))
    out = by_piece.join(facts, piece, "left").withColumn(value, F.when(inside, F.lit(1 if mode == "holes" else 0)).otherwise(F.col(value)))
    return out.select(mask, "y", "x", *[c for c in df.columns if c not in (mask, "y", "x")], F.coalesce("changed", F.lit(False)).alias("changed"))


def crop_pyramid(rasters: DataFrame, layers: int, ratio: float) -> DataFrame:
    """The whole image, then 2^i x 2^i overlapping boxes per layer: (raster_id, layer, box_no, x0, y0, x1, y1)."""
    out = rasters.select("raster_id", F.lit(0).alias("layer"), F.lit(0).alias("box_no"), F.lit(0).alias("x0"), F.lit(0).alias("y0"),
                         F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1"))
    for layer in range(1, layers + 1):
        n = 2 ** layer
        ov = F.floor(F.lit(ratio) * F.least("width", "height") * F.lit(2.0 / n))
        d = rasters.withColumn("_o", ov)
        for a, size in (("w", "width"), ("h", "height")):
            d = d.withColumn(f"_{a}", F.ceil((F.col("_o") * (n - 1) + F.col(size)) / n))
        d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        x0, y0 = (F.col("_w") - F.col("_o")) * F.col("_i"), (F.col("_h") - F.col("_o")) * F.col("_j")
        out = out.unionByName(d.select(
            "raster_id", F.lit(layer).alias("layer"), (F.col("_i") * n + F.col("_j")).alias("box_no"), x0.cast("int").alias("x0"), y0.cast("int").alias("y0"),
            F.least(x0 + F.col("_w"), F.col("width")).cast("int").alias("x1"), F.least(y0 + F.col("_h"), F.col("height")).cast("int").alias("y1")))
    return out


def point_grid(rasters: DataFrame, n: int, layers: int, scale: int) -> DataFrame:
    """Evenly spaced points of each layer in the unit square and in pixels of the raster."""
    side = F.lit(n)
    d = rasters.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    d = d.withColumn("_n", F.floor(side / F.pow(F.lit(float(scale)), F.col("layer"))).cast("int")).filter("_n > 0")
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    px, py = (2 * F.col("_i") + 1) / (2 * F.col("_n")), (2 * F.col("_j") + 1) / (2 * F.col("_n"))
    return d.select("raster_id", "layer", (F.col("_j") * F.col("_n") + F.col("_i")).alias("point_no"), px.alias("px"), py.alias("py"),
                    (px * F.col("width")).alias("x"), (py * F.col("height")).alias("y"))


def uncrop_boxes(df: DataFrame, crop_x: str = "crop_x0", crop_y: str = "crop_y0") -> DataFrame:
    """Boxes from crop to image coordinates."""
    for c, o in (("x0", crop_x), ("x1", crop_x), ("y0", crop_y), ("y1", crop_y)):
        df = df.withColumn(c, F.col(c) + F.col(o))
    return df


def uncrop_points(df: DataFrame, crop_x: str = "crop_x0", crop_y: str = "crop_y0") -> DataFrame:
    return df.withColumn("x", F.col("x") + F.col(crop_x)).withColumn("y", F.col("y") + F.col(crop_y))


def near_edge(df: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Flag crop-frame boxes that touch their crop border but not the image border.

    Columns: x0..y1 (in the crop), crop_x0..crop_y1, img_w, img_h.
    """
    def close(a, b):
        return F.abs(a - b) <= tolerance
    sides = [(F.col("x0") + F.col("crop_x0"), "crop_x0", F.lit(0)), (F.col("y0") + F.col("crop_y0"), "crop_y0", F.lit(0)),
             (F.col("x1") + F.col("crop_x0"), "crop_x1", F.col("img_w")), (F.col("y1") + F.col("crop_y0"), "crop_y1", F.col("img_h"))]
    hit = F.lit(False)
    for pos, crop, img in sides:
        hit = hit | (close(pos, F.col(crop)) & ~close(pos, img))
    return df.withColumn("near_crop_edge", hit)


def filter_masks(df: DataFrame, iou: str, stability: str, iou_thresh: float, stability_thresh: float) -> DataFrame:
    """Predicted IoU strictly above, stability at or above its threshold; a threshold of 0 is off."""
    if iou_thresh > 0:
        df = df.filter(F.col(iou) > iou_thresh)
    if stability_thresh > 0:
        df = df.filter(F.col(stability) >= stability_thresh)
    return df


def _iou(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """IoU of two boxes given as functions from a name to its column."""
    p, q = (lambda n: a(n).cast("double")), (lambda n: b(n).cast("double"))
    iw = F.greatest(F.least(p("x1"), q("x1")) - F.greatest(p("x0"), q("x0")), F.lit(0.0))
    ih = F.greatest(F.least(p("y1"), q("y1")) - F.greatest(p("y0"), q("y0")), F.lit(0.0))
    areas = [(c("x1") - c("x0")) * (c("y1") - c("y0")) for c in (p, q)]
    return F.coalesce(F.try_divide(iw * ih, areas[0] + areas[1] - iw * ih), F.lit(0.0))


def box_iou(a: str = "", b: str = "k_") -> Column:
    return _iou(lambda n: F.col(a + n), lambda n: F.col(b + n))


def _cells(df: DataFrame, up: int, keep: Sequence[str]) -> DataFrame:
    """Each box in the cells it touches on its own level and ``up`` coarser ones (a few cells per level).

    A level-l box is 2^l to 2^(l+1) long and its cells are 2^(l+1) wide, whatever mix of sizes an image holds.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    d = df.withColumn("_own", F.floor(F.log2(side)).cast("int"))
    d = d.withColumn("level", F.explode(F.sequence(F.col("_own"), F.col("_own") + up))).withColumn("native", F.col("level") == F.col("_own"))
    width = F.pow(F.lit(2.0), F.col("level") + 1)
    for a, lo, hi in (("cx", "x0", "x1"), ("cy", "y0", "y1")):
        d = d.withColumn(a, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return d.select(*keep, "level", "cx", "cy", "native")


BROADCAST_IMAGES = 1 << 20
SMALL_IMAGE = 256       # boxes of an image up to which each is compared with all kept ones


def _greedy(df: DataFrame, iou: float, image: str, order: Column) -> DataFrame:
    """(image, o): the kept boxes of images of few boxes each, one fold an image; ``df`` holds proper boxes only."""
    box = ["x0", "y0", "x1", "y1"]
    ranked = F.sort_array(F.collect_list(F.struct(order.alias("o"), *box)), asc=False)
    none = F.array().cast(f"array<struct<o:{df.select(order.alias('o')).schema['o'].dataType.simpleString()},{','.join(f'{c}:{dict(df.dtypes)[c]}' for c in box)}>>")

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: _iou(lambda n: b[n], lambda n: k[n]) > iou), kept).otherwise(F.concat(kept, F.array(b)))

    folded = dealt(df, image).groupBy(image).agg(ranked.alias("_r")).select(image, F.aggregate("_r", none, step).alias("_kept"))
    return folded.select(image, F.explode("_kept.o").alias("o"))


def nms(df: DataFrame, iou: float, image: str = "image", key: str = "box_id", score: str = "score", small: int = SMALL_IMAGE) -> DataFrame:
    """Greedy suppression by descending score (ties by key), exact, without pairing boxes.

    Images of at most ``small`` boxes are folded one by one: their boxes move once. In the others boxes meet in cells.
    Boxes with IoU above t differ in length by less than 1/t, so they share a cell on the level of the
    larger one. A box that leads there against every box it could conflict with has no better open
    rival and is kept; a round keeps all such boxes and drops what they suppress. Winners of one cell
    are few, so the work per round is linear in the boxes however dense an image is. Exact copies of
    a box are reduced to their best one first.
    """
    if not 0 < iou < 1:
        raise ValueError("iou must lie between 0 and 1")
    up = math.ceil(math.log2(1 / iou))
    order = F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))
    box, cell = ["x0", "y0", "x1", "y1"], [image, "level", "cx", "cy"]
    proper = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    slim = df.select(image, key, score, *box).filter(F.col(image).isNotNull())
    kept = [slim.filter(~proper).select(image, key)]                    # zero area: overlaps nothing
    many = cut_lineage(slim.filter(proper).groupBy(image).count().filter(F.col("count") > small).select(image))
    n_many = many.count()                                               # at most one in ``small`` of the boxes
    few = slim.filter(proper)
    if n_many:
        many = F.broadcast(many) if n_many <= BROADCAST_IMAGES else many
        few = few.join(many, image, "left_anti")
    kept.append(_greedy(few, iou, image, order).select(image, (-F.col("o.k")).alias(key)))
    if not n_many:
        return df.join(_union(kept), [image, key], "left_semi")
    live = cut_lineage(slim.filter(proper).join(many, image, "left_semi").groupBy(image, *box).agg(F.max(order).alias("o")))
    while True:
        placed = _cells(live, up, [image, *box, "o"])
        leaders = placed.groupBy(*cell).agg(F.max("o").alias("_any"), F.max(F.when(F.col("native"), F.col("o"))).alias("_nat"))
        leads = F.when(F.col("native"), F.col("o") >= F.col("_any")).otherwise(F.col("_nat").isNull() | (F.col("o") > F.col("_nat")))
        won = placed.join(leaders, cell).groupBy(image, *box, "o").agg(F.bool_and(leads).alias("_ok")).filter("_ok").drop("_ok")
        won = cut_lineage(won)
        kept.append(won.select(image, (-F.col("o.k")).alias(key)))
        rivals = _cells(won, up, [image, *box, "o"]).select(*cell, F.col("native").alias("k_native"), *[F.col(c).alias(f"k_{c}") for c in box])
        hit = placed.join(rivals, cell).filter((F.col("native") | F.col("k_native")) & (box_iou() > iou)).select(image, "o").distinct()
        live = cut_lineage(live.join(hit, [image, "o"], "left_anti"))   # a winner overlaps itself and leaves as well
        if len(kept) > 32:
            kept = [cut_lineage(_union(kept))]
        if live.limit(1).count() == 0:
            return df.join(_union(kept), [image, key], "left_semi")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
