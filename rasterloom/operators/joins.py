"""Joins of manifests, labels, tokens and embedding exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import token_index
from .ordering import percentiles, with_one
from .stencil import BLOCK, differing, over_blocks

BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000      # of a dimension table


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a dimension table, broadcast only when its rows and its bytes (as JSON text) are counted to be few.

    Larger tables take an ordinary shuffle join, where AQE splits hot keys.
    """
    size = table.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    small = size["n"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(table) if small else table, list(on), how)


def pair(images: DataFrame, masks: DataFrame, on: str = "stem") -> DataFrame:
    """Images with their mask, NULL where there is none."""
    return images.join(masks, on, "left")


def attach_labels(manifest: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Manifest with labels and an ``error`` column that names rows without one."""
    joined = manifest.join(labels.select(key, label), key, "left")
    return joined.withColumn("error", F.when(F.col(label).isNull(), F.lit("missing_label")))


def join_tokens(pixels: DataFrame, tokens: DataFrame, sample: str, h: str | int, w: str | int,
                grid_h: int, grid_w: int) -> DataFrame:
    """Attach to every pixel the feature token that covers its centre (tokens keyed by gy, gx)."""
    height, width = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (h, w))
    keyed = (pixels.withColumn("gy", token_index(F.col("y"), height, F.lit(grid_h)))
                   .withColumn("gx", token_index(F.col("x"), width, F.lit(grid_w))))
    return keyed.join(tokens, [sample, "gy", "gx"])


def unknown_classes(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    return other.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


def neighbour_diff(pixels: DataFrame, sample: str, value: str, offsets: Sequence[tuple[int, int]] = ((1, 0), (0, 1)),
                   ignore: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Pixel pairs (pixel, neighbour at dy, dx) with different values, in one shuffle by blocks of pixels.

    ``carry`` columns of the pixel stay in the result. NULL values differ from nothing; repeated positions pair with each other's copies.
    """
    slim = pixels.select(sample, "y", "x", *carry, F.col(value).alias("v")).filter("v IS NOT NULL")
    if ignore is not None:
        slim = slim.filter(F.col("v") != ignore)
    types = dict(slim.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in (sample, *carry, "y", "x")], "dy int", "dx int", f"v0 {types['v']}", f"v {types['v']}"])
    offsets = list(offsets)

    def pairs(table):
        import numpy as np
        import pyarrow as pa
        at, other, which = differing(table, "v", offsets, BLOCK)
        mine = table.select([sample, *carry, "y", "x"]).take(pa.array(at))
        step = np.asarray(offsets, dtype=np.int32)[which].reshape(-1, 2)
        values = table.column("v").combine_chunks()
        new = {"dy": pa.array(step[:, 0]), "dx": pa.array(step[:, 1]), "v0": values.take(pa.array(at)), "v": values.take(pa.array(other))}
        for name, col in new.items():
            mine = mine.append_column(name, col)
        return mine

    reach = [(min(o[i] for o in offsets), max(o[i] for o in offsets)) for i in (0, 1)]
    return over_blocks(slim, sample, *reach, pairs, schema)


def pair_dates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two acquisitions of one sample; ``same_shape`` is false where their h, w differ."""
    right = b.select(key, F.col("h").alias("h2"), F.col("w").alias("w2"),
                     *[F.col(c).alias(f"{c}2") for c in b.columns if c not in (key, "h", "w")])
    return a.join(right, key).withColumn("same_shape", (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2")))


def compare_exports(a: DataFrame, b: DataFrame, key: str, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Rows of two exports that do not agree: key, rule (missing_left, missing_right, size, label or values) and the largest |a-b|."""
    left = a.select(key, F.col(vec).alias("_a"), F.col(label).alias("_la"), F.lit(True).alias("_in_a"))
    right = b.select(key, F.col(vec).alias("_b"), F.col(label).alias("_lb"), F.lit(True).alias("_in_b"))
    both = left.join(right, key, "full")
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    same_size = F.size("_a") == F.size("_b")
    rule = (F.when(F.col("_in_a").isNull(), "missing_left").when(F.col("_in_b").isNull(), "missing_right").when(~same_size, "size")
             .when(~F.col("_la").eqNullSafe(F.col("_lb")), "label").when(gap > 0, "values"))
    return both.select(key, rule.alias("rule"), F.when(same_size, gap).alias("max_abs")).filter("rule IS NOT NULL")


def embedding_diff(a: DataFrame, b: DataFrame, key: str, vec: str = "embedding", label: str | None = None) -> DataFrame:
    """One row comparing two exports: max, mean and 95th percentile of |a-b|, mean cosine, label mismatches.

    The percentile ranks the long difference table slice by slice.
    """
    cols = [key, vec] + ([label] if label else [])
    right = b.select(key, F.col(vec).alias("_v"), *([F.col(label).alias("_l")] if label else []))
    both = a.select(*cols).join(right, key)
    long = both.select(key, F.inline(F.arrays_zip(F.col(vec).cast("array<double>").alias("a"),
                                                  F.col("_v").cast("array<double>").alias("b"))))
    long = long.toDF(key, "a", "b").withColumn("d", F.abs(F.col("a") - F.col("b")))
    overall = long.agg(F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"))
    per = long.groupBy(key).agg(F.try_divide(F.sum(F.col("a") * F.col("b")),
                                             F.sqrt(F.sum(F.col("a") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2))).alias("c"))
    cos = per.agg(F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"))
    out = with_one(overall, cos, percentiles(long, [], "d", {"p95_abs": 0.95}))
    if label:
        out = with_one(out, both.agg(F.count_if(F.col(label) != F.col("_l")).alias("label_mismatches")))
    return out


def densify_bands(df: DataFrame, sample: str, date: str, band: str, value: str, bands: Sequence[str],
                  fill: float | None = None) -> DataFrame:
    """Every (sample, date, band); holes take ``fill``, or stay NULL and are flagged as missing."""
    grid = df.select(sample, date).distinct().withColumn(band, F.explode(F.array(*[F.lit(b) for b in bands])))
    full = grid.join(df.select(sample, date, band, value), [sample, date, band], "left")
    missing = F.col(value).isNull()
    return full.select(sample, date, band, F.coalesce(F.col(value), F.lit(fill).cast("double")).alias(value),
                       missing.alias("was_missing"))


def fill_missing_masks(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Images without a mask get an all-zero label array of their own size."""
    return images.join(masks.select(key, "labels"), key, "left").withColumn(
        "labels", F.coalesce("labels", F.array_repeat(F.lit(0), (F.col("h") * F.col("w")).cast("int"))))


def present(names: DataFrame, files: DataFrame, key: str, invert: bool = False) -> DataFrame:
    return names.join(files.select(key).distinct(), key, "left_anti" if invert else "left_semi")
