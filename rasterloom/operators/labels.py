"""Label vocabularies and recoding of label columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import lookup
from ..session import dealt
from .joins import lookup_join
from .ordering import rank_rows


def build_label_map(old: DataFrame, new: DataFrame, ignore: int = 255) -> DataFrame:
    """old_id -> new_id by class name; classes missing from ``new`` go to ignore.

    Both inputs carry (name, class_id). Use ``check_subset`` to reject names unknown to ``old``.
    """
    n = new.select("name", F.col("class_id").alias("new_id"))
    return (old.select("name", F.col("class_id").alias("old_id")).join(n, "name", "left")
               .select("name", "old_id", F.coalesce("new_id", F.lit(ignore)).cast("int").alias("new_id")))


def recode(df: DataFrame, table: DataFrame, label: str, default: int | None = None) -> DataFrame:
    """Apply (old_id, new_id) to a label column in one step; unmapped ids stay or take ``default``."""
    m = table.select(F.col("old_id").alias(label), F.col("new_id").alias("_new"))
    fallback = F.col(label) if default is None else F.lit(default)
    cols = [F.coalesce("_new", fallback).cast("int").alias(label) if c == label else F.col(c) for c in df.columns]
    return lookup_join(df, m, [label]).select(*cols)


def recode_array(df: DataFrame, mapping: dict[int, int], labels: str, default: int | None = None) -> DataFrame:
    """The same on a row-major label array."""
    return df.withColumn(labels, F.transform(F.col(labels), lambda x: lookup(x, mapping, default)))


def densify_ids(df: DataFrame, vocab: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Sparse ids -> dense ranks of the sorted vocabulary, and the rows whose id is not in it."""
    ranks = rank_rows(vocab.select(label).distinct(), [label], name="_r").select(label, (F.col("_r") - 1).alias("dense_id"))
    good = lookup_join(df, ranks, [label], "inner")
    bad = df.join(vocab.select(label).distinct(), label, "left_anti")
    return good, bad


def color_to_class(df: DataFrame, palette: DataFrame, default: int = 0) -> DataFrame:
    """Exact (r, g, b) match; colours outside the palette take ``default``. The palette must be injective."""
    if palette.groupBy("r", "g", "b").count().filter("count > 1").limit(1).count():
        raise ValueError("two classes share one colour")
    keyed = lookup_join(df, palette.select("r", "g", "b", F.col("class_id").alias("_c")), ["r", "g", "b"])
    return keyed.withColumn("class_id", F.coalesce("_c", F.lit(default)).cast("int")).drop("_c")


def subset_palette(palette: DataFrame, label_map: DataFrame, ignore: int = 255) -> DataFrame:
    """Colours of the kept classes under their new ids."""
    kept = label_map.filter(F.col("new_id") != ignore).select(F.col("old_id").alias("class_id"), "new_id")
    return palette.join(kept, "class_id").select(F.col("new_id").alias("class_id"), "r", "g", "b")


def random_palette(classes: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded colours for classes that have none."""
    h = F.xxhash64(F.lit(seed), F.col("class_id"))
    return classes.select("class_id", *[(F.shiftright(h, s).bitwiseAND(255)).cast("int").alias(c)
                                        for c, s in (("r", 0), ("g", 8), ("b", 16))])


def collapse_channels(df: DataFrame, keys: Sequence[str], channel: str, value: str, n_channels: int) -> DataFrame:
    """Channel stack -> one label per pixel: the last active channel wins.

    Channel j becomes label j + 1, the last channel is background (0); no active channel is 0 as well.
    """
    top = F.max(F.when(F.col(value) != 0, F.col(channel)))
    return df.groupBy(*keys).agg(F.coalesce((top + 1) % n_channels, F.lit(0)).cast("int").alias("label"))


def class_masks(df: DataFrame, sample: str, label: str, ignore: int = 255) -> DataFrame:
    """One binary mask per class that occurs in the sample."""
    present = (df.filter(F.col(label) != ignore).select(sample, F.col(label).alias("class_id")).distinct()
                 .groupBy(sample).agg(F.collect_list("class_id").alias("_c")))      # at most one entry per class
    return (df.join(present, sample).withColumn("class_id", F.explode("_c"))
              .withColumn("mask", (F.col(label) == F.col("class_id")).cast("int")).drop("_c"))


def rollup_labels(df: DataFrame, tree: DataFrame, label: str, ignore: int = 255) -> DataFrame:
    """Fine label -> parent class of a tree (class_id, parent_id)."""
    return recode(df, tree.select(F.col("class_id").alias("old_id"), F.col("parent_id").alias("new_id")), label, ignore)


def tree_counts(df: DataFrame, tree: DataFrame, label: str) -> DataFrame:
    """Pixels per class, per parent and overall."""
    t = tree.select(F.col("class_id").alias(label), "parent_id")
    counts = df.groupBy(label).agg(F.count("*").alias("c")).join(t, label)
    return counts.rollup("parent_id", label).agg(F.sum("c").alias("pixels"))


def unpack_label(df: DataFrame, keys: Sequence[str], channel: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Packed samples: the last channel is the label, the others are the image."""
    last = df.groupBy(*keys).agg(F.max(channel).alias("_last"))
    marked = df.join(last, list(keys))
    image = marked.filter(F.col(channel) < F.col("_last")).drop("_last")
    label = marked.filter(F.col(channel) == F.col("_last")).withColumnRenamed(value, "label").drop("_last", channel)
    return image, label


def label_anchor(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchor of each mask: row with most pixels (lowest on ties), its middle pixel.

    ``df`` holds the set pixels. Rows of one mask are short, so only a row's columns are ranked. Pixels are dealt once by row, to
    as many partitions as their number asks for.
    """
    keys = list(keys)
    df = dealt(df, *keys, "y")
    rows = df.groupBy(*keys, "y").agg(F.count("*").alias("c"))
    parts = df.rdd.getNumPartitions()
    best = dealt(rows, *keys, wanted=parts).groupBy(*keys).agg(F.max_by(F.struct("y", "c"), F.struct("c", -F.col("y"))).alias("b"))
    best = best.select(*keys, F.col("b.y").alias("y"), F.col("b.c").alias("c"))
    ranked = dealt(df.join(best, [*keys, "y"]), *keys, wanted=parts).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("x")) - 1)
    return ranked.filter(F.col("_i") == F.floor(F.col("c") / 2)).select(*keys, "y", "x")


def split_fingerprint(df: DataFrame, split: str, sample: str, label: str) -> DataFrame:
    """Order-independent digest of the (sample, label) pairs of a split.

    Four seeded hashes are combined by exclusive-or and by sum, so partial digests merge before the shuffle.
    """
    hashes = [F.xxhash64(F.lit(seed), F.col(sample), F.col(label)) for seed in range(4)]
    parts = df.groupBy(split).agg(F.count("*").alias("n"), *[F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(hashes)],
                                  *[F.sum(h.cast("decimal(38,0)")).alias(f"s{i}") for i, h in enumerate(hashes)])
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in parts.columns if c != split])
    return parts.select(split, F.sha2(text, 256).alias("digest"))
