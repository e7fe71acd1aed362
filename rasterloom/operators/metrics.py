"""Label scoring: areas, confusion matrices and everything derived from them.

All scores start from pair counts ``(gt, pred) -> rows``; those are combined map-side, so a
table of any size shuffles at most classes^2 rows per task and group.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .filters import in_range, valid_rows
from .ordering import agg_join

METRICS = {"mIoU": ("iou", "acc"), "mDice": ("dice", "acc"), "mFscore": ("fscore", "precision", "recall")}


def class_list(df: DataFrame, n: int, name: str = "class_id") -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def pair_counts(df: DataFrame, gt: str = "gt", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def areas(df: DataFrame, n: int, gt: str = "gt", pred: str = "pred", ignore: int | None = 255,
          by: Sequence[str] = (), mode: str = "strict", mask: str | None = None) -> DataFrame:
    """Intersection, prediction, label and union area per group and class (classes that occur).

    ``mode='strict'``: rows are dropped on ground truth only, labels outside 0..n-1 simply fall out.
    ``mode='eo'``: ground truth must be in range and predictions are clamped.
    """
    rows = df if ignore is None else valid_rows(df, gt, ignore, mask)
    if mode == "eo":
        rows = in_range(rows, n, gt, pred)
    pairs = pair_counts(rows, gt, pred, by)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gt").alias("class_id"), hit.alias("i"), zero.alias("p"), F.col("n").alias("l")),
        F.struct(F.col("pred").alias("class_id"), zero.alias("i"), F.col("n").alias("p"), zero.alias("l")))
    long = pairs.select(*by, F.inline(sides)).filter(F.col("class_id").between(0, n - 1))
    out = long.groupBy(*by, "class_id").agg(F.sum("i").alias("intersect"), F.sum("p").alias("pred_area"),
                                            F.sum("l").alias("label_area"))
    return out.withColumn("union_area", F.col("pred_area") + F.col("label_area") - F.col("intersect"))


def total_areas(df: DataFrame, n: int, **kw) -> DataFrame:
    """Dataset areas, one row for each of the n classes."""
    cols = ("intersect", "pred_area", "label_area", "union_area")
    got = areas(df, n, **kw)
    return (class_list(df, n).join(got, "class_id", "left")
            .select("class_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols]))


def per_class(total: DataFrame, beta: float = 1.0, nan_to_num: float | None = None) -> DataFrame:
    """Per-class ratios from areas; 0/0 is NULL unless ``nan_to_num`` replaces it."""
    i, p, l, u = (F.col(c).cast("double") for c in ("intersect", "pred_area", "label_area", "union_area"))
    precision, recall = F.try_divide(i, p), F.try_divide(i, l)
    b2 = F.lit(float(beta) ** 2)
    cols = {
        "iou": F.try_divide(i, u), "acc": recall, "dice": F.try_divide(2 * i, p + l),
        "fscore": F.try_divide((1 + b2) * precision * recall, b2 * precision + recall),
        "precision": precision, "recall": recall,
    }
    if nan_to_num is not None:
        cols = {k: F.coalesce(c, F.lit(float(nan_to_num))) for k, c in cols.items()}
    return total.select("*", *[c.alias(k) for k, c in cols.items()])


def seg_metrics(total: DataFrame, metrics: Sequence[str] = ("mIoU",), beta: float = 1.0,
                nan_to_num: float | None = None) -> DataFrame:
    """One report row: overall accuracy and NULL-skipping class means in percent, two digits."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise KeyError(f"metrics {sorted(unknown)} are not supported")
    names = list(dict.fromkeys(c for m in metrics for c in METRICS[m]))
    table = per_class(total, beta, nan_to_num)
    overall = F.try_divide(F.sum("intersect").cast("double"), F.sum("label_area").cast("double"))
    return table.agg(F.round(overall * 100, 2).alias("aacc"),
                     *[F.round(F.avg(c) * 100, 2).alias(f"m_{c}") for c in names])


def pixel_accuracy(df: DataFrame, gt: str = "gt", pred: str = "pred", ignore: int = 255,
                   mask: str | None = None) -> DataFrame:
    rows = valid_rows(df, gt, ignore, mask)
    return rows.agg(F.count("*").alias("pixels"),
                    F.avg((F.col(gt) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, n: int, gt: str = "gt", pred: str = "pred", ignore: int | None = 255) -> DataFrame:
    """Dense n x n confusion matrix in long form, absent pairs are 0."""
    rows = df if ignore is None else valid_rows(df, gt, ignore)
    counts = pair_counts(rows.filter(F.col(gt).between(0, n - 1) & F.col(pred).between(0, n - 1)), gt, pred)
    grid = df.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("gt"),
                                               (F.col("id") % n).cast("int").alias("pred"))
    return grid.join(counts, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_pct(cm: DataFrame) -> DataFrame:
    """Row-normalised percentages; rows of an absent class are -1."""
    tot = agg_join(cm, ["gt"], F.sum("n").alias("row_n"))
    pct = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("row_n").cast("double")), F.lit(-1.0))
    return tot.select("gt", "pred", pct.alias("pct"))


def confusion_classes(cm: DataFrame) -> DataFrame:
    """Per class: true positives, ground-truth rows, predicted rows."""
    both = cm.select(F.inline(F.array(
        F.struct(F.col("gt").alias("class_id"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))))
    return both.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def miou_from_confusion(cm: DataFrame) -> DataFrame:
    """Mean IoU over classes whose union is not empty, unscaled."""
    union = F.col("support") + F.col("predicted") - F.col("tp")
    return confusion_classes(cm).agg(F.avg(F.when(union > 0, F.col("tp") / union)).alias("miou"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(cm: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class seen in ground truth or prediction, 0/0 -> 0."""
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return (confusion_classes(cm).filter((s > 0) | (p > 0))
            .select("class_id", "tp", "support", "predicted", _ratio(tp, p).alias("precision"),
                    _ratio(tp, s).alias("recall"), _ratio(2 * tp, s + p).alias("f1")))


def classification_report(cm: DataFrame) -> DataFrame:
    """One row of accuracy, balanced accuracy, macro and weighted scores."""
    seen = F.col("support") > 0
    n = F.sum("support").cast("double")
    return class_scores(cm).agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))


def cls_metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 over classes that have ground truth."""
    scored = class_scores(cm).filter(F.col("support") > 0)
    n = F.sum("support").cast("double")
    return scored.agg((F.sum("tp") / n).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
                      F.avg("f1").alias("macro_f1"))


def label_stats(df: DataFrame, n: int, sample: str, label: str = "label", ignore: int = 255) -> DataFrame:
    """Zero-filled class counts plus ignore and out-of-range rows, each with its number of samples."""
    value = F.col("label")
    kind = F.when(value == ignore, "ignore").when(value.between(0, n - 1), "class").otherwise("out_of_range")
    counts = (df.groupBy(F.col(label).alias("label"), sample).agg(F.count("*").alias("c"))
                .groupBy("label").agg(F.sum("c").alias("pixels"), F.count("*").alias("samples")))
    grid = class_list(df, n, "label")
    full = grid.join(counts, "label", "full_outer")
    return full.select("label", kind.alias("kind"), F.coalesce("pixels", F.lit(0)).alias("pixels"),
                       F.coalesce("samples", F.lit(0)).alias("samples"))


def sample_summary(df: DataFrame, sample: str, label: str, ignore: int = 255) -> DataFrame:
    """Shape, range, distinct labels, valid and total pixels of each sample.

    Labels are counted first, so the per-sample list is built from distinct labels only.
    """
    slim = df.groupBy(sample, F.col(label).alias("_l")).agg(
        F.count("*").alias("c"), F.max("y").alias("y"), F.max("x").alias("x"))
    return slim.groupBy(sample).agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.min("_l").alias("min_label"),
        F.max("_l").alias("max_label"), F.array_join(F.sort_array(F.collect_list("_l")), ",").alias("uniques"),
        F.sum(F.when(F.col("_l") != ignore, F.col("c")).otherwise(0)).alias("valid_pixels"),
        F.sum("c").alias("pixels"))


def presence(df: DataFrame, n: int, sample: str, label: str) -> DataFrame:
    """0/1 for every sample and class."""
    seen = df.filter(F.col(label).between(0, n - 1)).select(sample, F.col(label).alias("class_id"),
                                                            F.lit(1).alias("present")).distinct()
    grid = df.select(sample).distinct().select(sample, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class_id"))
    return grid.join(seen, [sample, "class_id"], "left").select(
        sample, "class_id", F.coalesce("present", F.lit(0)).alias("present"))


def crop_ok(df: DataFrame, tile: Sequence[str], ratio: float, label: str = "label", ignore: int = 255) -> DataFrame:
    """Per tile: more than one class and no class at or above ``ratio`` of the counted pixels."""
    counts = df.filter(F.col(label) != ignore).groupBy(*tile, label).agg(F.count("*").alias("c"))
    tiles = df.select(*tile).distinct()
    ok = counts.groupBy(*tile).agg(((F.count("*") > 1) & (F.max("c") / F.sum("c") < ratio)).alias("ok"))
    return tiles.join(ok, list(tile), "left").select(*tile, F.coalesce("ok", F.lit(False)).alias("ok"))


def tree_scores(df: DataFrame, keys: Sequence[str], cls: str, parent: str, score: str) -> DataFrame:
    """Consistent scores over a two-level tree: parent = max(own, children), child = min(own, parent).

    Rows carry class, parent class (NULL for parents) and score.
    """
    keys = list(keys)
    kids = df.filter(F.col(parent).isNotNull()).groupBy(*keys, F.col(parent).alias("_c")).agg(F.max(score).alias("_kid"))
    tops = (df.filter(F.col(parent).isNull()).withColumnRenamed(cls, "_c").join(kids, [*keys, "_c"], "left")
              .select(*keys, F.col("_c").alias(cls), F.col(parent), F.greatest(score, "_kid").alias("fixed"),
                      F.col(score).alias("_own")))
    own = tops.select(*keys, F.col(cls).alias("_p"), F.col("_own"))
    low = (df.filter(F.col(parent).isNotNull()).withColumn("_p", F.col(parent)).join(own, [*keys, "_p"], "left")
             .select(*keys, cls, parent, F.least(score, "_own").alias("fixed")))
    return tops.drop("_own").unionByName(low)
