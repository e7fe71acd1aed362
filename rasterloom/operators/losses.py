"""Evaluation losses as aggregates over a table of predictions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip
from ..functions.vectors import as_double, log_sum_exp, sigmoid, softmax, total
from .ordering import nth_smallest, running, with_one
from .ranking import FLOAT32_EPS


def reduce_loss(loss: Column, reduction: str = "mean", avg_factor: float | None = None) -> Column:
    """Reduction of a per-row loss: none leaves it as it is, sum and mean are aggregates.

    An explicit factor replaces the row count of the mean and gets a float32 epsilon.
    """
    if reduction == "none":
        return loss
    if reduction == "sum":
        if avg_factor is not None:
            raise ValueError("avg_factor can not be used with reduction='sum'")
        return F.sum(loss)
    if reduction != "mean":
        raise ValueError(f"unknown reduction {reduction}")
    return F.avg(loss) if avg_factor is None else F.sum(loss) / (F.lit(float(avg_factor)) + F.lit(FLOAT32_EPS))


def _score_of(scores: Column, label: Column) -> Column:
    return F.try_element_at(as_double(scores), label.cast("int") + 1)


def _weight_of(label: Column, weights: Mapping[int, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in (int(kv[0]), float(kv[1]))])
    return F.coalesce(F.try_element_at(table, label.cast("int")), F.lit(0.0))


def row_cross_entropy(label: Column, scores: Column, ignore: int, weights: Mapping[int, float] | None = None) -> Column:
    ce = (log_sum_exp(scores) - _score_of(scores, label)) * _weight_of(label, weights)
    return F.when(label == ignore, F.lit(0.0)).otherwise(ce)


def cross_entropy(df: DataFrame, label: str, scores: str, ignore: int = 255, avg: str = "all",
                  class_weight: Mapping[int, float] | None = None) -> DataFrame:
    """Softmax cross-entropy averaged over all rows, non-ignored rows, or the sum of class weights."""
    y = F.col(label)
    loss = F.sum(row_cross_entropy(y, F.col(scores), ignore, class_weight))
    weight = F.when(y == ignore, 0.0).otherwise(_weight_of(y, class_weight))
    denom = {"all": F.count("*").cast("double"), "valid": F.count_if(y != ignore).cast("double"),
             "weight": F.sum(weight)}[avg]
    return df.agg(F.try_divide(loss, denom).alias("loss"))


def bce_logits(x: Column, t: Column) -> Column:
    """Numerically safe binary cross-entropy on a logit."""
    x = x.cast("double")
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def _per_class(df: DataFrame, label: str, scores: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (row, class): score and one-hot target."""
    return (df.select(*keys, F.col(label).alias("_y"), F.posexplode(as_double(F.col(scores))).alias("class_id", "s"))
              .withColumn("t", (F.col("class_id") == F.col("_y")).cast("double")))


def binary_cross_entropy(df: DataFrame, label: str, scores: str, ignore: int = 255, avg: str = "all") -> DataFrame:
    """One-hot expanded; ignored rows weigh 0. ``avg`` = all entries or entries of valid rows."""
    long = _per_class(df, label, scores)
    valid = ((F.col("_y") >= 0) & (F.col("_y") != ignore)).cast("double")
    denom = F.count("*").cast("double") if avg == "all" else F.sum(valid)
    return long.agg((F.sum(bce_logits(F.col("s"), F.col("t")) * valid) / denom).alias("loss"))


def focal_loss(df: DataFrame, label: str, scores: str, gamma: float = 2.0, alpha: float | Sequence[float] = 0.5,
               ignore: int | None = None, class_weight: Mapping[int, float] | None = None) -> DataFrame:
    """Sigmoid focal loss averaged over all (row, class) entries."""
    long = _per_class(df, label, scores)
    p, t = sigmoid(F.col("s")), F.col("t")
    a = F.lit(float(alpha)) if not isinstance(alpha, (list, tuple)) else F.element_at(
        F.array(*[F.lit(float(v)) for v in alpha]), F.col("class_id") + 1)
    miss = (1 - p) * t + p * (1 - t)
    weight = (a * t + (1 - a) * (1 - t)) * F.pow(miss, F.lit(float(gamma)))
    weight = weight * _weight_of(F.col("class_id"), class_weight)
    if ignore is not None:
        weight = weight * (F.col("_y") != ignore).cast("double")
    return long.agg(F.avg(bce_logits(F.col("s"), t) * weight).alias("loss"))


def dice_loss(df: DataFrame, sample: str, label: str, probs: str, eps: float = 1e-3, naive: bool = False) -> DataFrame:
    """Per-sample dice loss over all pixels and classes, then the mean."""
    long = _per_class(df, label, probs, [sample])
    p, t = F.col("s"), F.col("t")
    if naive:
        d = (2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)
    else:
        d = 2 * F.sum(p * t) / (F.sum(p * p) + eps + F.sum(t * t) + eps)
    return long.groupBy(sample).agg((1 - d).alias("d")).agg(F.avg("d").alias("loss"))


def tversky_loss(df: DataFrame, sample: str, label: str, probs: str, alpha: float = 0.3, beta: float = 0.7,
                 smooth: float = 1.0, ignore: int = 255) -> DataFrame:
    """Per sample and class, summed over classes, divided by the class count, then the mean over samples."""
    long = _per_class(df, label, probs, [sample])
    p, t = F.col("s"), F.col("t")
    ok = (F.col("_y") != ignore).cast("double")
    tp, fp, fn = F.sum(p * t * ok), F.sum(p * (1 - t) * ok), F.sum((1 - p) * t * ok)
    one = 1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)
    return (long.groupBy(sample, "class_id").agg(one.alias("l"))
                .groupBy(sample).agg(F.avg("l").alias("l")).agg(F.avg("l").alias("loss")))


def _lovasz(df: DataFrame, by: Sequence[str], error: str, fg: str, tie: Sequence[str]) -> DataFrame:
    """Sum over errors, largest first, of relu(error) times the step of the Jaccard loss."""
    ran = running(df, [(error, "desc"), *tie], by, rank="_i",
                  sums={"_fg": F.col(fg), "_bg": 1 - F.col(fg)}, totals={"_gts": fg})
    gts, f, b = F.col("_gts"), F.col("_fg"), F.col("_bg")
    now = 1 - F.try_divide((gts - f).cast("double"), (gts + b).cast("double"))
    prev = 1 - F.try_divide((gts - f + F.col(fg)).cast("double"), (gts + b - 1 + F.col(fg)).cast("double"))
    step = now - F.when(F.col("_i") == 1, F.lit(0.0)).otherwise(prev)
    return ran.groupBy(*by).agg(F.sum(F.greatest(F.col(error), F.lit(0.0)) * step).alias("loss"),
                                F.max("_gts").alias("gts"))


def lovasz_hinge(df: DataFrame, label: str, score: str, key: Sequence[str], ignore: int = 255,
                 per_image: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(F.col(label) != ignore).withColumn("_fg", F.col(label).cast("bigint"))
    rows = rows.withColumn("_e", 1.0 - F.col(score).cast("double") * (2.0 * F.col(label) - 1.0))
    rows = rows.select(*{c: 0 for c in [*per_image, *key]}, "_e", F.col("_fg").alias("fg"))
    return _lovasz(rows, list(per_image), "_e", "fg", list(key)).agg(F.avg("loss").alias("loss"))


def lovasz_softmax(df: DataFrame, label: str, probs: str, key: Sequence[str], ignore: int = 255,
                   per_image: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes present (per image when asked)."""
    long = _per_class(df.filter(F.col(label) != ignore), label, probs, list({c: 0 for c in [*per_image, *key]}))
    rows = (long.withColumn("fg", F.col("t").cast("bigint")).withColumn("_e", F.abs(F.col("t") - F.col("s")))
                .drop("_y", "t", "s"))
    by_class = _lovasz(rows, [*per_image, "class_id"], "_e", "fg", list(key)).filter(F.col("gts") > 0)
    if per_image:
        by_class = by_class.groupBy(*per_image).agg(F.avg("loss").alias("loss"))
    return by_class.agg(F.avg("loss").alias("loss"))


def silog_loss(df: DataFrame, sample: str, gt: str = "gt", pred: str = "pred", eps: float = 1e-4) -> DataFrame:
    g, p = F.col(gt).cast("double"), F.col(pred).cast("double")
    d = F.log(F.greatest(g, F.lit(eps))) - F.log(F.greatest(p, F.lit(eps)))
    ok = (g > eps) & ~F.isnan(d)
    n = F.greatest(F.count_if(ok).cast("double"), F.lit(eps))
    sq, mean = F.sum(F.when(ok, d * d).otherwise(0.0)) / n, F.sum(F.when(ok, d).otherwise(0.0)) / n
    per = df.groupBy(sample).agg(F.sqrt(sq - 0.5 * mean * mean).alias("l"))
    return per.agg(F.avg("l").alias("loss"))


def kl_divergence(df: DataFrame, key: str, scores: str, target: str, temperature: float = 1.0,
                  reduction: str = "mean") -> DataFrame:
    """Per row: sum or mean over classes of t*(ln t - x), both sides softmaxed, 0 where t is 0.

    ``x`` is the softmaxed input itself (not its logarithm), as in the scored definition.
    """
    x = softmax(F.transform(as_double(F.col(scores)), lambda v: v / temperature))
    t = softmax(F.transform(as_double(F.col(target)), lambda v: v / temperature))
    terms = F.zip_with(t, x, lambda a, b: F.when(a > 0, a * (F.log(a) - b)).otherwise(0.0) * temperature ** 2)
    out = total(terms) if reduction == "sum" else total(terms) / F.size(terms)
    return df.select(key, out.alias("loss"))


def boundary_bce(df: DataFrame, edge: str, score: str) -> DataFrame:
    """Binary cross-entropy in which each side weighs the share of the other side.

    The weights depend on global counts only, so two sums per side finish the job in one pass.
    """
    t, l = F.col(edge), bce_logits(F.col(score), F.col(edge).cast("double"))
    sums = df.agg(F.count_if(t == 1).alias("p"), F.count_if(t == 0).alias("q"), F.count("*").alias("n"),
                  F.sum(F.when(t == 1, l).otherwise(0.0)).alias("lp"), F.sum(F.when(t == 0, l).otherwise(0.0)).alias("lq"))
    return sums.select(((F.col("lp") * F.col("q") + F.col("lq") * F.col("p")) / (F.col("p") + F.col("q")) / F.col("n"))
                       .alias("loss"))


def with_target_prob(df: DataFrame, label: str, scores: str, name: str = "_p") -> DataFrame:
    return df.withColumn(name, F.exp(_score_of(F.col(scores), F.col(label)) - log_sum_exp(F.col(scores))))


def ohem_cross_entropy(df: DataFrame, label: str, scores: str, key: Sequence[str], thr: float = 0.7,
                       min_kept: int = 100_000, ignore: int = 255) -> DataFrame:
    """Mean cross-entropy of rows whose target probability is below max(n-th smallest, thr)."""
    rows = with_target_prob(df.filter(F.col(label) != ignore), label, scores).select(*key, "_p")
    bound = nth_smallest(rows, "_p", key, min_kept)
    joined = with_one(rows, bound)
    kept = joined.filter(F.col("_p") < F.greatest(F.col("nth"), F.lit(float(thr))))
    return kept.agg(F.avg(-F.log("_p")).alias("loss"), F.count("*").alias("kept"))


def hard_pixels(df: DataFrame, prob: str, label: str, key: Sequence[str], thr: float | None, min_kept: int,
                batch: Sequence[str] = (), ignore: int = 255) -> DataFrame:
    """0/1 weight per row: hard by probability threshold, or (``thr`` None) the ``min_kept`` largest losses.

    ``prob`` is the target probability, or the loss when ``thr`` is None.
    """
    valid = df.filter(F.col(label) != ignore)
    by = list(batch)
    if thr is None:
        ranked = running(valid, [(prob, "desc"), *key], by, rank="_rn").select(*by, *key, (F.col("_rn") <= min_kept).cast("int").alias("_w"))
        on = list(dict.fromkeys([*by, *key]))
        return df.join(ranked, on, "left").withColumn("weight", F.coalesce("_w", F.lit(0))).drop("_w")
    bound = nth_smallest(valid, prob, key, min_kept, by)
    joined = df.join(bound, by, "left") if by else with_one(df, bound)
    hard = (F.col(label) != ignore) & (F.col(prob) < F.greatest(F.col("nth"), F.lit(float(thr))))
    return joined.withColumn("weight", F.coalesce(hard, F.lit(False)).cast("int")).drop("nth")
