"""Ranking scores of class-score vectors: top-k, any-match, reciprocal rank, 11-point precision."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import running

FLOAT32_EPS = 1.1920928955078125e-07     # fixed value: spacing of 1.0 in 32-bit floats


def target_rank(scores: Column, target: Column) -> Column:
    """1-based rank of the target score, ties broken by the lower class index."""
    own = F.try_element_at(scores, target.cast("int") + 1)
    ahead = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < target)))
    return F.size(ahead) + 1


def topk_accuracy(df: DataFrame, label: str, scores: str, ks: Sequence[int] = (1, 5),
                  thresh: float | None = None, ignore: int | None = None) -> DataFrame:
    """Top-k accuracy in percent; numerator and denominator carry a float32 epsilon."""
    rows = df if ignore is None else df.filter(F.col(label) != ignore)
    rank = target_rank(F.col(scores), F.col(label))
    own = F.try_element_at(F.col(scores), F.col(label).cast("int") + 1)
    ranked = rows.select(rank.alias("r"), (F.lit(True) if thresh is None else own > thresh).alias("sure"))
    total = F.count("*") + F.lit(FLOAT32_EPS)
    return ranked.agg(*[((F.count_if((F.col("r") <= k) & F.col("sure")) + F.lit(FLOAT32_EPS)) * 100.0 / total)
                        .alias(f"top{k}") for k in ks])


def topk_classes(scores: Column, k: int) -> Column:
    """Class indices of the k largest scores, best first, lower index first on ties."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def any_match_rows(df: DataFrame, scores: str, targets: str, k: int) -> DataFrame:
    """0/1 per row: does any of the top k classes occur in the targets; rows without targets are dropped."""
    wanted = F.filter(F.col(targets), lambda t: t >= 0)
    hit = F.arrays_overlap(topk_classes(F.col(scores), k), wanted).cast("int")
    return df.filter(F.size(wanted) > 0).withColumn("hit", hit)


def any_match(df: DataFrame, scores: str, targets: str, k: int = 1) -> DataFrame:
    return any_match_rows(df, scores, targets, k).agg(F.avg("hit").alias("accuracy"), F.count("*").alias("rows"))


def any_match_by(df: DataFrame, scores: str, targets: str, attrs: Sequence[str], k: int = 1) -> DataFrame:
    """Overall accuracy and accuracy by each attribute in one pass over grouping sets."""
    rows = any_match_rows(df, scores, targets, k)
    sets = [[F.col(a)] for a in attrs] + [[]]
    return (rows.groupingSets(sets, *[F.col(a) for a in attrs])
                .agg(F.grouping_id().alias("level"), F.avg("hit").alias("accuracy"), F.count("*").alias("rows")))


def macro_mrr(df: DataFrame, label: str, scores: str, n: int) -> DataFrame:
    """Mean over classes of the mean reciprocal rank; rank counts scores at or above the target score."""
    own = F.try_element_at(F.col(scores), F.col(label).cast("int") + 1)
    rr = F.lit(1.0) / F.size(F.filter(F.col(scores), lambda s: s >= own))
    by_class = df.groupBy(label).agg(F.sum(rr).alias("s"), F.count("*").alias("c"))
    return by_class.agg((F.sum(F.col("s") / (F.col("c") + F.lit(1e-6))) / F.lit(n)).alias("macro_mrr"))


def map_11pt(df: DataFrame, cls: str, score: str, positive: str, levels: int = 11) -> DataFrame:
    """Interpolated precision at equally spaced recall levels, averaged over levels and classes.

    Rows are (class, score, 0/1). Equal scores are one threshold, so they are combined before ranking.
    """
    counted = df.groupBy(cls, score).agg(F.sum(positive).alias("p"), F.count("*").alias("n"))
    curve = running(counted, [(score, "desc")], [cls], rank=None, sums={"tp": "p", "seen": "n"}, totals={"pos": "p"})
    recall = F.try_divide(F.col("tp").cast("double"), F.col("pos").cast("double"))
    precision = F.col("tp") / F.col("seen")
    best = [F.max(F.when(recall >= F.lit(i / (levels - 1)), precision)) for i in range(levels)]
    best[0] = F.lit(1.0)        # the curve ends at recall 0 with precision 1
    at = curve.groupBy(cls).agg(F.array(*[F.coalesce(b, F.lit(0.0)) for b in best]).alias("best"))
    return at.select(F.explode("best").alias("b")).agg(F.avg("b").alias("map_11pt"))


def corruption_error(df: DataFrame, ref: DataFrame, kind: str = "kind", level: str = "level",
                     accuracy: str = "accuracy", ref_error: str = "ref_error") -> DataFrame:
    """Relative corruption error per kind, over the levels present; kinds without results are left out."""
    both = ref.join(df, [kind, level])
    return both.groupBy(kind).agg((F.avg(1.0 - F.col(accuracy)) / F.avg(ref_error)).alias("relative_error"))


def mean_corruption_error(df: DataFrame, ref: DataFrame, **kw) -> DataFrame:
    return corruption_error(df, ref, **kw).agg(F.avg("relative_error").alias("mce"))


def average_tries(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and sample standard deviation of each metric over tries."""
    return df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


