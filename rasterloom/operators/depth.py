"""Depth error metrics: per image first, then an unweighted mean over images."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

DEPTH = ("d1", "d2", "d3", "abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "silog")
DEPTH_B = ("a1", "a2", "a3", "mae", "abs_rel", "sq_rel", "rmse", "rmse_log", "silog", "log_10")


def depth_per_image(df: DataFrame, sample: str, gt: str = "gt", pred: str = "pred", variant: str = "a") -> DataFrame:
    """Metrics of each image. An image with a prediction of 0 or less has no logarithmic metrics (NULL); a zero prediction
    or depth is outside every ratio limit."""
    g, p = F.col(gt).cast("double"), F.col(pred).cast("double")
    if variant == "b":
        df = df.filter(g > 0)
    ratio = F.when((g == 0) | (p == 0), F.lit(float("inf"))).otherwise(F.greatest(F.try_divide(g, p), F.try_divide(p, g)))
    err, dlog = p - g, F.log(p) - F.log(g)

    def logged(c):
        return F.when(F.min(p) > 0, c)

    def share(limit):
        return F.avg((ratio < limit).cast("double"))

    log_var = F.avg(dlog * dlog) - (0.5 if variant == "a" else 1.0) * F.pow(F.avg(dlog), F.lit(2.0))
    common = {
        "abs_rel": F.avg(F.try_divide(F.abs(err), g)), "sq_rel": F.avg(F.try_divide(err * err, g)), "rmse": F.sqrt(F.avg(err * err)),
        "rmse_log": logged(F.sqrt(F.avg(dlog * dlog))),
    }
    log10 = F.avg(F.abs(F.log10(p) - F.log10(g)))
    names = ("d1", "d2", "d3") if variant == "a" else ("a1", "a2", "a3")
    cols = {n: share(1.25 ** (i + 1)) for i, n in enumerate(names)} | common
    if variant == "a":
        cols |= {"log10": logged(log10), "silog": logged(F.sqrt(F.greatest(log_var, F.lit(0.0))))}
    else:
        cols |= {"mae": F.avg(F.abs(err)), "silog": logged(F.sqrt(F.greatest(log_var, F.lit(0.0))) * 100), "log_10": logged(log10)}
    return df.groupBy(sample).agg(*[c.alias(n) for n, c in cols.items()])


def depth_metrics(df: DataFrame, sample: str, metrics: Sequence[str] | None = None, variant: str = "a", **kw) -> DataFrame:
    names = metrics or (DEPTH if variant == "a" else DEPTH_B)
    per_image = depth_per_image(df, sample, variant=variant, **kw)
    return per_image.agg(*[F.avg(n).alias(n) for n in names])
