"""Row filters for scoring tables, splits, vectors and logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clip
from ..functions.vectors import is_finite, norm
from .ordering import rank_rows


def valid_rows(df: DataFrame, gt: str = "gt", ignore: int = 255, mask: str | None = None) -> DataFrame:
    """Keep rows by ground truth only; an explicit mask column wins where it is not NULL."""
    keep = F.col(gt) != ignore
    return df.filter(keep if mask is None else F.coalesce(F.col(mask), keep))


def in_range(df: DataFrame, n: int, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Ground truth must be one of 0..n-1; predictions are clamped into that range."""
    return df.filter(F.col(gt).between(0, n - 1)).withColumn(pred, clip(F.col(pred), 0, n - 1))


# Indoor evaluation window, rows 45..470 and columns 41..600 inclusive.
INDOOR_WINDOW = (45, 470, 41, 600)


def depth_mask(df: DataFrame, lo: float, hi: float, crop: tuple[int, int, int, int] | None = None,
               gt: str = "gt", y: str = "y", x: str = "x") -> DataFrame:
    """Strict depth range, optionally inside a window (first row, last row, first col, last col)."""
    out = df.filter((F.col(gt) > lo) & (F.col(gt) < hi))
    if crop:
        out = out.filter(F.col(y).between(crop[0], crop[1]) & F.col(x).between(crop[2], crop[3]))
    return out


def select_split(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def finite_samples(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Drop every sample that holds a NaN, an infinity or a NULL."""
    bad = df.filter(~is_finite(F.col(value))).select(sample).distinct()
    return df.join(bad, sample, "left_anti")


def check_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Violations: vectors that are NULL, hold non-finite entries, or have zero length."""
    rule = (F.when(F.col(vec).isNull(), "null")
             .when(F.exists(F.col(vec), lambda v: ~is_finite(v)), "non_finite")
             .when(norm(F.col(vec)) == 0, "zero_norm"))
    return df.select(key, rule.alias("rule")).filter(F.col("rule").isNotNull())


def valid_obs(df: DataFrame, keys: Sequence[str], value: str = "value", mask: str | None = None) -> DataFrame:
    """Observations (``keys``, e.g. pixel and date) that are usable: mask set, or any band non-zero."""
    if mask is not None:
        return df.filter(F.col(mask) != 0).select(*keys).distinct()
    return df.groupBy(*keys).agg(F.bool_or(F.col(value) != 0).alias("_ok")).filter("_ok").drop("_ok")


def take(df: DataFrame, order: Sequence[str], indices: int | Sequence[int]) -> DataFrame:
    """First n rows in a total order, or the rows at explicit 0-based positions."""
    if isinstance(indices, int):
        return df.orderBy(*order).limit(indices)
    return rank_rows(df, order, name="_rn").filter((F.col("_rn") - 1).isin(list(indices))).drop("_rn")


def legal_labels(df: DataFrame, n: int, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(label).between(0, n - 1)).select(*keys, label).distinct()


def scan_logs(df: DataFrame, pattern: str, text: str, order: Sequence[str], first: int = 20) -> DataFrame:
    """First matching lines in order; the limit is part of the report."""
    return df.filter(F.col(text).rlike(pattern)).orderBy(*order).limit(first)


def completed(df: DataFrame, marker: str, text: str, by: Sequence[str]) -> DataFrame:
    """Per log: does any line carry the completion marker."""
    return df.groupBy(*by).agg(F.bool_or(F.col(text).contains(marker)).alias("completed"))
