"""Vector expressions on ``array<float>`` columns; arithmetic is always in double."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, for use inside array lambdas."""
    return F.transform(F.array(value), fn)[0]


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(vec), lambda x: x * x)))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; NULL for a zero vector (check_vectors reports those)."""
    return let(norm(vec), lambda n: F.when(n > 0, F.transform(as_double(vec), lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def argmax(scores: Column) -> Column:
    """Index of the first maximum, 0-based."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_sum_exp(scores: Column) -> Column:
    return let(F.array_max(as_double(scores)),
               lambda peak: peak + F.log(total(F.transform(as_double(scores), lambda x: F.exp(x - peak)))))


def softmax(scores: Column) -> Column:
    return let(log_sum_exp(scores), lambda z: F.transform(as_double(scores), lambda x: F.exp(x - z)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def is_finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
