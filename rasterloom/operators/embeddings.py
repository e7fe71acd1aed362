"""Vector tables: pooling, prompts, linear scoring."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import as_double, argmax, dot, l2_normalize, sigmoid, softmax
from ..session import cut_lineage
from .neighbors import block_pairs
from .ordering import with_one

FOLD_ROWS = 1000        # class rows that may travel as one array value


def vector_mean(df: DataFrame, by: Sequence[str], vec: str, name: str = "vec", normalize: bool = False) -> DataFrame:
    """Mean vector per group: partial sums per (group, dimension), then one short list per group."""
    v = l2_normalize(F.col(vec)) if normalize else as_double(F.col(vec))
    long = df.select(*by, F.posexplode(v).alias("_d", "_v"))
    means = long.groupBy(*by, "_d").agg(F.avg("_v").alias("_v"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_p"))
    return packed.select(*by, F.transform("_p", lambda p: p["_v"]).alias(name))


def mean_pool(df: DataFrame, sample: str, vec: str = "embedding") -> DataFrame:
    """Spatial mean of dense embeddings."""
    return vector_mean(df, [sample], vec, vec)


def class_means(df: DataFrame, label: str, vec: str, name: str = "weight") -> DataFrame:
    return vector_mean(df, [label], vec, name)


def prompts(templates: Sequence[str], classes: DataFrame) -> DataFrame:
    """Every template filled with every class name."""
    t = F.posexplode(F.array(*[F.lit(x) for x in templates])).alias("template_id", "template")
    return classes.select("class_id", "name", t).select(
        "class_id", "template_id", F.replace("template", F.lit("{}"), F.col("name")).alias("prompt"))


def ensemble_prompts(df: DataFrame, cls: str, vec: str) -> DataFrame:
    """Mean of unit vectors per class, normalised again."""
    m = vector_mean(df, [cls], vec, "vec", normalize=True)
    return m.withColumn("vec", l2_normalize(F.col("vec")))


def decode_scores(df: DataFrame, scores: str, pred: str = "pred", prob: str | None = None, threshold: float | None = None) -> DataFrame:
    """Several classes: argmax and softmax probability; one class (``threshold``): sigmoid above it."""
    if threshold is not None:
        return df.withColumn(pred, (sigmoid(F.col(scores)[0]) > threshold).cast("int"))
    out = df.withColumn(pred, argmax(F.col(scores)))
    return out if prob is None else out.withColumn(prob, F.array_max(softmax(F.col(scores))))


def linear_predict(df: DataFrame, weights: DataFrame, vec: str, cls: str, key: str | None = None) -> DataFrame:
    """Best class of every vector under class rows (class, weight, bias): adds pred and score.

    Few classes are folded into one value, so the big side is read once and never shuffled. Beyond
    ``FOLD_ROWS`` classes the scores come from block products, by ``key``, a unique row id, or numbers given here.
    """
    if weights.limit(FOLD_ROWS + 1).count() <= FOLD_ROWS:
        row = F.struct(F.col(cls).alias("c"), F.col("weight").alias("w"), F.col("bias").alias("b"))
        both = with_one(df, weights.agg(F.array_sort(F.collect_list(row)).alias("_w")))
        scored = F.transform("_w", lambda r: F.struct((dot(F.col(vec), r["w"]) + r["b"]).alias("s"), (-r["c"]).alias("n")))
        return both.withColumn("_best", F.array_max(scored)).select(
            *df.columns, (-F.col("_best.n")).alias("pred"), F.col("_best.s").alias("score"))
    columns = df.columns
    if key is None:
        key, df = "__row", cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))

    def best(a, b):
        import numpy as np
        import pandas as pd
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "pred": [], "score": []})
        b = b.sort_values("id")
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T + b["bias"].to_numpy()[None, :]
        top = s.argmax(axis=1)
        return pd.DataFrame({"id": a["id"], "pred": b["id"].to_numpy()[top], "score": s[np.arange(len(a)), top]})

    rows = df.select(F.col(key).cast("bigint").alias("id"), as_double(F.col(vec)).alias("v"))
    table = weights.select(F.col(cls).cast("bigint").alias("id"), as_double(F.col("weight")).alias("v"), "bias")
    found = block_pairs(rows, table, "id", best, "id bigint, pred bigint, score double")
    top = found.groupBy("id").agg(F.max(F.struct("score", -F.col("pred"))).alias("_t"))
    return df.join(top.withColumnRenamed("id", key), key).select(
        *columns, (-F.col("_t.col2")).cast(weights.schema[cls].dataType).alias("pred"), F.col("_t.score").alias("score"))
