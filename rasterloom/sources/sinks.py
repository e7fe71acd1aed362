"""Sinks: predictions, depth, split lists, manifests, reports and result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import finite_or_null, scale_to_uint16, stem
from ..operators.labels import recode
from ..operators.ordering import with_one


def prediction_rows(df: DataFrame, path: str = "img_path", mask: str = "pred", reduced: bool = False) -> DataFrame:
    """One mask per sample named after its image; ids move up by one when the zero label was reduced."""
    shifted = F.col(mask) + 1 if reduced else F.col(mask)
    if dict(df.dtypes)[mask].startswith("array"):
        shifted = F.transform(mask, lambda v: v + 1) if reduced else F.col(mask)
    return df.withColumn(mask, shifted).withColumn("name", F.concat(stem(F.col(path)), F.lit(".png")))


def write_predictions(df: DataFrame, path: str, reduced: bool = False, by: Sequence[str] = ("split",), **kw) -> None:
    prediction_rows(df, reduced=reduced, **kw).write.mode("overwrite").partitionBy(*by).parquet(path)


def depth_rows(df: DataFrame, depth: str = "depth", scale: float = 1000.0) -> DataFrame:
    return df.withColumn(depth, scale_to_uint16(F.col(depth), scale))


def write_depth(df: DataFrame, path: str, scale: float = 1000.0, depth: str = "depth") -> None:
    depth_rows(df, depth, scale).write.mode("overwrite").parquet(path)


def to_raw_ids(df: DataFrame, table: DataFrame, label: str, default: int | None = None) -> DataFrame:
    """Train id -> raw id before export; ``table`` has (raw_id, train_id)."""
    inverse = table.select(F.col("train_id").alias("old_id"), F.col("raw_id").alias("new_id"))
    return recode(df, inverse, label, default)


def write_split_lists(df: DataFrame, path: str, stem_col: str = "stem", split: str = "split") -> None:
    """One stem per line below ``split=<name>/``."""
    df.select(split, F.col(stem_col).alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def manifest_lines(df: DataFrame) -> DataFrame:
    """One JSON object per sample."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_manifest(df: DataFrame, path: str) -> None:
    manifest_lines(df).write.mode("overwrite").text(path)


def merge_manifests(dfs: Sequence[DataFrame], order: str = "source_index") -> DataFrame:
    """Shard manifests as one, in source order."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.orderBy(order)


def write_details(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row with sorted keys; NaN and infinities become null."""
    def safe(name: str, kind: str) -> Column:
        return (finite_or_null(F.col(name)) if kind in ("double", "float") else F.col(name)).alias(name)
    cols = [safe(n, t) for n, t in sorted(df.dtypes)]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("report"))


def append_results(df: DataFrame, path: str, schema: str) -> None:
    """Append typed rows; the format follows the extension (.csv, .json or Parquet)."""
    columns = [c.strip().split(" ", 1) for c in schema.split(",")]
    typed = df.select(*[F.col(n).cast(t).alias(n) for n, t in columns]).write.mode("append")
    if path.endswith(".csv"):
        typed.option("header", "true").csv(path)
    elif path.endswith((".json", ".jsonl")):
        typed.json(path)
    else:
        typed.parquet(path)


def stack_results(runs: dict[str, DataFrame]) -> DataFrame:
    """Result tables of several runs below each other, with the run name."""
    out = None
    for name, d in runs.items():
        d = d.withColumn("run", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def pack_bundle(manifest: DataFrame, vectors: DataFrame, labels: DataFrame, allow_unlabeled: bool = False,
                key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Bundle rows (manifest with vector and label) and its violations."""
    joined = manifest.join(vectors.select(key, "embedding"), key, "left").join(labels.select(key, "label"), key, "left")
    dup = manifest.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("duplicate_id").alias("rule"))
    none = joined.filter(F.col("embedding").isNull()).select(key, F.lit("no_vector").alias("rule"))
    facts = joined.agg(F.min(F.size("embedding")).alias("_d"), F.count("label").alias("_l"))
    shape = with_one(joined, facts).filter(F.size("embedding") != F.col("_d")).select(key, F.lit("shape_drift").alias("rule"))
    bad = dup.unionByName(none).unionByName(shape)
    unl = with_one(joined, facts).filter(F.col("label").isNull())
    unl = unl if not allow_unlabeled else unl.filter(F.col("_l") > 0)
    return joined, bad.unionByName(unl.select(key, F.when(F.col("_l") > 0, "mixed_labels").otherwise("no_label").alias("rule")))
