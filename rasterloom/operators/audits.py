"""Dataset audits: every function returns its violations as rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import is_finite
from .joins import present
from .sampling import check_disjoint


def audit_labels(df: DataFrame, sample: str, label: str, n: int, ignore: int = 255) -> DataFrame:
    """Samples with labels outside 0..n-1 (ignore is allowed), with the offending values."""
    bad = df.filter(~F.col(label).between(0, n - 1) & (F.col(label) != ignore))
    values = bad.groupBy(sample, label).agg(F.count("*").alias("c"))
    return values.groupBy(sample).agg(F.array_join(F.sort_array(F.collect_list(label)), ",").alias("bad_values"),
                                      F.sum("c").alias("pixels"))


def _rule(df: DataFrame, rule: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def audit_manifest(manifest: DataFrame, files: DataFrame, vectors: DataFrame, expected: dict[str, int], fmt: str,
                   dim: int) -> DataFrame:
    """Format tag, unknown splits, split counts, duplicate ids, missing files, vector size, non-finite vectors.

    ``manifest`` has (sample_id, split, format, path), ``files`` (path), ``vectors`` (sample_id, embedding).
    The report lists every violation; ``count_violations`` adds them up.
    """
    sizes = manifest.groupBy("split").agg(F.count("*").alias("n"))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    parts = [
        _rule(manifest.filter(F.col("format") != fmt), "format", "sample_id", F.col("format")),
        _rule(manifest.filter(~F.col("split").isin(list(expected))), "split", "sample_id", F.col("split")),
        _rule(sizes.filter(F.col("n") != F.try_element_at(want, F.col("split"))), "split_count", "split", F.col("n")),
        _rule(manifest.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_id", "sample_id", F.col("n")),
        _rule(manifest.join(files.select("path").distinct(), "path", "left_anti"), "missing_file", "sample_id", F.col("path")),
        _rule(vectors.filter(F.size("embedding") != dim), "vector_size", "sample_id", F.size("embedding")),
        _rule(vectors.filter(F.exists("embedding", lambda v: ~is_finite(v))), "non_finite", "sample_id", F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_violations(report: DataFrame) -> DataFrame:
    """Violations of each rule and of all rules (NULL), from the rows of an audit."""
    return report.rollup("rule").agg(F.count("*").alias("n"))


def audit_partition(partitions: DataFrame, names: DataFrame, expected_splits: Sequence[str], partition: str = "partition",
                    split: str = "split", name: str = "sample_name") -> DataFrame:
    """Duplicates, overlaps, names without a sample, empty splits."""
    dup = check_disjoint(partitions, partition, split, name)
    gone = present(partitions, names, name, invert=True).select(partition, name, F.lit("not_in_dataset").alias("rule"))
    full = partitions.select(partition).distinct().withColumn("_s", F.explode(F.array(*[F.lit(s) for s in expected_splits])))
    have = partitions.select(partition, F.col(split).alias("_s")).distinct()
    empty = full.join(have, [partition, "_s"], "left_anti").select(partition, F.col("_s").alias(name), F.lit("empty_split").alias("rule"))
    return dup.unionByName(gone).unionByName(empty)


def audit_dataset(bands: DataFrame, order: Sequence[str], patch: int, sample: str = "sample_id", band: str = "band") -> DataFrame:
    """Samples whose band list differs from the given order, or whose largest band is not the patch size.

    ``bands`` has one row per (sample, band) with ``band_index``, ``h`` and ``w``.
    """
    wanted = F.try_element_at(F.array(*[F.lit(b) for b in order]), F.col("band_index") + 1)
    per = bands.groupBy(sample).agg(F.count("*").alias("n_bands"), F.count_if(~F.col(band).eqNullSafe(wanted)).alias("misplaced"),
                                    F.max("h").alias("h"), F.max("w").alias("w"))
    rule = (F.when((F.col("n_bands") != len(order)) | (F.col("misplaced") > 0), "band_order")
             .when((F.col("h") != patch) | (F.col("w") != patch), "patch_size"))
    return per.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(sample, "rule", "n_bands", "misplaced", "h", "w")


def audit_label_type(df: DataFrame, key: str, label: str, kind: str, n: int) -> DataFrame:
    """Classification: id in range. Segmentation: array values in range. Multi-label: n entries of 0/1."""
    c = F.col(label)
    if kind == "classification":
        bad = ~c.between(0, n - 1)
    elif kind == "segmentation":
        bad = F.exists(c, lambda v: ~v.between(0, n - 1))
    elif kind == "multilabel":
        bad = (F.size(c) != n) | F.exists(c, lambda v: ~v.isin(0, 1))
    else:
        raise ValueError(f"unknown label kind {kind}")
    return df.filter(bad | c.isNull()).select(key, F.lit(kind).alias("kind"))


def audit_palette(classes: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Datasets with gaps in the class ids or with one colour for two classes."""
    per = classes.groupBy(dataset).agg(F.count("*").alias("n"), F.max("class_id").alias("top"),
                                       F.count_distinct("class_id").alias("ids"))
    gaps = per.filter((F.col("n") != F.col("ids")) | (F.col("top") + 1 != F.col("n"))).select(
        dataset, F.lit("class_ids").alias("rule"), F.col("n").cast("string").alias("detail"))
    same = classes.groupBy(dataset, "r", "g", "b").agg(F.count("*").alias("n")).filter("n > 1").select(
        dataset, F.lit("shared_color").alias("rule"), F.concat_ws(",", "r", "g", "b").alias("detail"))
    return gaps.unionByName(same)


def audit_series(df: DataFrame, key: str, modality: str, dates: str, steps: str, static: Sequence[str],
                 source_a: str, source_b: str) -> DataFrame:
    """Date count = time steps; static modalities carry no dates; exactly one source is set."""
    is_static = F.col(modality).isin(list(static))
    n = F.coalesce(F.size(dates), F.lit(0))
    rule = (F.when(F.col(source_a).isNotNull() & F.col(source_b).isNotNull(), "two_sources")
             .when(F.col(source_a).isNull() & F.col(source_b).isNull(), "no_source")
             .when(is_static & (n > 0), "static_with_dates").when(~is_static & (n != F.col(steps)), "date_count"))
    return df.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(key, modality, "rule")


def audit_shapes(df: DataFrame, sample: str, h: str = "h", w: str = "w") -> DataFrame:
    """Samples whose frames differ in size."""
    per = df.groupBy(sample).agg(F.min(h).alias("h0"), F.max(h).alias("h1"), F.min(w).alias("w0"), F.max(w).alias("w1"))
    return per.filter((F.col("h0") != F.col("h1")) | (F.col("w0") != F.col("w1")))


def audit_counts(pred: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    p = pred.select(key).distinct().withColumn("_p", F.lit(True))
    d = data.select(key).distinct().withColumn("_d", F.lit(True))
    return p.join(d, key, "full_outer").filter(F.col("_p").isNull() | F.col("_d").isNull()).select(
        key, F.when(F.col("_p").isNull(), "no_prediction").otherwise("no_sample").alias("rule"))


def audit_vectors(df: DataFrame, vec: str = "embedding", label: str | None = "label") -> DataFrame:
    """One row of bundle facts: rows, NULLs, smallest and largest vector size, non-finite vectors, negative labels."""
    extra = [] if label is None else [F.count_if(F.col(label) < 0).alias("negative_labels")]
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(vec).isNull()).alias("null_vectors"),
                  F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim"),
                  F.count_if(F.exists(vec, lambda v: ~is_finite(v))).alias("non_finite"), *extra)
