"""Manifests: file listings, split lists, JSON and CSV annotations as DataFrames.

``scan_*`` and ``read_*`` open files; the functions below them work on path or text tables, so the
same rules run on any table that holds paths or JSON documents.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import rank_rows


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """Paths below a folder; file contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*{suffix}").load(folder).select("path"))


def _key(path: str, root: str | None, suffix: str) -> Column:
    c = F.col(path)
    if root:
        c = F.regexp_replace(c, f"^.*{_quote(root.rstrip('/'))}/", "")
    return F.regexp_replace(c, f"{_quote(suffix)}$", "")


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def pair_paths(images: DataFrame, masks: DataFrame, img_suffix: str, seg_suffix: str, img_root: str | None = None,
               ann_root: str | None = None) -> DataFrame:
    """Image paths with the mask path of the same relative stem (NULL without one), sorted by path."""
    left = images.filter(F.col("path").endswith(img_suffix)).select(F.col("path").alias("img_path"), _key("path", img_root, img_suffix).alias("stem"))
    right = masks.filter(F.col("path").endswith(seg_suffix)).select(F.col("path").alias("seg_map_path"), _key("path", ann_root, seg_suffix).alias("stem"))
    return left.join(right, "stem", "left").orderBy("img_path")


def scan_pairs(spark: SparkSession, img_dir: str, ann_dir: str, img_suffix: str = ".jpg", seg_suffix: str = ".png") -> DataFrame:
    return pair_paths(list_files(spark, img_dir, img_suffix), list_files(spark, ann_dir, seg_suffix), img_suffix, seg_suffix, img_dir, ann_dir)


def split_paths(lines: DataFrame, img_dir: str, ann_dir: str, img_suffix: str, seg_suffix: str, text: str = "value") -> DataFrame:
    """One stem per line -> image and mask path; blank lines are dropped, other columns stay."""
    s = F.trim(text)
    return lines.filter(s != "").withColumn("img_path", F.concat(F.lit(f"{img_dir}/"), s, F.lit(img_suffix))).withColumn(
        "seg_map_path", F.concat(F.lit(f"{ann_dir}/"), s, F.lit(seg_suffix))).drop(text)


def scan_split(spark: SparkSession, ann_file: str, img_dir: str, ann_dir: str, img_suffix: str = ".jpg", seg_suffix: str = ".png") -> DataFrame:
    """Split list in file order (``line_id`` grows along the file)."""
    lines = spark.read.text(ann_file).withColumn("line_id", F.monotonically_increasing_id())
    return split_paths(lines, img_dir, ann_dir, img_suffix, seg_suffix).orderBy("line_id")


def change_paths(lines: DataFrame, dir1: str, dir2: str, ann_dir: str, img_suffix: str, seg_suffix: str, text: str = "value") -> DataFrame:
    """Two images and one mask per name; a name with a dot brings its own suffix, row by row."""
    name = F.trim(text)
    own = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    base = F.when(own.isNotNull(), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    img = F.concat(base, F.coalesce(own, F.lit(img_suffix)))
    return lines.filter(name != "").select(
        *[c for c in lines.columns if c != text], F.concat(F.lit(f"{dir1}/"), img).alias("img_path"),
        F.concat(F.lit(f"{dir2}/"), img).alias("img_path2"), F.concat(F.lit(f"{ann_dir}/"), base, F.lit(seg_suffix)).alias("seg_map_path"))


def scan_change(spark: SparkSession, dir1: str, dir2: str, ann_dir: str, img_suffix: str = ".png", seg_suffix: str = ".png") -> DataFrame:
    """Change pairs by folder: both images and the mask share their relative stem."""
    one = list_files(spark, dir1, img_suffix).select(F.col("path").alias("img_path"), _key("path", dir1, img_suffix).alias("stem"))
    two = list_files(spark, dir2, img_suffix).select(F.col("path").alias("img_path2"), _key("path", dir2, img_suffix).alias("stem"))
    seg = list_files(spark, ann_dir, seg_suffix).select(F.col("path").alias("seg_map_path"), _key("path", ann_dir, seg_suffix).alias("stem"))
    return one.join(two, "stem").join(seg, "stem", "left").orderBy("img_path")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


SAMPLE = ("sample_id string, img_path string, img_paths array<string>, seg_map_path string, valid_mask_path string, "
          "embedding_path string, dataset_name string")


def parse_manifest(df: DataFrame, text: str, root: str, dataset: str = "default", keys: Sequence[str] = ()) -> DataFrame:
    """``{"samples": [...]}`` or a bare list; relative paths get the root, the dataset name a default."""
    wrapped, bare = F.from_json(text, f"samples array<struct<{_struct(SAMPLE)}>>")["samples"], F.from_json(text, f"array<struct<{_struct(SAMPLE)}>>")
    samples = F.when(F.ltrim(text).startswith("["), bare).otherwise(wrapped)

    def full(p):
        return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    rows = df.select(*keys, F.explode(samples).alias("s")).select(*keys, "s.*")
    return rows.select(*keys, "sample_id", full(F.col("img_path")).alias("img_path"), F.transform("img_paths", full).alias("img_paths"),
                       *[full(F.col(c)).alias(c) for c in ("seg_map_path", "valid_mask_path", "embedding_path")], F.coalesce("dataset_name", F.lit(dataset)).alias("dataset"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    return parse_manifest(_texts(spark, path), "value", root)


def parse_decathlon(df: DataFrame, text: str, test: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Training entries are {image, label}, test entries plain paths; a leading "./" is dropped, name and classes are attached."""
    j = F.from_json(text, "name string, modality map<string,string>, labels map<string,string>, training array<struct<image: string, label: string>>, test array<string>")

    def bare(c):
        return F.regexp_replace(c, r"^\./", "")
    base = df.select(*keys, j.alias("j"))
    meta = [F.col("j.name").alias("dataset"), F.map_values("j.labels").alias("classes")]
    if test:
        return base.select(*keys, F.explode("j.test").alias("p"), *meta).select(
            *keys, bare(F.col("p")).alias("img_path"), F.lit(None).cast("string").alias("seg_map_path"), "dataset", "classes")
    return base.select(*keys, F.explode("j.training").alias("s"), *meta).select(
        *keys, bare(F.col("s.image")).alias("img_path"), bare(F.col("s.label")).alias("seg_map_path"), "dataset", "classes")


def read_decathlon(spark: SparkSession, path: str, test: bool = False) -> DataFrame:
    return parse_decathlon(_texts(spark, path), "value", test)


def parse_geojson_folds(df: DataFrame, text: str, folds: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Features -> patch id, fold and the dates of each modality (``dates-<modality>`` maps), chosen folds only.

    Dates may be a list or a map of position to date; maps are read in numeric position order.
    """
    j = F.from_json(text, "features array<struct<properties: map<string,string>>>")["features"]
    p = df.select(*keys, F.explode(j).alias("f")).select(*keys, F.col("f.properties").alias("p"))
    rows = p.select(*keys, F.element_at("p", "ID_PATCH").cast("bigint").alias("patch_id"), F.element_at("p", "Fold").cast("int").alias("fold"),
                    F.explode(F.map_filter("p", lambda k, v: k.startswith("dates-"))).alias("modality", "raw"))
    as_map = F.map_entries(F.from_json("raw", "map<string,string>"))
    ordered = F.transform(F.array_sort(F.transform(as_map, lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("v")))), lambda e: e["v"])
    dates = F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(ordered)
    return rows.filter(F.col("fold").isin(list(folds))).select(*keys, "patch_id", "fold", F.regexp_replace("modality", "^dates-", "").alias("modality"),
                                                               dates.alias("dates"))


def read_geojson_folds(spark: SparkSession, path: str, folds: Sequence[int]) -> DataFrame:
    return parse_geojson_folds(_texts(spark, path), "value", folds)


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def read_labels_csv(spark: SparkSession, path: str, id_col: str, label_col: str) -> DataFrame:
    """Labels by id; a repeated id is an error."""
    df = spark.read.option("header", "true").csv(path).select(id_col, F.col(label_col).cast("int").alias(label_col))
    twice = check_unique(df, id_col).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id {twice[0][0]!r} in {path}")
    return df


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last value per key in line order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def read_last_wins(spark: SparkSession, path: str) -> DataFrame:
    """``patch_id,name`` lines, the last line of an id wins."""
    lines = spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parts = F.split("value", ",", 2)
    return last_wins(lines.select(F.trim(parts[0]).alias("patch_id"), F.trim(parts[1]).alias("name"), "line_id"), "patch_id", "name", "line_id")


def read_embeddings(spark: SparkSession, path: str, strict: bool = True, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Embedding bundle with its contract checked: rows, one vector size, no NULLs, finite entries, integer labels."""
    from ..operators.audits import audit_vectors
    df = spark.read.parquet(path)
    if strict:
        kinds = dict(df.dtypes)
        if not kinds[vec].startswith("array<") or kinds[label] not in ("int", "bigint", "smallint", "tinyint"):
            raise TypeError(f"need a float array and integer labels, got {kinds[vec]} and {kinds[label]}")
        facts = audit_vectors(df, vec, label).first()
        if not facts["rows"] or facts["null_vectors"] or facts["non_finite"] or facts["min_dim"] != facts["max_dim"]:
            raise ValueError(f"embedding bundle {path} breaks its contract: {facts.asDict()}")
    return df


def parse_runlog(lines: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """JSON object per line with varying keys -> (keys, step, key, value); lines that are no object are dropped."""
    m = F.from_json(text, "map<string,string>")
    rows = lines.select(*keys, m.alias("m")).filter(F.col("m").isNotNull())
    return rows.select(*keys, F.try_element_at("m", F.lit("step")).cast("bigint").alias("step"), F.explode("m").alias("key", "raw")).filter(
        F.col("key") != "step").select(*keys, "step", "key", F.col("raw").try_cast("double").alias("value"))


def read_runlog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Long log (file, pos, step, key, value); ``pos`` grows along each file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
                                          F.monotonically_increasing_id().alias("pos"))
    return parse_runlog(lines.drop("_b"), "value", ["file", "pos"])


def scan_model_zoo(spark: SparkSession, glob: str) -> DataFrame:
    """Title, kind and checkpoint URLs of README documents, one row per file."""
    from ..operators.runlog import zoo_entries
    texts = _texts(spark, glob).withColumn("file", F.input_file_name())
    # fixed values: first line, tag comment and download link patterns
    return zoo_entries(texts, "value", r"^([^\n]*)", r"<!--\s*\[([A-Z]*?)\]\s*-->", r"(https?://download.*\.pth)", ["file"])


def explode_targets(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays of one bundle file -> one row per index."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("index", "_z")).select(*rest, "index", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def join_captions(images: DataFrame, annotations: DataFrame, image_id: str = "image_id", caption: str = "caption", order: str = "ann_id") -> DataFrame:
    """All captions of an image in annotation order (a handful per image)."""
    packed = annotations.groupBy(image_id).agg(F.array_sort(F.collect_list(F.struct(order, caption))).alias("_c"))
    return images.join(packed, image_id, "left").withColumn("captions", F.coalesce(F.transform("_c", lambda s: s[caption]), F.array().cast("array<string>"))).drop("_c")


def _parsed(df: DataFrame, text: str, schema: str, needed: str) -> DataFrame:
    """``_j``, the JSON document, and ``error``: malformed, or missing_<needed> where that list is not there."""
    j = df.withColumn("_j", F.from_json(text, f"{schema}, _corrupt_record string"))
    bad = F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
    return j.withColumn("error", F.when(bad, "malformed").when(F.col(f"_j.{needed}").isNull(), f"missing_{needed}"))


def parse_captions(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Caption annotation documents -> (keys, image_id, file_name, captions, error), a row per listed image.

    Captions stand in the order of their ids; an image without any has an empty list, a caption of an unlisted image is left out. A document that
    cannot be read is one row with ``error`` and no image. ``keys`` name a document and must not be NULL.
    """
    keys = list(keys)
    docs = _parsed(df, text, "images array<struct<id: bigint, file_name: string>>, annotations array<struct<id: bigint, image_id: bigint, caption: string>>", "images")
    good = docs.filter("error IS NULL")
    images = good.select(*keys, F.inline("_j.images")).withColumnRenamed("id", "image_id")
    notes = good.select(*keys, F.inline("_j.annotations")).filter("caption IS NOT NULL")
    packed = notes.groupBy(*keys, "image_id").agg(F.array_sort(F.collect_list(F.struct("id", "caption"))).alias("_c"))
    captions = F.coalesce(F.transform("_c", lambda c: c["caption"]), F.array().cast("array<string>")).alias("captions")
    rows = images.join(packed, [*keys, "image_id"], "left").select(*keys, "image_id", "file_name", captions, F.lit(None).cast("string").alias("error"))
    return rows.unionByName(docs.filter("error IS NOT NULL").select(*keys, "error"), allowMissingColumns=True)


def scan_captions(spark: SparkSession, path: str) -> DataFrame:
    """Caption files of a folder or glob on any file system of the cluster, a task reads whole files."""
    return parse_captions(_texts(spark, path).withColumn("file", F.input_file_name()), "value", ["file"])


def scan_sample_lists(spark: SparkSession, path: str, used_labels: Sequence[str] | None = None) -> DataFrame:
    """Sample-list files: rows of ``parse_sample_list`` with ``file`` and ``error``; a file that cannot be read is one row with its error."""
    docs = _parsed(_texts(spark, path).withColumn("file", F.input_file_name()), "value", "samples array<struct<media: struct<image: string>>>", "samples")
    docs = docs.select("file", "value", "error")
    rows = parse_sample_list(docs.filter("error IS NULL"), "value", used_labels, ["file"]).withColumn("error", F.lit(None).cast("string"))
    return rows.unionByName(docs.filter("error IS NOT NULL").select("file", "error"), allowMissingColumns=True)


def parse_sample_list(df: DataFrame, text: str, used_labels: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Sample list with image and label-map locations; ``used_labels`` adds new ids of the kept classes."""
    j = F.from_json(text, "samples array<struct<media: struct<image: string>, label_map: string, classes: array<string>>>")["samples"]
    rows = df.select(*keys, F.explode(j).alias("s")).select(*keys, F.col("s.media.image").alias("img_path"), F.col("s.label_map").alias("seg_map_path"),
                                                            F.col("s.classes").alias("classes"))
    if used_labels is None:
        return rows
    used = F.array(*[F.lit(u) for u in used_labels])
    ids = F.transform("classes", lambda c: F.when(F.array_contains(used, c), F.array_position(used, c) - 1).otherwise(255).cast("int"))
    return rows.withColumn("new_ids", ids)


def class_folders(paths: DataFrame, names: DataFrame, path: str = "path") -> DataFrame:
    """Path -> class index by sorted folder name, with the class name of a (folder, name) table."""
    keyed = paths.withColumn("folder", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    index = rank_rows(keyed.select("folder").distinct(), ["folder"], name="_r").select("folder", (F.col("_r") - 1).cast("int").alias("class_index"))
    return keyed.join(index.join(names, "folder", "left"), "folder")


def scan_class_folders(spark: SparkSession, folder: str, labels_csv: str, suffix: str = ".JPEG") -> DataFrame:
    names = spark.read.csv(labels_csv).toDF("folder", "class_name")
    return class_folders(list_files(spark, folder, suffix), names)


