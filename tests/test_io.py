"""File readers, sinks and multi-batch streams."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import metrics as M, runlog as LG
from rasterloom.sources import manifests as S, sinks as K
from rasterloom.streaming import jobs as ST


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-io-", dir="/tmp")


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_scan_pairs_and_change(spark, folder):
    for n in ("a/1", "a/2", "b/3"):
        put(folder, f"img/{n}.jpg", "x")
        put(folder, f"img2/{n}.jpg", "x")
    for n in ("a/1", "b/3"):
        put(folder, f"ann/{n}.png", "x")
    got = S.scan_pairs(spark, f"{folder}/img", f"{folder}/ann").collect()
    assert [r["stem"] for r in got] == ["a/1", "a/2", "b/3"] and got[1]["seg_map_path"] is None
    two = S.scan_change(spark, f"{folder}/img", f"{folder}/img2", f"{folder}/ann", ".jpg", ".png").collect()
    assert len(two) == 3 and two[0]["img_path2"].endswith("img2/a/1.jpg")


def test_scan_split(spark, folder):
    path = put(folder, "train.txt", "z1\n\n a2 \nm3\n")
    assert [r["img_path"] for r in S.scan_split(spark, path, "i", "s").collect()] == ["i/z1.jpg", "i/a2.jpg", "i/m3.jpg"]


def test_json_sources(spark, folder):
    put(folder, "m.json", json.dumps({"samples": [{"sample_id": "a", "img_path": "x.tif", "seg_map_path": "/m.tif"}]}))
    r = S.read_manifest(spark, f"{folder}/m.json", "/root/d").first()
    assert (r["img_path"], r["seg_map_path"], r["dataset"]) == ("/root/d/x.tif", "/m.tif", "default")
    put(folder, "d.json", json.dumps({"name": "n", "training": [{"image": "./i/1", "label": "./l/1"}], "test": ["./t/1", "./t/2"]}))
    assert S.read_decathlon(spark, f"{folder}/d.json").first()["seg_map_path"] == "l/1"
    assert S.read_decathlon(spark, f"{folder}/d.json", test=True).count() == 2
    put(folder, "g.json", json.dumps({"features": [{"properties": {"ID_PATCH": 5, "Fold": f, "dates-S2": {"10": "b", "2": "a"}}} for f in (1, 2)]}))
    g = S.read_geojson_folds(spark, f"{folder}/g.json", [2]).collect()
    assert len(g) == 1 and g[0]["dates"] == ["a", "b"]


def test_csv_and_last_wins(spark, folder):
    put(folder, "l.csv", "id,label\na,1\nb,2\n")
    assert S.read_labels_csv(spark, f"{folder}/l.csv", "id", "label").count() == 2
    put(folder, "dup.csv", "id,label\na,1\na,2\n")
    with pytest.raises(ValueError):
        S.read_labels_csv(spark, f"{folder}/dup.csv", "id", "label")
    put(folder, "p.txt", "1,x\n2,y\n1,z\n")
    assert {r["patch_id"]: r["name"] for r in S.read_last_wins(spark, f"{folder}/p.txt").collect()} == {"1": "z", "2": "y"}


def test_read_embeddings(spark, folder):
    ok = spark.createDataFrame([([1.0, 2.0], 1), ([0.5, 0.1], 0)], "embedding array<float>, label int")
    ok.write.parquet(f"{folder}/ok")
    assert S.read_embeddings(spark, f"{folder}/ok").count() == 2
    ok.withColumn("embedding", F.when(F.col("label") == 0, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))).write.parquet(f"{folder}/bad")
    with pytest.raises(ValueError):
        S.read_embeddings(spark, f"{folder}/bad")
    ok.withColumn("label", F.col("label").cast("double")).write.parquet(f"{folder}/type")
    with pytest.raises(TypeError):
        S.read_embeddings(spark, f"{folder}/type")


def test_runlog_resets_per_file(spark, folder):
    put(folder, "log/a.json", '{"step": 10, "loss": 1.5}\n{"loss": 1.2}\nnot json\n{"step": 0, "mIoU": 50}\n{"step": 20, "loss": 1}\n{"loss": 0.5}\n')
    put(folder, "log/b.json", '{"loss": 9}\n')
    log = S.read_runlog(spark, f"{folder}/log")
    filled = LG.fill_steps(log, "file", "pos").collect()
    a = [r["step"] for r in sorted((r for r in filled if r["file"].endswith("a.json")), key=lambda r: r["pos"])]
    assert a == [10, 10, 10, 20, 20] and [r["step"] for r in filled if r["file"].endswith("b.json")] == [0]


def test_zoo_and_class_folders(spark, folder):
    put(folder, "c/x/README.md", "# Fancy Net\n<!-- [ALGORITHM] -->\n[m](https://download.h/x_A.pth)\n[m](https://download.h/x_a.pth)\n[m](https://download.h/x_b.pth)\n")
    put(folder, "c/y/README.md", "# Empty\n<!-- [OTHERS] -->\n")
    zoo = S.scan_model_zoo(spark, f"{folder}/c/*/README.md").collect()
    assert len(zoo) == 1
    r = zoo[0]
    assert (r["title"], r["kind"], len(r["urls"])) == ("Fancy Net", "ALGORITHM", 2)
    for n in ("n2/a", "n1/b", "n1/c"):
        put(folder, f"t/{n}.JPEG", "x")
    put(folder, "labels.csv", "n1,cat\nn2,dog\n")
    got = {r["folder"]: (r["class_index"], r["class_name"]) for r in S.scan_class_folders(spark, f"{folder}/t", f"{folder}/labels.csv").collect()}
    assert got == {"n1": (0, "cat"), "n2": (1, "dog")}


def test_report_hides_nan(spark):
    df = spark.createDataFrame([(float("nan"), 2, "x")], "z double, b int, a string")
    assert json.loads(K.report_json(df).first()["report"]) == {"a": "x", "b": 2, "z": None}


def test_append_results_formats(spark, folder):
    df = spark.createDataFrame([("r", 1)], "run string, n int")
    for ext in ("csv", "json", "parquet"):
        for _ in range(2):
            K.append_results(df, f"{folder}/o.{ext}", "run string, n bigint")
        reader = spark.read.schema("run string, n bigint").option("header", "true") if ext == "csv" else spark.read.schema("run string, n bigint")
        assert getattr(reader, ext)(f"{folder}/o.{ext}").count() == 2


def pairs(spark, folder, newest_first=False):
    df = spark.range(4000).selectExpr("id", "cast(id % 4 as int) as gt", "cast((id * 7 + id div 9) % 4 as int) as pred", "timestamp_seconds(1700000000 + id * 60) as ts",
                                      "cast(id % 13 as double) as value", "id % 6 as file", "case when id % 5 = 0 then id else null end as step", "'loss' as key")
    for i in reversed(range(4)) if newest_first else range(4):
        df.filter(F.floor(F.col("id") / 1000) == i).coalesce(1).write.parquet(f"{folder}/in/{3 - i if newest_first else i}")
    return df, ST.file_stream(spark, f"{folder}/in/*", df.schema, files_per_batch=1)


def test_stream_metrics_equal_batch(spark, folder):
    df, stream = pairs(spark, folder)
    got = {r["class_id"]: tuple(r) for r in ST.stream_seg_metrics(stream, 4).collect()}
    assert got == {r["class_id"]: tuple(r) for r in M.total_areas(df, 4).collect()}


@pytest.mark.parametrize("newest_first", [False, True])
def test_stream_windows_equal_batch(spark, folder, newest_first):
    df, stream = pairs(spark, folder, newest_first)
    got = ST.stream_windowed_metrics(stream, "ts", "6 hours", "1 hour", "value")
    assert (got.agg(F.sum("n_late")).first()[0] > 0) == newest_first
    assert sorted(map(tuple, got.drop("n_late").collect())) == sorted(map(tuple, ST.windowed_metrics(df, "ts", "6 hours", "value").collect()))


@pytest.mark.parametrize("newest_first", [False, True])
def test_stream_fill_equals_batch(spark, folder, newest_first):
    df, stream = pairs(spark, folder, newest_first)
    got = {(r["file"], r["pos"]): r["step"] for r in ST.stream_fill_steps(stream, "file", "id").collect()}
    want = {(r["file"], r["id"]): r["step"] for r in LG.fill_steps(df, "file", "id").collect()}
    assert got == want


def test_stream_score(spark, folder):
    df, stream = pairs(spark, folder)

    def make():
        return lambda pdf: pdf[["id"]].assign(score=pdf["value"] + 1)
    ST.stream_score(stream.select("id", "value"), make, "id bigint, score double", f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out/rows").count() == 4000
