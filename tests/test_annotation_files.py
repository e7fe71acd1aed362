"""Caption and sample-list files, readable and broken ones."""
import json

from rasterloom.sources import manifests as S


def test_caption_files(spark, tmp_path):
    good = {"info": {"year": 1}, "images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
            "annotations": [{"id": 9, "image_id": 1, "caption": "late"}, {"id": 4, "image_id": 1, "caption": "early"}, {"id": 5, "image_id": 7, "caption": "no image"}]}
    files = {"good": json.dumps(good, indent=1), "cut": json.dumps(good)[:60], "bare": "{}", "none": json.dumps({"images": []}), "only": json.dumps({"images": [{"id": 1}]})}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted(((r["file"].split("/")[-1], r["image_id"], r["file_name"], r["captions"], r["error"]) for r in S.scan_captions(spark, f"{tmp_path}/*.json").collect()), key=str)
    assert got == [("bare.json", None, None, None, "missing_images"), ("cut.json", None, None, None, "malformed"), ("good.json", 1, "a.jpg", ["early", "late"], None),
                   ("good.json", 2, "b.jpg", [], None), ("only.json", 1, None, [], None)]


def test_sample_list_files(spark, tmp_path):
    sample = {"media": {"image": "x.jpg"}, "label_map": "x.png", "classes": ["road", "sky"]}
    for name, text in {"good": json.dumps({"samples": [sample]}), "cut": '{"samples": [{"media"', "bare": '{"meta": 1}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["file"].split("/")[-1]: (r["img_path"], r["seg_map_path"], r["new_ids"], r["error"]) for r in S.scan_sample_lists(spark, f"{tmp_path}/*.json", ["sky"]).collect()}
    assert got == {"good.json": ("x.jpg", "x.png", [255, 0], None), "cut.json": (None, None, None, "malformed"), "bare.json": (None, None, None, "missing_samples")}
