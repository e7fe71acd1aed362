"""Operators that treat small groups apart: same results on both ways, and little that moves."""
from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from rasterloom.operators import geometry as G, masks as K
from tests.test_iterative import greedy

BOXES = "box_id long, image int, x0 int, y0 int, x1 int, y1 int, score double"


def _boxes():
    rng = np.random.default_rng(8)
    out = []
    for i in range(240):                                        # images 0 to 3 of 12, 36, 72 and 120 boxes
        x, y, w, h = (int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(5, 40, 2)))
        out.append((i, 0 if i < 12 else 1 if i < 48 else 2 if i < 120 else 3, x, y, x + w, y + h, float(rng.integers(0, 30))))
    return out + [(300 + i, 0, 10, 10, 30, 30, 7.0) for i in range(5)] + [(400, 2, 5, 5, 5, 9, 99.0)]


@pytest.mark.parametrize("small", [0, 40, 1000])
def test_nms_is_the_same_whatever_counts_as_small(spark, small):
    boxes = _boxes()
    df = spark.createDataFrame(boxes, BOXES)
    assert {r["box_id"] for r in K.nms(df, 0.3, small=small).collect()} == greedy(boxes, 0.3)


def test_boxes_of_small_images_meet_no_cells(spark, monkeypatch):
    def none(*_):
        raise AssertionError("boxes were copied to cells")
    monkeypatch.setattr(K, "_cells", none)
    boxes = _boxes()
    df = spark.createDataFrame([*boxes, (500, None, 1, 1, 9, 9, 1.0), (501, 3, None, 1, 9, 9, 1.0)], BOXES)
    assert {r["box_id"] for r in K.nms(df, 0.5).collect()} == greedy(boxes, 0.5)


def test_nms_of_no_boxes(spark):
    assert K.nms(spark.createDataFrame([], BOXES), 0.5).count() == 0


def _crops(rows, size, ratio, seed, tries, ignore):
    """Brute force: (sample_id, y, x, gt) of the first try whose largest class stays below ``ratio``, else of the last."""
    out = set()
    for s, h, w in {r[:3] for r in rows}:
        own, bh, bw = [r for r in rows if r[0] == s], min(h, size), min(w, size)
        for t in range(tries):
            oy, ox = (int(hashlib.md5(f"{seed}:{s}:{t}:{a}".encode()).hexdigest()[:8], 16) % (d - n + 1) for a, d, n in (("y", h, bh), ("x", w, bw)))
            box = [(s, r[3] - oy, r[4] - ox, r[5]) for r in own if oy <= r[3] < oy + bh and ox <= r[4] < ox + bw]
            n = Counter(r[3] for r in box if r[3] not in (ignore, None))
            if len(n) > 1 and max(n.values()) / sum(n.values()) < ratio:
                break
        out.update(box)
    return out


def test_random_crop_moves_a_pixel_once(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, h, w in ((1, 9, 12), (2, 4, 30), (3, 20, 5), (4, 8, 8), (5, 16, 16), (6, 3, 3)):
        for y in range(h):
            for x in range(w):
                v = 100 if s == 4 else 100 if s == 5 and (y, x) != (15, 15) else None if (y * x) % 7 == 6 else int(rng.integers(0, 4)) if s != 1 else y // 3
                rows.append((s, h, w, y, x, v))                   # sample 4 has ignored pixels only, sample 5 all but one
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "sample_id long, h int, w int, y int, x int, gt tinyint").repartition(3)
    got = G.random_crop(df, 6, 0.45, "gt", seed=3, ignore=100)
    assert {(r["sample_id"], r["y"], r["x"], r["gt"]) for r in got.collect()} == _crops(rows, 6, 0.45, 3, 10, 100)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # the counts and the pixels are shuffled by sample; no copies for tries or cells
    assert plan.count("Exchange hashpartitioning") <= 3
