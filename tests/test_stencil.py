"""Neighbour differences and edge maps by blocks against brute force, on images larger than a block."""
import numpy as np
import pytest

from rasterloom.operators import geometry as G, joins as J


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(8)
    coarse = rng.integers(0, 3, (12, 20))
    labels = np.kron(coarse, np.ones((12, 8), int))          # 144 x 160: borders fall on and beside block borders
    labels[rng.random(labels.shape) < 0.1] = 255
    return labels


@pytest.fixture(scope="module")
def df(spark, image):
    h, w = image.shape
    rows = [(s, h, w, y, x, int(image[y, x])) for s in ("a", "b") for y in range(h) for x in range(w) if s == "a" or y < 70]
    rows += [(None, h, w, 0, 0, 1), ("a", h, w, None, 1, 1), ("c", 1, 1, 0, 0, None)]
    return spark.createDataFrame(rows, "sample_id string, h int, w int, y int, x int, gt int").repartition(6)


def brute(image, offsets):
    h, w = image.shape
    return {(y, x, dy, dx, int(image[y, x]), int(image[y + dy, x + dx])) for y in range(h) for x in range(w) for dy, dx in offsets
            if 0 <= y + dy < h and 0 <= x + dx < w and 255 not in (image[y, x], image[y + dy, x + dx]) and image[y, x] != image[y + dy, x + dx]}


@pytest.mark.parametrize("offsets", [((1, 0), (0, 1)), ((-1, 0), (0, 1), (1, 1), (1, -1)), ((-3, 70),)])
def test_neighbour_diff(df, image, offsets):
    got = J.neighbour_diff(df, "sample_id", "gt", offsets, ignore=255, carry=["h"]).collect()
    for s, part in (("a", image), ("b", image[:70])):
        mine = [tuple(r)[2:] for r in got if r["sample_id"] == s]
        assert len(mine) == len(set(mine)) and set(mine) == brute(part, offsets)
    assert {r["h"] for r in got} == {144} and {r["sample_id"] for r in got} == {"a", "b"}


def test_repeated_and_negative_positions(spark):
    rows = [(1, -1, 0, "p"), (1, 0, 0, "q"), (1, 0, 0, "r"), (1, -64, 5, "p"), (1, -65, 5, "s")]
    d = spark.createDataFrame(rows, "sample_id long, y int, x int, v string")
    got = sorted((r["y"], r["x"], r["v0"], r["v"]) for r in J.neighbour_diff(d, "sample_id", "v", ((1, 0),)).collect())
    assert got == [(-65, 5, "s", "p"), (-1, 0, "p", "q"), (-1, 0, "p", "r")]
    assert J.neighbour_diff(d.filter("false"), "sample_id", "v").count() == 0


@pytest.mark.parametrize("width", [1, 3, 4, 9])
def test_edge_map(df, image, width):
    marks = {m[:2] for m in brute(image, G.EDGE_NEIGHBOURS)}
    lo, hi = width // 2 - (width - 1), width // 2
    h, w = image.shape
    want = {(y + dy, x + dx) for y, x in marks for dy in range(lo, hi + 1) for dx in range(lo, hi + 1) if 0 <= y + dy < h and 0 <= x + dx < w}
    got = [(r["y"], r["x"]) for r in G.edge_map(df.filter("sample_id = 'a'"), "gt", width).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_one_shuffle(df):
    plan = G.edge_map(df, "gt")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("dense", [64, 0])
def test_positions_by_table_and_by_search(monkeypatch, dense):
    """A table of positions, the search and repeated positions give the neighbours and the grown marks of brute force."""
    import numpy as np
    import pyarrow as pa
    from rasterloom.operators import stencil
    monkeypatch.setattr(stencil, "DENSE", dense)
    rng = np.random.default_rng(5)
    for repeats in (0, 5):
        cells = rng.permutation(2 * 128)[:150]
        cells = np.concatenate([cells, cells[:repeats]])
        cells = cells[np.argsort(cells // 128, kind="stable")]
        b, y, x, v = cells // 128, cells % 128 // 16 + 64, cells % 16 + 128, rng.integers(0, 3, len(cells))
        t = pa.table({"_block": b, "_yb": np.ones(len(b), int), "_xb": np.full(len(b), 2), "y": y, "x": x, "v": v})
        got = sorted(zip(*(a.tolist() for a in stencil.differing(t, "v", [(0, 1), (-1, 0)], 64))))
        assert got == sorted((i, j, k) for k, (dy, dx) in enumerate([(0, 1), (-1, 0)]) for i in range(len(b)) for j in range(len(b))
                             if b[i] == b[j] and y[j] == y[i] + dy and x[j] == x[i] + dx and v[i] != v[j])
        want = sorted({(k, p + dy, q + dx) for k, p, q in zip(b.tolist(), y.tolist(), x.tolist()) for dy in (-1, 0, 1) for dx in (-1, 0, 1)})
        assert list(zip(*stencil.dilated(b, y, x, -1, 1).tolist())) == want
    assert stencil.dilated(b[:0], y[:0], x[:0], -1, 1).shape == (3, 0)
