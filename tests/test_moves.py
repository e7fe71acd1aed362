"""Pixels stay where they are made: shuffles of plans, and results of the forms without a join."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import bands as B, geometry as G, neighbors as N, ordering as O, scoring, tiles as T
from rasterloom.plans import reports as P


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def make():
    """One row per pixel of a tile, tiles in reverse order."""
    def fn(pdf):
        import pandas as pd
        rows = [(r.raster_id, r.tile_no, y, x, r.tile_no * 1000 + y * 30 + x) for r in list(pdf.itertuples())[::-1] for y in range(r.h) for x in range(r.w)]
        return pd.DataFrame(rows, columns=["raster_id", "tile_no", "y", "x", "label"])
    return fn


@pytest.fixture(scope="module")
def rasters(spark):
    return spark.range(1, 12).selectExpr("id as raster_id", "cast(18 + id % 13 as int) as width", "cast(18 + id % 7 as int) as height")


def test_inferred_pixels_do_not_move(spark, rasters):
    schema = "raster_id bigint, tile_no int, y int, x int, label int"
    got = P.infer_raster(rasters, make, schema, 16, 10)
    tiles = T.grid_strict(rasters, 16, 10)
    want = T.stitch(tiles, scoring.score(tiles, make, schema), grid=False)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = physical(got)
    assert "Join" not in plan and "Exchange" not in plan.split("MapInPandas")[0] and "MapInPandas" in plan


def test_blended_pixels_move_once(spark, rasters):
    schema = "raster_id bigint, tile_no int, y int, x int, class_id int, value double"

    def model():
        fn = make()
        return lambda pdf: fn(pdf).assign(class_id=0, value=lambda d: d["label"] * 1.0).drop(columns="label")
    got = P.extract_tiled(rasters, model, schema, 16, 6)
    tiles = T.feature_tiles(rasters, 16, 6)
    want = T.blend_tiles(T.tile_overlaps(tiles), scoring.score(tiles, model, schema))
    six = lambda d: d.withColumn("value", F.round("value", 6))
    assert six(got).exceptAll(six(want)).count() == 0 and got.count() == want.count()
    plan = physical(got)
    assert "Join" not in plan and plan.split("MapInPandas")[0].count("Exchange") == 1


def test_overlaps_of_a_grid(spark):
    r = spark.range(1, 60).selectExpr("id as raster_id", "cast(id + id % 13 as int) as width", "cast(60 - id as int) as height")
    for tile, overlap in ((16, 6), (8, 0), (9, 8)):
        got = T.feature_overlaps(r, tile, overlap)
        want = T.tile_overlaps(T.feature_tiles(r, tile, overlap)).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("center", [(11, 9), (0, 20), (24, 3), (30, 9)])
def test_mosaic(spark, center):
    """Against brute force: parts beyond the canvas, an unknown and a missing partner, a sample that lacks a pixel."""
    sizes, scale = {1: (9, 14), 2: (30, 8), 3: (5, 5), 4: (12, 12)}, (10, 12)
    rows = [(s, h, w, y, x, s * 1000 + y * 40 + x) for s, (h, w) in sizes.items() for y in range(h) for x in range(w) if (s, y, x) != (3, 0, 0)]
    df = spark.createDataFrame(rows, "sample_id long, h int, w int, y int, x int, gt int").repartition(3)
    pairs = [(s, k, (s * 3 + k) % 6) for s in sizes for k in (1, 2, 3) if (s, k) != (2, 3)]
    got = G.mosaic(df, spark.createDataFrame(pairs, "sample_id long, slot int, partner long"), scale, center, "gt")
    values, want = {(s, y, x): v for s, _, _, y, x, v in rows}, {}
    for s, slot, src in [(s, 0, s) for s in sizes] + pairs:
        for q in [(y, x) for y in range(20) for x in range(24)] if slot == 0 else []:
            want.setdefault((s, *q), 255)
        if src not in sizes:
            continue
        h, w = sizes[src]
        r = min(scale[0] / h, scale[1] / w)
        nh, nw = int(h * r), int(w * r)
        for y in range(nh):
            for x in range(nw):
                at = (s, y + center[1] - (nh if slot < 2 else 0), x + center[0] - (nw if slot in (0, 2) else 0))
                v = values.get((src, y * h // nh, x * w // nw))
                if v is not None and 0 <= at[1] < 20 and 0 <= at[2] < 24:
                    want[at] = v
    got_rows = [tuple(x) for x in got.select("sample_id", "y", "x", "gt").collect()]
    assert sorted(got_rows) == sorted((*k, v) for k, v in want.items())


def test_mosaic_pixels_move_packed(spark):
    df = spark.range(3).selectExpr("id as sample_id", "4 as h", "4 as w", "1 as y", "1 as x", "7 as gt")
    plan = physical(G.mosaic(df, df.selectExpr("sample_id", "1 as slot", "sample_id as partner"), (4, 4), (4, 4), "gt"))
    assert not any("y#" in line for line in plan.splitlines() if "Exchange" in line)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2000, 8))
    v[100:140] = v[100]                                          # copies tie
    rows = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(v)]
    return v / np.linalg.norm(v, axis=1, keepdims=True), spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def test_blocks_of_the_shuffle_do_not_grow_with_the_table(spark, vectors):
    side = N._side(vectors[1], "vec_id", "embedding", "label", True)
    few = int(np.ceil(np.sqrt(N.PAIRS_PER_CORE * spark.sparkContext.defaultParallelism)))
    assert [N.shipped_blocks(side, n, 10) for n in (0, 15, 2000, 200_000)] == [1, 2, few, few]
    assert N.shipped_blocks(side, 10 ** 9, 10) == int(np.ceil(10 ** 9 * 9 * 8 / N.SHIP_BYTES))      # bounded in memory


@pytest.mark.parametrize("balls_from", [500, 10 ** 6])
def test_nearest_in_pieces(vectors, balls_from):
    v, df = vectors
    sim = np.round(v @ v.T, 9)
    np.fill_diagonal(sim, -9)
    got = {}
    for r in N.nearest(df, df, 5, exclude_self=True, rows_per_block=40, balls_from=balls_from).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["g_id"]
    for i in range(len(v)):
        assert [got[i][k] for k in range(1, 6)] == list(np.lexsort((np.arange(len(v)), -sim[i]))[:5])


def test_select_bands_moves_a_row_for_each_position(spark):
    rows = [(1, "R", 1.0), (1, "G", 2.0), (1, "B", 3.0), (2, "R", 4.0), (2, "B", 5.0), (3, "G", None), (3, "R", 6.0), (4, "unused", 7.0), (5, "B", 8.0)]
    df = spark.createDataFrame(rows, "y int, band string, value double")
    out = B.select_bands(df, ["B", "G", "N"], {"G": "R", "N": "R"})
    got = {tuple(r) for r in out.select("y", "band_index", "band", "value").collect()}
    assert got == {(1, 0, "B", 3.0), (1, 1, "G", 2.0), (1, 2, "N", 1.0), (2, 0, "B", 5.0), (2, 1, "G", 4.0), (2, 2, "N", 4.0), (3, 1, "G", None), (3, 2, "N", 6.0), (5, 0, "B", 8.0)}
    assert not any("band_index" in line for line in physical(out).splitlines() if "Exchange" in line)


def test_small_slices_do_not_become_as_many_partitions(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr("id", "cast(id * 7919 % 30011 as int) as v", "nullif(id % 3, 0) as g")
    sliced = O.with_slice(df, ["v", "id"], ["g"], rows_per_slice=20)
    assert 1 < sliced.rdd.getNumPartitions() <= O.SLICES
    got = {(r["g"], r["rn"]): r["id"] for r in O.rank_rows(df, ["v", "id"], ["g"], rows_per_slice=20).collect()}
    for g in (0, 1, 2):
        want = sorted((i for i in range(30_000) if i % 3 == g), key=lambda i: (i * 7919 % 30011, i))
        assert [got[g or None, k + 1] for k in range(len(want))] == want


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Tables that are multiplied, and pixels that are sorted, get more partitions as they grow; regions and anchors stay the same."""
    from rasterloom import session
    from rasterloom.operators import labels, masks
    assert session.spread(spark.range(100).coalesce(1), 4).rdd.getNumPartitions() == 25
    df = spark.createDataFrame([(s, y, x, int((x * 7 + y * 5 + s) % 4 < 2)) for s in range(4) for y in range(9) for x in range(11)] + [(None, 1, 1, 1)], "sample_id int, y int, x int, v int")
    def results():
        return [sorted(map(str, d.collect())) for d in (masks.drop_small_regions(df, 6, "holes"), masks.drop_small_regions(df, 6, "islands"), labels.label_anchor(df, ["sample_id", "v"]))]
    few = results()
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    assert session.dealt(df, "sample_id", "y").rdd.getNumPartitions() == 20
    assert results() == few
