"""Hand-checked cases and invariants."""
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import geometry as G, labels as L, losses as E, metrics as M, neighbors as N, sampling as SA, tiles as T


def col(df, name):
    return [r[name] for r in df.collect()]


def test_iou_two_classes(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 255], [0, 1, 1, 1, 0])), "gt int, pred int")
    t = {r["class_id"]: r for r in M.per_class(M.total_areas(df, 2)).collect()}
    assert [t[c]["intersect"] for c in (0, 1)] == [1, 2] and [t[c]["pred_area"] for c in (0, 1)] == [1, 3]
    assert t[0]["iou"] == 0.5 and t[1]["iou"] == pytest.approx(2 / 3)
    r = M.seg_metrics(M.total_areas(df, 2)).first()
    assert (r["aacc"], r["m_iou"]) == (75.0, 58.33)


def test_absent_class_is_skipped(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "gt int, pred int")
    assert M.seg_metrics(M.total_areas(df, 2)).first()["m_iou"] == 100.0
    assert M.seg_metrics(M.total_areas(df, 2), nan_to_num=0).first()["m_iou"] == 50.0


def test_prediction_out_of_range_costs_ground_truth_area(spark):
    df = spark.createDataFrame([(0, 255), (0, 0), (1, 7)], "gt int, pred int")
    t = {r["class_id"]: r for r in M.total_areas(df, 2).collect()}
    assert (t[0]["label_area"], t[0]["pred_area"], t[1]["label_area"], t[1]["pred_area"]) == (2, 1, 1, 0)


def test_unknown_metric(spark):
    with pytest.raises(KeyError):
        M.seg_metrics(M.total_areas(spark.createDataFrame([(0, 0)], "gt int, pred int"), 2), ["mWhat"])


def test_zero_label_and_label_map(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 255)], "v int")
    assert col(df.select(S.reduce_zero_label(F.col("v")).alias("r")), "r") == [255, 0, 1, 255]
    old = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, class_id int")
    new = spark.createDataFrame([("c", 0), ("a", 1)], "name string, class_id int")
    assert {r["old_id"]: r["new_id"] for r in L.build_label_map(old, new).collect()} == {0: 1, 1: 255, 2: 0}


def test_label_map_is_simultaneous(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "v int")
    m = spark.createDataFrame([(0, 1), (1, 0)], "old_id int, new_id int")
    assert sorted(col(L.recode(df, m, "v"), "v")) == [0, 1, 5]


def raster(spark, w, h=4):
    return spark.createDataFrame([(1, w, h)], "raster_id long, width int, height int")


def starts(df, name="x0"):
    return sorted({r[name] for r in df.collect()})


def test_grids(spark):
    assert starts(T.slide_grid(raster(spark, 10), 4, 3)) == [0, 3, 6]
    assert starts(T.feature_tiles(raster(spark, 11), 4, 1)) == [0, 3, 6, 7]
    g = sorted(T.grid_strict(raster(spark, 10), 4, 3).collect(), key=lambda r: r["x0"])
    assert [r["x0"] for r in g] == [0, 3, 6] and [r["crop_x"] for r in g] == [0, 1, 1] and [r["crop_w"] for r in g] == [4, 3, 3]
    assert T.uncovered(raster(spark, 10), T.slide_grid(raster(spark, 10), 4, 3)).count() == 0
    gap = T.slide_grid(raster(spark, 10), 4, 3).filter("x0 <> 3")
    assert T.uncovered(raster(spark, 10), gap).count() == 1


def test_grid_crops_cover_each_pixel(spark):
    r = spark.range(1, 30).selectExpr("id as raster_id", "cast(20 + id % 13 as int) as width", "cast(20 + id % 7 as int) as height")
    tiles = T.grid_strict(r, 16, 10)
    px = tiles.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("label", F.lit(1))
    done = T.stitch(tiles, px).groupBy("raster_id").count().join(r, "raster_id")
    assert done.filter("count <> width * height").count() == 0 and done.count() == 29


@pytest.mark.parametrize("window,stride", [(16, 10), (12, 12), (18, 5)])
def test_owned_boxes_agree_with_last_writer(spark, window, stride):
    r = spark.range(1, 12).selectExpr("id as raster_id", "cast(18 + id % 13 as int) as width", "cast(18 + id % 7 as int) as height")
    for tiles in (T.grid_strict(r, window, stride), T.grid_centered(r, window, stride)):
        px = tiles.select("raster_id", "tile_no", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("y")).withColumn(
            "x", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("label", F.col("tile_no"))
        a, b = T.stitch(tiles, px), T.stitch(tiles, px, grid=False)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_overlap_errors():
    with pytest.raises(ValueError):
        T.overlap_pixels(32, 32)
    assert T.overlap_pixels(32, 0.25) == 8 and T.overlap_pixels(32, 5.0) == 5


def test_tokens(spark):
    df = spark.createDataFrame([(3,), (4,), (7,)], "p int")
    assert col(df.select(S.token_index(F.col("p"), 8, 2).alias("t")), "t") == [0, 1, 1]


def test_date_sampling(spark):
    df = spark.createDataFrame([("s", d) for d in range(5)] + [("t", 0), ("t", 1)], "s string, d int")
    got = {(r["s"], r["slot"]): r["d"] for r in SA.sample_dates_chunks(df, "s", "d", 2).collect()}
    assert (got[("s", 0)], got[("s", 1)]) == (1, 4)
    lin = {(r["s"], r["slot"]): r["d"] for r in SA.sample_dates_linspace(df, "s", "d", 4).collect()}
    assert [lin[("t", j)] for j in range(4)] == [0, 1, 1, 1]


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, 3, 0, x, v) for x, v in enumerate((0, 0, 1))], "sample_id long, h int, w int, y int, x int, gt int")
    assert col(G.edge_map(df, "gt", width=1), "x") == [1]
    assert sorted(col(G.edge_map(df, "gt", width=3), "x")) == [0, 1, 2]


def test_average_precision_and_first_rank(spark):
    top = spark.createDataFrame([(1, 0, 10, 0, 0.9, 1), (1, 0, 11, 1, 0.8, 2), (1, 0, 12, 0, 0.7, 3)], "q_id long, q_label int, g_id long, g_label int, sim double, rank int")
    facts = spark.createDataFrame([(1, 2, 1)], "q_id long, relevant long, first_rank long")
    assert N.retrieval_details(top, facts, 10, (3,)).first()["ap_at_3"] == pytest.approx((1 + 2 / 3) / 2)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_first_positive_rank_counts_strictly_better(spark):
    q = vectors(spark, [(0, [1.0, 0.0], 1)])
    g = vectors(spark, [(1, [0.9, 0.1], 0), (2, [0.8, 0.3], 1), (3, [0.8, 0.3], 0)])
    r = N.positive_facts(q, g).first()
    assert (r["relevant"], r["first_rank"]) == (1, 2)
    none = N.positive_facts(vectors(spark, [(0, [1.0, 0.0], 5)]), g).first()
    assert (none["relevant"], none["first_rank"]) == (0, None)


def test_split_sizes():
    assert SA.split_sizes(10, [0.33, 0.33, 0.34]) == [3, 3, 4]
    with pytest.raises(ValueError):
        SA.split_sizes(10, [0.6, 0.6])


def test_splits_are_complete_and_disjoint(spark):
    df = spark.range(137).withColumnRenamed("id", "k").withColumn("c", F.col("k") % 5)
    a = SA.split_iid(df, "k", {"train": 0.7, "valid": 0.1, "test": 0.2})
    assert a.count() == 137 and a.select("k").distinct().count() == 137 and a.filter("split is null").count() == 0
    again = SA.split_iid(df, "k", {"train": 0.7, "valid": 0.1, "test": 0.2})
    assert a.exceptAll(again).count() == 0
    nested = SA.fraction_partitions(df, "k", [0.1, 0.5, 1.0])
    assert nested.filter("fraction = 0.1").select("k").subtract(nested.filter("fraction = 0.5").select("k")).count() == 0
    assert SA.balanced_sample(df, "c", "k", 4).groupBy("c").count().filter("count <> 4").count() == 0
    assert SA.few_shot(df, "c", "k", 3, tries=2).groupBy("try", "c").count().filter("count <> 3").count() == 0


def test_big_samples_take_the_sliced_path(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("c", F.when(F.col("k") < 3000, 0).otherwise(1))
    got = {r["c"]: r["count"] for r in SA.balanced_sample(df, "c", "k", 2500).groupBy("c").count().collect()}
    assert got == {0: 2500, 1: 2000}


def pixels(spark):
    return spark.range(3).selectExpr("id as sample_id", "4 as h", "cast(3 + id as int) as w").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("gt", ((F.col("x") * 3 + F.col("y")) % 4).cast("int"))


@pytest.mark.parametrize("direction", ["horizontal", "vertical", "diagonal"])
def test_flip_twice_is_identity(spark, direction):
    px = pixels(spark)
    assert G.flip(G.flip(px, direction), direction).exceptAll(px.select(G.flip(px).columns)).count() == 0


def test_four_turns_are_identity(spark):
    px = pixels(spark)
    turned = px
    for _ in range(4):
        turned = G.rot90(turned, 1)
    assert turned.select(px.columns).exceptAll(px).count() == 0
    assert G.rot90(px, 2).exceptAll(G.rot90(G.rot90(px, 1), 1)).count() == 0


def test_invariants_of_scores(spark):
    px = pixels(spark).withColumn("pred", (F.col("gt") + (F.col("x") % 2)) % 4)
    per = M.per_class(M.total_areas(px, 4))
    assert per.filter("iou > least(precision, recall) + 1e-12").count() == 0
    assert per.agg(F.sum("label_area")).first()[0] == px.count()


def test_lovasz_of_perfect_prediction_is_zero(spark):
    df = spark.createDataFrame([(i, i % 3, [1.0 if c == i % 3 else 0.0 for c in range(3)]) for i in range(9)], "id long, y int, p array<double>")
    assert E.lovasz_softmax(df, "y", "p", ["id"]).first()["loss"] == pytest.approx(0.0)


def test_reduce_loss_rules(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert df.agg(E.reduce_loss(F.col("v")).alias("l")).first()["l"] == 2.0
    with pytest.raises(ValueError):
        E.reduce_loss(F.col("v"), "sum", 3)


def test_silog_case(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 2.0, 2.0), (1, 3.0, 3.5), (1, 4.0, 4.0)], "sample_id long, gt double, pred double")
    import math
    d = math.log(3.0) - math.log(3.5)
    assert E.silog_loss(df, "sample_id").first()["loss"] == pytest.approx((0 + math.sqrt(d * d / 2 - 0.5 * (d / 2) ** 2)) / 2)


def test_palette_with_shared_color_is_refused(spark):
    pal = spark.createDataFrame([(0, 0, 0, 255), (1, 0, 0, 255)], "class_id int, r int, g int, b int")
    with pytest.raises(ValueError):
        L.color_to_class(pal.select("r", "g", "b"), pal)


def test_bad_dates(spark):
    df = spark.createDataFrame([("20240230",), ("490101",), ("500101",), ("abc",)], "d string")
    got = [str(v) if v else None for v in col(df.select(S.parse_day(F.col("d")).alias("x")), "x")]
    assert got == [None, "2049-01-01", "1950-01-01", None]
