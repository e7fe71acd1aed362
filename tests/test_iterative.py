"""Components, suppression, clustering and neighbours against brute force on small fixtures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import clustering as C, embeddings as E, graph, masks as K, neighbors as N
from rasterloom.plans import reports as P


def brute_components(edges, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)] + [(90, 91)],
             "random": [tuple(int(v) for v in rng.integers(0, 120, 2)) for _ in range(70)]}[kind]
    nodes = {n for e in edges for n in e}
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components(edges, nodes)


def greedy(boxes, iou):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[0])):
        def over(k):
            iw, ih = max(min(b[4], k[4]) - max(b[2], k[2]), 0), max(min(b[5], k[5]) - max(b[3], k[3]), 0)
            union = (b[4] - b[2]) * (b[5] - b[3]) + (k[4] - k[2]) * (k[5] - k[3]) - iw * ih
            return iw * ih / union > iou if union else False
        if all(k[1] != b[1] or not over(k) for k in kept):
            kept.append(b)
    return {b[0] for b in kept}


@pytest.mark.parametrize("iou", [0.1, 0.3, 0.5, 0.7])
def test_nms_is_greedy(spark, iou):
    rng = np.random.default_rng(5)
    boxes = []
    for i in range(150):
        x, y, w, h = (int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(5, 40, 2)))
        boxes.append((i, int(i % 3), x, y, x + w, y + h, float(rng.integers(0, 40))))
    boxes += [(200 + i, 0, 10, 10, 30, 30, float(i % 4)) for i in range(60)]       # copies of one box
    boxes += [(400 + i, 2, i, i, 200 + 3 * i, 150 + i, float(i % 7)) for i in range(20)]       # large ones above small ones
    boxes.append((300, 1, 5, 5, 5, 9, 99.0))                                        # empty box
    df = spark.createDataFrame(boxes, "box_id long, image int, x0 int, y0 int, x1 int, y1 int, score double")
    assert {r["box_id"] for r in K.nms(df, iou).collect()} == greedy(boxes, iou)


def grid_mask(spark, rows):
    h, w = len(rows), len(rows[0])
    return spark.createDataFrame([(1, h, w, y, x, int(c)) for y, r in enumerate(rows) for x, c in enumerate(r)], "sample_id long, h int, w int, y int, x int, v int")


def to_rows(df, rows):
    got = {(r["y"], r["x"]): r["v"] for r in df.collect()}
    return ["".join(str(got[y, x]) for x in range(len(rows[0]))) for y in range(len(rows))]


def test_small_regions(spark):
    rows = ["1110000", "1010010", "1110000", "0000110"]
    assert to_rows(K.drop_small_regions(grid_mask(spark, rows), 3, "holes"), rows)[1] == "1110010"
    # the lone pixel touches the two set pixels only across a gap
    assert to_rows(K.drop_small_regions(grid_mask(spark, rows), 3, "islands"), rows) == ["1110000", "1010000", "1110000", "0000000"]
    small = ["100", "000", "011"]
    assert to_rows(K.drop_small_regions(grid_mask(spark, small), 10, "islands"), small) == ["000", "000", "011"]
    kept = K.drop_small_regions(grid_mask(spark, rows), 1, "islands")
    assert kept.filter("changed").count() == 0


def test_regions_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(["0", "1"], 40, p=[0.55, 0.45])) for _ in range(30)]
    want = None
    for cell, block in ((64, 64), (8, 4), (4, 1)):
        runs = K.regions(grid_mask(spark, rows), cell=cell, block=block).collect()
        groups = {}
        for r in runs:
            groups.setdefault(r["component"], set()).add((r["y"], r["x0"], r["x1"]))
        got = sorted(map(sorted, groups.values()))
        want = want or got
        assert got == want and len(got) > 3


def test_regions_cross_cells(spark):
    rows = ["1" * 40, "0" * 39 + "1", "1" * 40]
    assert K.regions(grid_mask(spark, rows), cell=4).select("component").distinct().count() == 1


def test_rle_round_trip_and_leading_zero(spark):
    rows = ["110", "101", "001"]
    enc = K.rle_encode(grid_mask(spark, rows))
    r = enc.first()
    flat = [int(rows[y][x]) for x in range(3) for y in range(3)]
    assert r["counts"][0] == 0 and sum(r["counts"]) == 9
    assert {(p["y"], p["x"]) for p in K.rle_decode(enc).collect()} == {(y, x) for y in range(3) for x in range(3) if rows[y][x] == "1"}
    assert enc.select(K.rle_area(F.col("counts")).alias("a")).first()["a"] == sum(flat)
    empty = K.rle_encode(grid_mask(spark, ["000", "000"])).first()["counts"]
    assert empty == [6]


def unit(rng, n, d=6):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    centers = unit(rng, 4)
    v = np.concatenate([centers[i % 4] + rng.normal(scale=0.12, size=(1, 6)) for i in range(120)] + [unit(rng, 25)])
    v = np.concatenate([v, np.repeat(v[:1], 40, axis=0)])                  # copies of one vector
    rows = [(i, [float(x) for x in r], int(i % 4)) for i, r in enumerate(v)]
    return v / np.linalg.norm(v, axis=1, keepdims=True), spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [30, 5000])
def test_nearest_matches_brute_force(cloud, block):
    v, df = cloud
    sim = np.round(v @ v.T, 9)
    np.fill_diagonal(sim, -9)
    got = {}
    for r in N.nearest(df, df, 7, exclude_self=True, rows_per_block=block).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["g_id"]
    for i in range(len(v)):
        want = sorted(range(len(v)), key=lambda j: (-sim[i, j], j))[:7]
        assert [got[i][k] for k in range(1, 8)] == want


def test_nearest_skips_most_blocks_of_clustered_data(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(unit(rng, 12, 24), 100, axis=0) + rng.normal(scale=0.01, size=(1200, 24))
    v = np.concatenate([v, np.repeat(v[:1], 300, axis=0)])                 # one ball of copies is cut into parts
    unscaled = v * rng.uniform(0.5, 2, size=(len(v), 1))
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(unscaled)], "vec_id long, embedding array<double>, label int").repartition(4)
    for normalize in (True, False):
        w = unscaled / np.linalg.norm(unscaled, axis=1, keepdims=True) if normalize else unscaled
        sim = np.round(w @ w.T, 9)
        np.fill_diagonal(sim, -9)
        got = {}
        for r in N.nearest(df, df, 5, exclude_self=True, normalize=normalize, rows_per_block=32).collect():
            got.setdefault(r["q_id"], {})[r["rank"]] = r["sim"]
        want = -np.sort(-sim, axis=1)[:, :5]
        assert np.allclose([[got[i][k] for k in range(1, 6)] for i in range(len(v))], want, atol=2e-9)
    side = N._side(df, "vec_id", "embedding", "label", True)
    balls = N.Balls(side, side, 38, 10)
    every = balls.queries.select("q_ball", "q_part").distinct().count() * balls.gallery.select("g_ball", "g_part").distinct().count()
    w = v / np.linalg.norm(v, axis=1, keepdims=True)
    edges = spark.createDataFrame([(i, float(x)) for i, x in enumerate(-np.sort(-np.round(w @ w.T, 9), axis=1)[:, 5])], "id long, edge double")
    done = balls.block_pairs(balls.own()).count() + balls.block_pairs(balls.open(edges)).count()
    assert done < 0.4 * every           # 12 % hold a neighbour of the same cluster


def test_nearest_with_few_or_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    some = spark.createDataFrame([(i, [float(i % 7), 1.0], None if i % 3 else 1) for i in range(60)] + [(99, [float("nan"), 1.0], 1)], schema)
    none = some.filter("vec_id < 0")
    for block in (2, 5000):
        assert N.nearest(none, some, 3, rows_per_block=block).count() == 0 and N.nearest(some, none, 3, rows_per_block=block).count() == 0
        got = N.nearest(some, some, 100, rows_per_block=block)             # fewer rows than asked for: all that are comparable
        assert got.groupBy("q_id").count().filter("count <> 60").count() == 0 and got.select("q_id").distinct().count() == 60
        assert got.filter("q_id = 99 OR g_id = 99").count() == 0


def brute_dbscan(v, eps, m):
    near = np.round(v @ v.T, 9) >= 1 - eps - 1e-12
    core = near.sum(axis=1) >= m
    comp = brute_components([(i, j) for i in range(len(v)) for j in range(len(v)) if core[i] and core[j] and near[i, j]], [i for i in range(len(v)) if core[i]])
    out = {}
    for i in range(len(v)):
        if core[i]:
            out[i] = comp[i]
        else:
            out[i] = min((comp[j] for j in range(len(v)) if core[j] and near[i, j]), default=None)
    return out


@pytest.mark.parametrize("block", [25, 5000])
def test_dbscan_matches_brute_force(cloud, block):
    v, df = cloud
    got = {r["vec_id"]: r["component"] for r in C.dbscan(df, 0.05, 5, rows_per_block=block).collect()}
    assert got == brute_dbscan(v, 0.05, 5)
    ids = {r["cluster"] for r in C.cluster_ids(C.dbscan(df, 0.05, 5)).collect()}
    assert ids - {-1} == set(range(len(ids - {-1})))


def test_silhouette_matches_brute_force(cloud):
    v, df = cloud
    y = np.arange(len(v)) % 4
    d = 1 - v @ v.T
    s = []
    for i in range(len(v)):
        a = d[i][(y == y[i]) & (np.arange(len(v)) != i)].mean()
        b = min(d[i][y == c].mean() for c in range(4) if c != y[i])
        s.append((b - a) / max(a, b))
    assert C.silhouette(df, "label", "embedding").first()["silhouette"] == pytest.approx(np.mean(s))


def test_many_clusters_take_blocks(spark, cloud, monkeypatch):
    v, df = cloud
    want = C.silhouette(df, "label", "embedding").first()["silhouette"]
    monkeypatch.setattr(C, "FOLD_ROWS", 2)
    assert C.silhouette(df, "label", "embedding").first()["silhouette"] == pytest.approx(want)
    assert C.silhouette(df, "label", "embedding", "vec_id").first()["silhouette"] == pytest.approx(want)


def test_many_classes_take_blocks(spark, cloud, monkeypatch):
    _, df = cloud
    w = E.class_means(df, "label", "embedding").withColumn("bias", F.col("label") * 0.05)
    want = {r["vec_id"]: r["pred"] for r in E.linear_predict(df, w, "embedding", "label").collect()}
    monkeypatch.setattr(E, "FOLD_ROWS", 2)
    assert {r["vec_id"]: r["pred"] for r in E.linear_predict(df, w, "embedding", "label").collect()} == want
    assert {r["vec_id"]: r["pred"] for r in E.linear_predict(df, w, "embedding", "label", "vec_id").collect()} == want


def test_silhouette_is_null_for_one_cluster(cloud):
    assert C.silhouette(cloud[1].withColumn("label", F.lit(0)), "label", "embedding").first()["silhouette"] is None


def test_assignment_matches_permutations():
    from itertools import permutations
    rng = np.random.default_rng(2)
    for shape in ((4, 4), (3, 5), (5, 2)):
        m = rng.integers(0, 30, shape).astype(float)
        n, k = min(shape), max(shape)
        big = m if shape[0] <= shape[1] else m.T
        best = max(sum(big[i, p[i]] for i in range(n)) for p in permutations(range(k), n))
        assert C.assign_max(m) == best


def test_perfect_clusters(cloud):
    t = C.contingency(cloud[1].withColumn("c", F.col("label") + 10), "label", "c")
    assert C.nmi(t).first()["nmi"] == pytest.approx(1) and C.ari(t).first()["ari"] == pytest.approx(1)
    assert C.purity(t).first()["purity"] == 1 and C.hungarian_accuracy(t).first()["hungarian_accuracy"] == 1


def test_kmeans_restarts_advance_alone(spark, cloud):
    rows = cloud[1].filter("vec_id < 120").select("vec_id", "embedding")
    single = [C.kmeans(rows, 4, n_init=1, seed=7 + i)[1] for i in range(3)]
    together = C.kmeans(rows, 4, n_init=3, seed=7)
    assert np.isclose(together[1], min(single), rtol=1e-9)
    v = np.array([r["embedding"] for r in together[0].collect()])
    c = np.array([r["cluster"] for r in together[0].collect()])
    # a fixed point: every row is nearest to the mean of its own cluster, and the cost is the sum of these distances
    means = np.stack([v[c == i].mean(axis=0) for i in range(4)])
    far = ((v[:, None] - means) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == c).all() and np.isclose(far.min(axis=1).sum(), together[1])


def test_kmeans_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [3.0, 4.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, cost = C.kmeans(d, 3, n_init=2)
    got = {r["vec_id"]: r["cluster"] for r in out.collect()}
    assert cost == 0.0 and got[1] == got[2] != got[5] and got[3] is None and got[4] is None
    out, cost = C.kmeans(d.filter("false"), 3, n_init=2)
    assert cost == 0.0 and out.columns == ["vec_id", "embedding", "cluster"] and out.count() == 0


def test_kmeans_finds_the_centres(cloud):
    rows, cost = C.kmeans(cloud[1].filter("vec_id < 120"), 4, n_init=3)
    assert C.purity(C.contingency(rows.withColumn("truth", F.col("vec_id") % 4), "truth", "cluster")).first()["purity"] > 0.9


def test_probe_learns_separable_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.eye(3)[i % 3] * 5 + rng.normal(size=3)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    r = P.linear_probe(df.filter("vec_id < 50"), df.filter("vec_id between 50 and 69"), df.filter("vec_id >= 70"), 3, regs=(0.01, 1.0), max_iter=20).first()
    assert r["accuracy"] > 0.9


def test_dbscan_settings_match_single_runs(spark):
    from rasterloom.operators import density as D
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    v = np.concatenate([centres[i % 6] + rng.normal(scale=0.02 + 0.05 * (i % 3), size=5) for i in range(150)]).reshape(-1, 5)
    v[40:44] = v[40]
    df = spark.createDataFrame([(int(i) * 3 - 50, int(i) % 4, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, label int, embedding array<double>")
    settings = [(3, 0.002), (3, 0.02), (8, 0.004), (8, 0.05), (200, 0.05)]
    got = {}
    for block in (4096, 40):
        found = D.dbscan_settings(df, settings, rows_per_block=block).collect()
        assert len(found) == len(settings) * len(v)
        for r in found:
            assert got.setdefault((r["setting"], r["vec_id"]), r["component"]) == r["component"]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for s, (m, eps) in enumerate(settings[:4]):
        want = {int(k) * 3 - 50: None if c is None else int(c) * 3 - 50 for k, c in brute_dbscan(unit, eps, m).items()}
        assert {k: c for (t, k), c in got.items() if t == s} == want
    assert all(c is None for (t, _), c in got.items() if t == 4)
    report = D.dbscan_report(df, (3, 8), (0.9, 1.1)).collect()
    for r in report[:1]:
        rows = df.join(C.cluster_ids(C.dbscan(df, r["eps"], r["min_samples"])), "vec_id")
        one = C.cluster_scores(rows, "label", "cluster", "embedding").first()
        assert abs(r["noise_ratio"] + r["coverage"] - 1) < 1e-12 and r["eps"] > 0
        for name in ("hungarian_accuracy", "nmi", "ari", "purity", "silhouette", "n_clusters"):
            a, b = r[f"all_{name}"], one[name]
            assert a == b or abs(a - b) < 1e-9, name
    assert len(report) == 4


def test_assignment_of_many_clusters(spark):
    """3,000 labels and clusters in components of known optimum; small dense tables against the whole matrix."""
    rows = []
    for k in range(1500):
        rows += [(2 * k, 2 * k, 5), (2 * k, 2 * k + 1, 4), (2 * k + 1, 2 * k, 4), (2 * k + 1, 2 * k + 1, 1)]      # crossing is better: 8 of 14
    total = sum(n for *_, n in rows)
    table = spark.createDataFrame([(a, b, n, total) for a, b, n in rows], "label int, cluster int, n long, total long")
    for limit in (200_000, 10):
        assert abs(C.hungarian_accuracy(table, driver_cells=limit).first()[0] - 1500 * 8 / total) < 1e-12
    rng = np.random.default_rng(2)
    cells = [(g, a, b, int(rng.integers(0, 9))) for g in range(3) for a in range(5) for b in range(4 + g)]
    whole = {g: sum(n for h, *_, n in cells if h == g) for g in range(3)}
    many = spark.createDataFrame([(g, a, b, n, whole[g]) for g, a, b, n in cells if n], "g int, label int, cluster int, n long, total long")
    for r in C.hungarian_accuracy(many, ["g"]).collect():
        m = np.zeros((5, 4 + r["g"]))
        for g, a, b, n in cells:
            if g == r["g"]:
                m[a, b] = n
        assert abs(r["hungarian_accuracy"] - C.assign_max(m) / whole[r["g"]]) < 1e-12
    assert C.hungarian_accuracy(table.limit(0)).first()[0] is None


def test_block_forest_holds_the_best_links():
    from rasterloom.operators import density as D
    rng = np.random.default_rng(8)
    a, b, w = rng.integers(0, 40, 600), rng.integers(0, 40, 600), rng.integers(0, 30, 600) / 30
    root, want = list(range(40)), 0.0
    def find(x):
        return x if root[x] == x else find(root[x])
    for i in np.argsort(-w, kind="stable"):
        if find(a[i]) != find(b[i]):
            root[find(a[i])] = find(b[i])
            want += w[i]
    kept = D.block_forest(w, a, b)
    assert len(kept) == 39 and abs(w[kept].sum() - want) < 1e-9
    assert not len(D.block_forest(w[:0], a[:0], b[:0]))


def test_mirrored_blocks_meet_once(spark):
    from rasterloom.operators.neighbors import block_pairs
    df = spark.range(60)
    def fn(x, y):
        import pandas as pd
        return pd.MultiIndex.from_product([x["id"], y["id"]], names=["a", "b"]).to_frame(index=False) if len(x) and len(y) else pd.DataFrame({"a": [], "b": []})
    got = {(r["a"], r["b"]) for r in block_pairs(df, df, "id", fn, "a bigint, b bigint", 10, 60, 60, mirrored=True).collect()}
    assert {(min(p), max(p)) for p in got} == {(i, j) for i in range(60) for j in range(i, 60)} and len(got) < 3000


def test_silhouettes_of_many_settings_read_no_means_per_row(spark):
    from rasterloom.operators import density as D
    df = spark.createDataFrame([(s, i % (2 + s), [1.0 + (i % (2 + s)), float(i % 5), 1.0]) for s in range(3) for i in range(60)], "setting int, cluster int, embedding array<double>")
    got = D.silhouettes(df, "setting", "cluster", "embedding")
    for r in got.collect():
        one = df.filter(F.col("setting") == r["setting"])
        v = np.array([x["embedding"] for x in one.collect()])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        c, k = np.array([x["cluster"] for x in one.collect()]), 2 + r["setting"]
        d = 1 - v @ np.array([v[c == j].mean(0) for j in range(k)]).T
        n = np.bincount(c)[c]
        own, d[np.arange(len(c)), c] = d[np.arange(len(c)), c] * n / (n - 1), np.inf
        assert abs(r["silhouette"] - ((d.min(1) - own) / np.maximum(d.min(1), own)).mean()) < 1e-9
    assert "array_min(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_kmeans_passes_read_packed_rows(spark, monkeypatch):
    """Blocks of a few rows each give the sums of all rows and restarts; no pass converts rows one by one."""
    rng = np.random.default_rng(6)
    v, centres = rng.normal(size=(90, 3)), rng.normal(size=(2, 4, 3))
    df = spark.createDataFrame([([float(x) for x in r], i) for i, r in enumerate(v)], "v array<double>, h long").repartition(3)
    monkeypatch.setattr(C, "PACK_BYTES", 200)
    packed = C._packed(df)
    assert packed.count() >= 12 and dict(packed.dtypes)["v"] == "binary"
    sums, sizes, cost = C._assigned_sums(packed, centres)
    monkeypatch.setattr(C, "SUMMED_HERE", 1)
    assert all(np.allclose(a, b) for a, b in zip(C._assigned_sums(packed, centres), (sums, sizes, cost)))
    for r in range(2):
        far = ((v[:, None, :] - centres[r][None]) ** 2).sum(2)
        own = far.argmin(1)
        assert sizes[r].tolist() == np.bincount(own, minlength=4).tolist() and abs(cost[r] - far.min(1).sum()) < 1e-9
        assert np.allclose(sums[r], [v[own == c].sum(0) for c in range(4)])


def test_neighbour_lists_match_brute_force(spark):
    """Blocks of any size, copies (ties by id), fewer rows than asked for; rows without a finite direction are in no list."""
    from rasterloom.operators.nearlists import neighbour_lists
    rng = np.random.default_rng(12)
    v = rng.normal(size=(140, 6))
    v[20:60] = v[20]
    ids = np.array([int(i) for i in rng.permutation(140)]) * 7 - 300
    odd = [(9001, [0.0] * 6), (9002, [float("nan")] + [1.0] * 5), (9003, None)]
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)] + odd, "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    for k, block in ((5, 4096), (5, 20), (60, 50), (200, 4096), (200, 30)):
        got = {r["id"]: (r["near"], r["sims"]) for r in neighbour_lists(df, k, rows_per_block=block).collect()}
        assert set(got) == {int(i) for i in ids}
        for i, row in zip(ids, sim):
            order = np.lexsort((ids, -row))[:k]
            assert got[int(i)][0] == [int(x) for x in ids[order]] and np.allclose(got[int(i)][1], row[order], atol=2e-9)
    assert neighbour_lists(df.limit(0), 3).count() == 0


def test_products_of_copies_keep_the_first_ids(monkeypatch):
    from rasterloom.operators import nearlists as L
    monkeypatch.setattr(L, "PIECE", 16)
    monkeypatch.setattr(L, "FIRST", 32)
    monkeypatch.setattr(L, "WAITING", 50)
    rng = np.random.default_rng(13)
    v = rng.normal(size=(200, 4))
    v[30:150] = v[30]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for rows, columns, found in ((v, v, L.product(v, None, 7)[0]), (v[:80], v[80:], L.product(v[:80], v[80:], 7)[0]), (v[80:], v[:80], L.product(v[:80], v[80:], 7)[1])):
        sim = np.round(rows @ columns.T, 9)
        want = np.lexsort((np.broadcast_to(np.arange(len(columns)), sim.shape), -sim), axis=1)[:, :7]
        assert (found[0] == np.repeat(np.arange(len(rows)), 7)).all() and (found[1].reshape(-1, 7) == want).all()


def _settings_by_brute_force(spark, v, settings, **kw):
    from rasterloom.operators import density as D
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in D.dbscan_settings(df, settings, **kw).collect():
        got.setdefault(r["setting"], {})[r["vec_id"]] = r["component"]
    for s, (m, eps) in enumerate(settings):
        assert got[s] == brute_dbscan(unit, eps, m)


def test_groups_of_copies_meet_although_no_list_holds_both(spark):
    """Lists of the nearest rows are full of copies; neighbouring groups are joined by open rows only."""
    turn = np.array([[np.cos(a), np.sin(a)] for a in (0.0, 0.1, 0.2, 1.0, 1.1, 2.0, 3.0)])
    v = np.concatenate([np.repeat(turn[:6], 12, axis=0), turn[6:]])
    settings = [(3, 0.0001), (3, 0.006), (5, 0.006), (5, 0.02)]
    for block in (4096, 20):
        _settings_by_brute_force(spark, v, settings, rows_per_block=block)


def test_lists_alone_place_border_rows_and_one_cloud(spark, monkeypatch):
    """One cloud that its lists join: no other pass multiplies rows, and forests too large for a task give the same components."""
    from rasterloom.operators import density as D
    rng = np.random.default_rng(14)
    v = np.concatenate([rng.normal(size=5) + rng.normal(scale=0.2, size=(80, 5)), rng.normal(size=(20, 5))])
    def forbidden(*args, **kw):
        raise AssertionError("rows were multiplied again")
    monkeypatch.setattr(D, "block_pairs", forbidden)
    _settings_by_brute_force(spark, v, [(4, 0.03), (9, 0.06)])
    _settings_by_brute_force(spark, v, [(4, 0.03), (9, 0.06)], most=10)


def test_assignment_follows_the_short_side():
    """Ten labels and 2,000 clusters take ten augmenting paths, not 2,000."""
    import time
    rng = np.random.default_rng(15)
    gain = rng.integers(0, 50, (10, 2000)).astype(float)
    start = time.process_time()
    total = C.assign_max(gain)
    assert time.process_time() - start < 5 and total == C.assign_max(gain.T) == 490.0
    small = gain[:3, :5]
    assert C.assign_max(small) == max(small[0, a] + small[1, b] + small[2, c] for a in range(5) for b in range(5) for c in range(5) if len({a, b, c}) == 3)


def test_silhouettes_by_setting_match_single_ones(spark):
    from rasterloom.operators import density as D
    rng = np.random.default_rng(16)
    rows = [([float(x) for x in rng.normal(size=4)], [int(i % 4) - 1, -1, 0, int(i % 9), int(i == 5) - 1, int(i)]) for i in range(90)]
    df = spark.createDataFrame(rows, "embedding array<double>, clusters array<int>").repartition(3)
    got = {r["setting"]: r for r in D.silhouettes_by_setting(df, "clusters", "embedding").collect()}
    blocks, slices = ({r["setting"]: r for r in D.silhouettes_by_setting(df, "clusters", "embedding", most=m).collect()} for m in (0, 400))
    assert set(got) == set(blocks) == set(slices) == set(range(6))
    for s in range(6):
        one = df.withColumn("c", F.col("clusters")[s])
        for name, part in (("all", one), ("covered", one.filter("c >= 0"))):
            want = C.silhouette(part, "c", "embedding").first()[0]
            for found in (got[s][name], blocks[s][name], slices[s][name]):
                assert found == want or abs(found - want) < 1e-12
