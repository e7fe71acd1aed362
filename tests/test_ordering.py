"""Sliced ranks, sums, fills and percentiles against brute force, with tiny slices and hot keys."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import ordering as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    # a third of all rows shares one key and one value
    out = [(int(i), "hot" if i % 3 == 0 else f"g{rng.integers(5)}", 7.0 if i % 3 == 0 else float(rng.integers(50)), int(rng.integers(9))) for i in range(900)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double, w long").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_running(df, rows, by, direction):
    got = {r["id"]: (r["rn"], r["cum"]) for r in O.running(df, [("v", direction), "id"], by, sums={"cum": "w"}, rows_per_slice=20).collect()}
    sign = 1 if direction == "asc" else -1
    groups = {}
    for r in sorted(rows, key=lambda r: (sign * r[2], r[0])):
        state = groups.setdefault(r[1] if by else None, [0, 0])
        state[0] += 1
        state[1] += r[3]
        assert got[r[0]] == tuple(state)
    assert len(got) == len(rows)


def test_hot_key_is_cut(df):
    sliced = O.with_slice(df, ["v", "id"], rows_per_slice=20)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] < 120


def test_small_groups_are_not_cut(df):
    assert O.with_slice(df, ["v", "id"], ["id"], rows_per_slice=20) is None


@pytest.mark.parametrize("size", [20, 10_000])
def test_totals(df, rows, size):
    got = O.running(df, ["v", "id"], ["g"], totals={"t": "w"}, rows_per_slice=size).select("g", "t").distinct().collect()
    assert {r["g"]: r["t"] for r in got} == {g: sum(r[3] for r in rows if r[1] == g) for g in {r[1] for r in rows}}


def test_string_order(df, rows):
    got = {r["id"]: r["rn"] for r in O.rank_rows(df, ["g", "id"], rows_per_slice=50).collect()}
    for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        assert got[r[0]] == i


@pytest.mark.parametrize("size", [20, 10_000])
def test_percentiles(df, rows, size):
    got = {r["g"]: r for r in O.percentiles(df, ["g"], "v", {"a": 0.02, "b": 0.5, "c": 0.999}, rows_per_slice=size).collect()}
    for g in {r[1] for r in rows}:
        want = np.percentile([r[2] for r in rows if r[1] == g], [2, 50, 99.9])
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], want)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("size", [40, 10_000])
def test_percentiles_of_odd_values(spark, by, size):
    rng = np.random.default_rng(6)
    groups = {"wide": [float(v) for v in np.exp(rng.normal(scale=60, size=300))], "huge": [1.7e308, -1.7e308, 1e308, 0.0, 5e-324, 1e-323] * 3,
              None: [float(v) for v in rng.normal(size=200)] + [3.0] * 150, "ends": [float("inf"), float("-inf"), 2.0, 1.0, float("nan"), 0.5] * 4}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None)] * 5
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = {"lo": 0.0, "a": 0.25, "b": 0.5, "hi": 1.0}
    got = {r["g"] if by else "all": r for r in O.percentiles(df, by, "v", ps, rows_per_slice=size).collect()}
    for g, vs in groups.items() if by else [("all", [v for _, v in rows if v is not None])]:
        vs = sorted(vs, key=lambda v: (np.isnan(v), v))
        for name, p in ps.items():
            at = p * (len(vs) - 1)
            lo, hi = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            with np.errstate(invalid="ignore", over="ignore"):
                want = np.float64(lo) + (np.float64(hi) - lo) * (at - np.floor(at))
            assert np.array_equal([got[g][name]], [want], equal_nan=True), (g, name)
    assert len(got) == (len(groups) if by else 1)
    nothing = O.percentiles(df.filter("false"), by, "v", ps, rows_per_slice=size).collect()
    assert nothing == [] if by else nothing[0]["b"] is None


def test_nth_smallest(df, rows):
    values = sorted(r[2] for r in rows)
    assert O.nth_smallest(df, "v", ["id"], 17).first()["nth"] == values[17]
    assert O.nth_smallest(df, "v", ["id"], 10_000).first()["nth"] == values[-1]


def test_carry_forward_across_slices(spark):
    data = [("f", i, 5 if i == 3 else (9 if i == 250 else None)) for i in range(400)] + [("h", i, None) for i in range(50)]
    d = spark.createDataFrame(data, "f string, p long, v int")
    got = {(r["f"], r["p"]): r["x"] for r in O.carry_forward(d, "v", ["f"], "p", "x", 0, rows_per_slice=40).collect()}
    assert got[("f", 2)] == 0 and got[("f", 3)] == 5 and got[("f", 249)] == 5 and got[("f", 399)] == 9 and got[("h", 49)] == 0
    assert len(got) == 450
