"""Queries on the awkward cases of operators: no spread, no statistics, predictions at or below zero, NULL groups beyond one slice."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as B, depth as D, ordering as O, sampling as S
from .registry import query

BANDS = """v AS (SELECT l_linenumber % 4 AS band, CAST(CASE WHEN l_linenumber % 4 = 2 THEN 7 ELSE l_quantity END AS DOUBLE) AS value FROM lineitem),
st AS (SELECT band, min(value) mn, max(value) mx, avg(value) mean, stddev_pop(value) std FROM v WHERE band <> 3 GROUP BY band)"""


def _bands(t):
    band = (F.col("l_linenumber") % 4).cast("int")
    v = t.lineitem.select(band.alias("band"), F.when(band == 2, F.lit(7.0)).otherwise(F.col("l_quantity").cast("double")).alias("value"))
    stats = v.filter("band <> 3").groupBy("band").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return v, stats


for _name, _sql in (("standardize", "(value - mean) / std"), ("min_max", "(value - mn) / (mx - mn)"), ("two_sigma", "(value - (mean - 2 * std)) / (4 * std)")):
    @query(f"p17_edge_{_name}", f"WITH {BANDS} SELECT CAST(band AS INT) band, COUNT(*) n, COUNT(x) n_values, ROUND(SUM(x), 4) s FROM (SELECT v.band, "
           f"CASE WHEN st.band IS NULL THEN value WHEN std > 1e-12 THEN {_sql} END AS x FROM v LEFT JOIN st ON v.band = st.band) GROUP BY band")
    def _(t, method=_name):
        out = B.normalize(*_bands(t), method)
        return out.groupBy("band").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 4).alias("s"))


DEPTH = """d AS (SELECT l_suppkey % 50 AS sample, CAST(l_quantity AS DOUBLE) AS g, CAST(l_quantity - (CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE 0 END) * (l_linenumber - 1) AS DOUBLE) AS p FROM lineitem)"""


@query("a17_depth_nonpositive", f"WITH {DEPTH} SELECT sample, ROUND(AVG(CASE WHEN p <> 0 AND greatest(g/p, p/g) < 1.25 THEN 1.0 ELSE 0 END), 6) d1, ROUND(AVG(abs(p-g)/g), 6) abs_rel, ROUND(SQRT(AVG((p-g)**2)), 6) rmse, "
       "ROUND(CASE WHEN MIN(p) > 0 THEN SQRT(AVG(CASE WHEN p > 0 THEN (ln(p)-ln(g))**2 END)) END, 6) rmse_log FROM d GROUP BY sample")
def _(t):
    d = t.lineitem.select((F.col("l_suppkey") % 50).alias("sample"), F.col("l_quantity").cast("double").alias("gt"),
                          (F.col("l_quantity") - F.when(F.col("l_suppkey") % 3 == 0, 5).otherwise(0) * (F.col("l_linenumber") - 1)).cast("double").alias("pred"))
    return D.depth_per_image(d, "sample").select("sample", *[F.round(c, 6).alias(c) for c in ("d1", "abs_rel", "rmse", "rmse_log")])


GROUPED = """o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS grp, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS day FROM orders)"""


def _grouped(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3).alias("grp"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("day"))


@query("l2_null_groups_sliced", f"WITH {GROUPED} SELECT o_orderkey, grp, row_number() OVER (PARTITION BY grp ORDER BY day DESC NULLS LAST, o_orderkey NULLS FIRST) rn FROM o")
def _(t):
    return O.rank_rows(_grouped(t), [("day", "desc"), "o_orderkey"], ["grp"], rows_per_slice=97).drop("day")


@query("l2_null_order_topk", f"WITH {GROUPED} SELECT o_orderkey, grp, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day DESC NULLS LAST, o_orderkey NULLS FIRST) rn FROM o) WHERE rn <= 1001")
def _(t):
    return S.topk(_grouped(t), ["grp"], [("day", "desc"), "o_orderkey"], 1001).drop("day")
