"""Queries over band statistics and intensity transforms."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bands as B, joins as J
from .inputs import BAND_PIXELS, BANDS, band_pixels, bands
from .registry import query
from .scoring import r6

# per-sample, per-band summary of a double column
SUMM = "sample_id, band, COUNT(*) n, ROUND(SUM(value*(y+1)),4) a, ROUND(SUM(value*(x+1)),4) b"


def summ(df):
    return df.groupBy("sample_id", "band").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") + 1)), 4).alias("a"),
                                               F.round(F.sum(F.col("value") * (F.col("x") + 1)), 4).alias("b"))


def bp(cte):
    return f"WITH {BAND_PIXELS}, t AS ({cte}) SELECT {SUMM} FROM t GROUP BY ALL"


QS = ", ".join(f"ROUND(quantile_cont(value, {p}),6) {n}" for n, p in B.PROFILE.items())


@query("a21_band_stats", f"WITH {BANDS} SELECT band, ROUND(MIN(value),6) AS \"min\", ROUND(MAX(value),6) AS \"max\", ROUND(AVG(value),6) mean, ROUND(STDDEV_POP(value),6) std, {QS} FROM bands GROUP BY band")
def _(t):
    return r6(B.band_stats(bands(t)))


@query("l17_sample_values")
def _(t):
    return B.sample_values(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], 10)


STAT = "st AS (SELECT band, MIN(value) mn, MAX(value) mx, AVG(value) mean, STDDEV_POP(value) std FROM bands GROUP BY band)"


def stats(t):
    return bands(t).groupBy("band").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _norm(name, method, expr):
    sql = f"WITH {BANDS}, {STAT} SELECT sample_id, band, COUNT(*) n, ROUND(SUM({expr}),5) total FROM bands JOIN st USING (band) GROUP BY ALL"

    @query(name, sql)
    def _(t, method=method):
        return B.normalize(bands(t), stats(t), method).groupBy("sample_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


_norm("p17_normalize", "standardize", "(value-mean)/std")
_norm("p18_scale_two_sigma", "two_sigma", "(value-(mean-2*std))/(4*std)")
_norm("p18_scale_one_sigma", "one_sigma", "(value-(mean-std))/(2*std)")
_norm("p18_scale_min_max", "min_max", "(value-mn)/(mx-mn)")


@query("p19_normalize_modalities", f"""WITH {BANDS}, {STAT} SELECT sample_id, band, COUNT(*) n, ROUND(SUM(COALESCE((value-mean)/GREATEST(std,1e-6),value)),5) total
FROM bands LEFT JOIN (SELECT * FROM st WHERE band <> 'tax') USING (band) GROUP BY ALL""")
def _(t):
    return B.normalize_modalities(bands(t), stats(t).filter("band <> 'tax'"), ["band"]).groupBy("sample_id", "band").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query("p20_fold_stats", f"""WITH b AS (SELECT CAST(l_orderkey % 5 AS INT) fold, unnest(['quantity','price','discount','tax']) band, unnest([l_quantity,l_extendedprice,l_discount,0.0]) value FROM lineitem),
f AS (SELECT band, fold, AVG(value) mean, STDDEV_POP(value) std FROM b GROUP BY ALL) SELECT band, ROUND(AVG(mean),6) mean, ROUND(GREATEST(AVG(std),0.001),6) std FROM f WHERE fold IN (0,1,3) GROUP BY band""")
def _(t):
    b = bands(t).withColumn("value", F.when(F.col("band") == "tax", 0.0).otherwise(F.col("value"))).withColumn("fold", (F.col("sample_id") % 5).cast("int"))
    st = b.groupBy("band", "fold").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return r6(B.fold_stats(st, [0, 1, 3], eps=0.001))


@query("p20_reflectance", "SELECT l_orderkey, ROUND(SUM(LEAST(GREATEST(l_extendedprice/10000,0),1)),6) v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(B.reflectance(F.col("l_extendedprice"))), 6).alias("v"))


@query("p21_rerange", bp("SELECT sample_id, y, x, band, (value-MIN(value) OVER w)/NULLIF(MAX(value) OVER w-MIN(value) OVER w,0)*(3.0-(-1.0))+(-1.0) AS value FROM band_pixels WINDOW w AS (PARTITION BY sample_id)"))
def _(t):
    return summ(B.rerange(band_pixels(t), ["sample_id"], -1.0, 3.0))


@query("p22_select_bands", f"""WITH {BAND_PIXELS}, src AS (SELECT sample_id, y, x, CASE WHEN band='G' AND sample_id%2=0 THEN 'unused' ELSE band END AS band, value FROM band_pixels),
o AS (SELECT s.sample_id, s.y, s.x, 0 AS band_index, 'B' AS band, s.value FROM src s WHERE band='B'
 UNION ALL SELECT sample_id, y, x, 1, 'G', COALESCE(MAX(CASE WHEN band='G' THEN value END), MAX(CASE WHEN band='R' THEN value END)) FROM src GROUP BY ALL
 UNION ALL SELECT sample_id, y, x, 2, 'N', value FROM src WHERE band='R')
SELECT sample_id, band, band_index, COUNT(*) n, ROUND(SUM(value*(y+1)),4) a FROM o GROUP BY ALL""")
def _(t):
    src = band_pixels(t).withColumn("band", F.when((F.col("band") == "G") & (F.col("sample_id") % 2 == 0), "unused").otherwise(F.col("band")))
    out = B.select_bands(src, ["B", "G", "N"], {"G": "R", "N": "R"})
    return out.groupBy("sample_id", "band", "band_index").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") + 1)), 4).alias("a"))


@query("p23_impute_stats", f"WITH {BANDS}, {STAT} SELECT CAST(w.i AS INT) band_index, w.want AS band, ROUND(mean,6) mean, ROUND(std,6) std FROM (VALUES (0,'price','price'),(1,'nir','quantity'),(2,'tax','tax')) w(i, want, src) JOIN st ON st.band=w.src")
def _(t):
    return r6(B.impute_stats(stats(t).select("band", "mean", "std"), ["price", "nir", "tax"], {"nir": "quantity"}))


BST = "bst AS (SELECT CASE band WHEN 'R' THEN 'B04' WHEN 'G' THEN 'B03' ELSE 'B02' END band, AVG(value)*40 mean, STDDEV_POP(value)*40 std FROM band_pixels GROUP BY 1)"


@query("p24_rgb_to_bands", f"""WITH {BAND_PIXELS}, {BST}, mx AS (SELECT sample_id, MAX(CASE WHEN sample_id%3=0 THEN value/255 ELSE value END) m FROM band_pixels GROUP BY ALL),
r AS (SELECT p.sample_id, y, x, CASE p.band WHEN 'R' THEN 'B04' WHEN 'G' THEN 'B03' ELSE 'B02' END band, CASE WHEN p.sample_id%3=0 THEN value/255 ELSE value END * CASE WHEN m<=1.5 THEN 10000.0 ELSE 10000.0/255.0 END v FROM band_pixels p JOIN mx USING (sample_id)),
n AS (SELECT sample_id, y, x, r.band, (v-(mean-2*std))/(4*std) AS value FROM r JOIN bst ON bst.band=r.band UNION ALL SELECT sample_id, y, x, unnest(['B08','B11']), 0.0 FROM r WHERE band='B04')
SELECT {SUMM} FROM n GROUP BY ALL""")
def _(t):
    px = band_pixels(t)
    names = F.when(F.col("band") == "R", "B04").when(F.col("band") == "G", "B03").otherwise("B02")
    st = px.groupBy(names.alias("band")).agg((F.avg("value") * 40).alias("mean"), (F.stddev_pop("value") * 40).alias("std"))
    px = px.withColumn("value", F.when(F.col("sample_id") % 3 == 0, F.col("value") / 255).otherwise(F.col("value")))
    return summ(B.rgb_to_bands(px, st, {"R": "B04", "G": "B03", "B": "B02"}, ["B02", "B03", "B04", "B08", "B11"]))


@query("p25_to_gray", f"""WITH {BAND_PIXELS}, g AS (SELECT sample_id, y, x, unnest(['a','b']) band, SUM(CASE band WHEN 'R' THEN 0.299 WHEN 'G' THEN 0.587 ELSE 0.114 END*value) AS value FROM band_pixels GROUP BY sample_id, y, x)
SELECT {SUMM} FROM g GROUP BY ALL""")
def _(t):
    return summ(B.to_gray(band_pixels(t), ["sample_id", "y", "x"], B.LUMA, ["a", "b"]))


@query("p26_adjust_gamma", bp("SELECT sample_id, y, x, band, floor(pow(value/255.0, 1/1.7)*255.0) AS value FROM band_pixels"))
def _(t):
    return summ(band_pixels(t).withColumn("value", S.adjust_gamma(F.col("value"), 1.7).cast("double")))


GS = """SELECT *, MIN(value) OVER w mn, MAX(value) OVER w - MIN(value) OVER w rg, AVG(value) OVER w mu, STDDEV_POP(value) OVER w sd FROM {src} WINDOW w AS (PARTITION BY sample_id)"""


@query("p27_gamma_stats", bp("SELECT sample_id, y, x, band, pow((value-mn)/(rg+1e-7),0.8)*rg+mn AS value FROM (" + GS.format(src="band_pixels") + ")"))
def _(t):
    return summ(B.gamma_stats(band_pixels(t), ["sample_id"], 0.8))


@query("p27_gamma_stats_retain", f"""WITH {BAND_PIXELS}, i AS (SELECT sample_id, y, x, band, -value AS value FROM band_pixels), g AS ({GS.format(src='i')}),
h AS (SELECT *, pow((value-mn)/(rg+1e-7),1.4)*rg+mn v2 FROM g), k AS (SELECT *, AVG(v2) OVER w m2, STDDEV_POP(v2) OVER w s2 FROM h WINDOW w AS (PARTITION BY sample_id)),
t AS (SELECT sample_id, y, x, band, -((v2-m2)/(s2+1e-8)*sd+mu) AS value FROM k) SELECT {SUMM} FROM t GROUP BY ALL""")
def _(t):
    return summ(B.gamma_stats(band_pixels(t), ["sample_id"], 1.4, retain=True, invert=True))


@query("p28_linear_intensity", bp("SELECT sample_id, y, x, band, trunc(LEAST(GREATEST(value*1.25-20.5,0),255)) AS value FROM band_pixels"))
def _(t):
    return summ(band_pixels(t).withColumn("value", S.linear_intensity(F.col("value"), 1.25, -20.5).cast("double")))


@query("p29_add_noise")
def _(t):
    return summ(B.add_noise(band_pixels(t), "sample_id", ["y", "x", "band"], 0.0, 5.0, 42))


@query("p30_stack_inputs", f"""WITH {BAND_PIXELS}, b AS (SELECT sample_id, y, x, CASE band WHEN 'R' THEN 0 WHEN 'G' THEN 1 ELSE 2 END c, value FROM band_pixels),
s AS (SELECT * FROM b UNION ALL SELECT sample_id, y, x, c+3, 255-value FROM b) SELECT sample_id, c, COUNT(*) n, ROUND(SUM(value*(y+1)),4) a FROM s GROUP BY ALL""")
def _(t):
    b = band_pixels(t).withColumn("c", F.when(F.col("band") == "R", 0).when(F.col("band") == "G", 1).otherwise(2)).drop("band")
    return B.stack_inputs(b, b.withColumn("value", 255 - F.col("value")), "c", 3).groupBy("sample_id", "c").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") + 1)), 4).alias("a"))


@query("p31_clean_bands", bp("SELECT sample_id, y, x, band, CASE WHEN value>=250 THEN 0 ELSE value END * CASE band WHEN 'R' THEN 0.5 ELSE 1.0 END AS value FROM band_pixels WHERE band IN ('R','B')"))
def _(t):
    nan = band_pixels(t).withColumn("value", F.when(F.col("value") >= 250, float("nan")).otherwise(F.col("value")))
    return summ(B.clean_bands(nan, ["R", "B"], {"R": 0.5}))


@query("p46_stretch", f"""WITH {BAND_PIXELS}, l AS (SELECT sample_id, band, quantile_cont(value,0.02) lo, quantile_cont(value,0.98) hi FROM band_pixels GROUP BY ALL),
t AS (SELECT p.sample_id, y, x, p.band, floor(ROUND(LEAST(GREATEST((value-lo)/(hi-lo)*255.0,0),255),9)) AS value FROM band_pixels p JOIN l ON l.sample_id=p.sample_id AND l.band=p.band) SELECT {SUMM} FROM t GROUP BY ALL""")
def _(t):
    return summ(B.stretch(band_pixels(t), ["sample_id", "band"]).withColumn("value", F.col("value").cast("double")))


# --- joins ------------------------------------------------------------------------------------------
@query("j1_pair", "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return J.pair(t.documents.select("doc_id", "source"), t.labels.select("doc_id", "quality"), "doc_id")


@query("j2_attach_labels", "SELECT d.doc_id, l.toxic, CASE WHEN l.toxic IS NULL THEN 'missing_label' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return J.attach_labels(t.documents.select("doc_id"), t.labels, "doc_id", "toxic")


@query("j3_join_tokens", """WITH px AS (SELECT p_partkey sample_id, CAST(8+p_size%9 AS INT) h, CAST(8+p_partkey%7 AS INT) w FROM part),
g AS (SELECT *, CAST(unnest(range(w)) AS INT) x FROM (SELECT *, CAST(unnest(range(h)) AS INT) y FROM px)),
k AS (SELECT sample_id, y, x, LEAST(CAST(floor((y+0.5)*4/h) AS INT),3) gy, LEAST(CAST(floor((x+0.5)*3/w) AS INT),2) gx FROM g)
SELECT sample_id, gy, gx, COUNT(*) n, CAST(SUM((sample_id%11+gy*3+gx)*(y+x+1)) AS BIGINT) checksum FROM k GROUP BY ALL""")
def _(t):
    from .inputs import grid, rasters
    tokens = (rasters(t).select("sample_id").withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(3))))
              .withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("token", F.col("sample_id") % 11 + F.col("gy") * 3 + F.col("gx")))
    j = J.join_tokens(grid(rasters(t)), tokens, "sample_id", "h", "w", 4, 3)
    return j.groupBy("sample_id", "gy", "gx").agg(F.count("*").alias("n"), F.sum(F.col("token") * (F.col("y") + F.col("x") + 1)).alias("checksum"))


@query("j6_unknown_classes", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 46)")
def _(t):
    return J.unknown_classes(t.part.filter("p_type = 'ECONOMY' and p_size > 46"), t.part, "p_brand")


@query("j9_neighbour_diff", """WITH px AS (SELECT * FROM (SELECT p_partkey sample_id, CAST(8+p_size%9 AS INT) h, CAST(8+p_partkey%7 AS INT) w FROM part)),
g AS (SELECT *, CAST(unnest(range(w)) AS INT) x FROM (SELECT *, CAST(unnest(range(h)) AS INT) y FROM px)), v AS (SELECT sample_id, y, x, CASE WHEN (x*7+y*13+sample_id)%6=5 THEN 255 ELSE (x*7+y*13+sample_id)%6 END v FROM g),
d AS (SELECT a.sample_id, a.y, a.x, o.dy, o.dx FROM v a, (VALUES (1,0),(0,1)) o(dy,dx) JOIN v b ON b.sample_id=a.sample_id AND b.y=a.y+o.dy AND b.x=a.x+o.dx WHERE a.v<>b.v AND a.v<>255 AND b.v<>255)
SELECT sample_id, dy, dx, COUNT(*) n, CAST(SUM(y*37+x*11) AS BIGINT) checksum FROM d GROUP BY ALL""")
def _(t):
    from .inputs import pixels
    d = J.neighbour_diff(pixels(t), "sample_id", "gt", ignore=255)
    return d.groupBy("sample_id", "dy", "dx").agg(F.count("*").alias("n"), F.sum(F.col("y") * 37 + F.col("x") * 11).alias("checksum"))


@query("j11_pair_dates", """WITH a AS (SELECT o_orderkey k, CAST(o_custkey%3 AS INT) h, 4 AS w FROM orders), b AS (SELECT o_orderkey k, CAST(o_orderkey%3 AS INT) h, 4 AS w FROM orders WHERE o_orderstatus<>'P')
SELECT k, (a.h=b.h AND a.w=b.w) AS same_shape FROM a JOIN b USING (k)""")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).cast("int").alias("h"), F.lit(4).alias("w"))
    b = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("h"), F.lit(4).alias("w"))
    return J.pair_dates(a, b, "k").select("k", "same_shape")


@query("a24_embedding_diff", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) a, list_transform(CAST(embedding AS DOUBLE[]), lambda v, i: v + CASE WHEN i%7=0 THEN 0.01 ELSE -0.002 END) b FROM embeddings),
l AS (SELECT ABS(x-y) d FROM (SELECT unnest(a) x, unnest(b) y FROM e)), c AS (SELECT list_cosine_similarity(a,b) c, label FROM e)
SELECT (SELECT ROUND(MAX(d),6) FROM l) max_abs, (SELECT ROUND(AVG(d),6) FROM l) mean_abs, (SELECT ROUND(quantile_cont(d,0.95),6) FROM l) p95_abs, ROUND(AVG(c),6) mean_cosine, ROUND(MIN(c),6) min_cosine, COUNT(*) FILTER (WHERE label=4) label_mismatches FROM c""")
def _(t):
    a = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    b = a.withColumn("embedding", F.transform("embedding", lambda v, i: v + F.when((i + 1) % 7 == 0, 0.01).otherwise(-0.002))).withColumn(
        "label", F.when(F.col("label") == 4, 0).otherwise(F.col("label")))
    return r6(J.embedding_diff(a, b, "vec_id", label="label"))


EXPORTS = """a AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 19 <> 4),
b AS (SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN label + 1 ELSE label END AS label, CASE WHEN vec_id % 11 = 2 THEN embedding[1:63] WHEN vec_id % 5 = 3 THEN list_transform(embedding, lambda x: x * 2) ELSE embedding END AS embedding
 FROM embeddings WHERE vec_id % 17 <> 3)"""


@query("j12_compare", f"""WITH {EXPORTS}, j AS (SELECT COALESCE(a.vec_id, b.vec_id) vec_id, a.vec_id ka, b.vec_id kb, a.label la, b.label lb, a.embedding ea, b.embedding eb FROM a FULL JOIN b ON a.vec_id = b.vec_id),
g AS (SELECT *, list_max(list_transform(range(1, len(ea) + 1), lambda i: abs(ea[i]::DOUBLE - eb[i]::DOUBLE))) gap FROM j),
r AS (SELECT vec_id, CASE WHEN ka IS NULL THEN 'missing_left' WHEN kb IS NULL THEN 'missing_right' WHEN len(ea) <> len(eb) THEN 'size' WHEN la <> lb THEN 'label' WHEN gap > 0 THEN 'values' END AS rule,
 CASE WHEN len(ea) = len(eb) THEN gap END AS max_abs FROM g)
SELECT vec_id, rule, ROUND(max_abs, 6) AS max_abs FROM r WHERE rule IS NOT NULL""")
def _(t):
    k = F.col("vec_id")
    a = t.embeddings.filter(k % 19 != 4)
    other = F.when(k % 11 == 2, F.slice("embedding", 1, 63)).when(k % 5 == 3, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    b = t.embeddings.filter(k % 17 != 3).select("vec_id", F.when(k % 7 == 1, F.col("label") + 1).otherwise(F.col("label")).alias("label"), other.alias("embedding"))
    return J.compare_exports(a, b, "vec_id").withColumn("max_abs", F.round("max_abs", 6))


@query("j13_densify_bands", """WITH b AS (SELECT DISTINCT o_custkey s, o_orderdate d, o_orderpriority band FROM orders), f AS (SELECT o_custkey s, o_orderdate d, o_orderpriority band, MAX(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT g.s AS sample_id, g.d AS date, p.band, COALESCE(f.value, -1.0) AS value, f.value IS NULL AS was_missing FROM (SELECT DISTINCT s, d FROM b) g, (VALUES ('1-URGENT'),('2-HIGH'),('5-LOW')) p(band) LEFT JOIN f ON f.s=g.s AND f.d=g.d AND f.band=p.band""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("sample_id"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("band")).agg(F.max("o_totalprice").alias("value"))
    return J.densify_bands(o, "sample_id", "date", "band", "value", ["1-URGENT", "2-HIGH", "5-LOW"], -1.0)


@query("j14_present", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return J.present(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id")


@query("j15_fill_missing_masks", """SELECT p_partkey, CASE WHEN p_type='ECONOMY' THEN repeat('1', 4) ELSE repeat('0', CAST(2*(p_size%3+1) AS INT)) END AS labels FROM part""")
def _(t):
    img = t.part.select("p_partkey", F.lit(2).alias("h"), (F.col("p_size") % 3 + 1).alias("w"))
    masks = t.part.filter("p_type = 'ECONOMY'").select("p_partkey", F.array_repeat(F.lit(1), 4).alias("labels"))
    return J.fill_missing_masks(img, masks, "p_partkey").select("p_partkey", F.array_join("labels", "").alias("labels"))
