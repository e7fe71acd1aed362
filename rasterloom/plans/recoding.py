"""Queries over label vocabularies, label recoding, dates, names and small projections."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, vectors as V
from ..operators import bands as B, filters as FL, labels as L, ranking as R
from .inputs import BAND_PIXELS, BANDS, PIXELS, SCORES, band_pixels, bands, pixels, rasters, scores
from .registry import query
from .scoring import r6

# per-sample checksum of an integer column v: every pixel weighs its own position
CHECK = "CAST(SUM(v * (y * 37 + x * 11 + 1)) AS BIGINT)"


def check(df, col, *keys):
    keys = keys or ("sample_id",)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(col).cast("bigint") * (F.col("y") * 37 + F.col("x") * 11 + 1)).alias("checksum"))


def pix_check(expr, where="", frm="pixels"):
    return f"WITH {PIXELS} SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM (SELECT sample_id, y, x, {expr} AS v FROM {frm} {where}) GROUP BY sample_id"


# old vocabulary: all nations; new vocabulary: the nations of all regions but AFRICA, renumbered
VOCAB = """old AS (SELECT n_name AS name, n_nationkey AS class_id FROM nation),
new AS (SELECT n_name AS name, CAST(ROW_NUMBER() OVER (ORDER BY n_nationkey) - 1 AS INT) AS class_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
lm AS (SELECT old.name, old.class_id AS old_id, CAST(COALESCE(new.class_id, 255) AS INT) AS new_id FROM old LEFT JOIN new USING (name))"""


def vocab(t):
    from ..operators.ordering import rank_rows
    old = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("class_id"))
    keep = t.nation.join(t.region.filter("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    new = rank_rows(keep, ["n_nationkey"]).select(F.col("n_name").alias("name"), (F.col("rn") - 1).cast("int").alias("class_id"))
    return old, new


@query("p1_build_label_map", f"WITH {VOCAB} SELECT * FROM lm")
def _(t):
    return L.build_label_map(*vocab(t))


@query("p2_apply_label_map", f"WITH {VOCAB} SELECT c_custkey, COALESCE(new_id, c_nationkey) AS c_nationkey FROM customer LEFT JOIN lm ON old_id = c_nationkey")
def _(t):
    return L.recode(t.customer.select("c_custkey", "c_nationkey"), L.build_label_map(*vocab(t)), "c_nationkey")


@query("p2_apply_label_map_array", f"""WITH {PIXELS}, m AS (SELECT sample_id, y*w+x i, CASE gt WHEN 0 THEN 2 WHEN 1 THEN 255 WHEN 2 THEN 0 ELSE gt END g FROM pixels)
SELECT sample_id, array_to_string(list(g ORDER BY i), ',') AS labels FROM m GROUP BY sample_id""")
def _(t):
    # masks as arrays: built per sample from its side lengths, no shuffle
    k = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    g = F.transform(k, lambda i: ((i % F.col("w")) * 7 + F.floor(i / F.col("w")) * 13 + F.col("sample_id")) % 6)
    m = rasters(t).withColumn("labels", F.transform(g, lambda v: F.when(v == 5, 255).otherwise(v).cast("int")))
    out = L.recode_array(m, {0: 2, 1: 255, 2: 0}, "labels")
    return out.select("sample_id", F.array_join("labels", ",").alias("labels"))


@query("p3_reduce_zero_label", pix_check("CASE WHEN gt IN (0,255) THEN 255 ELSE gt-1 END"))
def _(t):
    return check(pixels(t).withColumn("v", S.reduce_zero_label(F.col("gt"))), "v")


@query("p4_recode_identity", pix_check("CASE gt WHEN 1 THEN 3 WHEN 4 THEN 0 ELSE gt END"))
def _(t):
    return check(pixels(t).withColumn("v", S.lookup(F.col("gt"), {1: 3, 4: 0})), "v")


@query("p5_recode_default", pix_check("CASE gt WHEN 1 THEN 3 WHEN 4 THEN 0 ELSE 255 END"))
def _(t):
    table = t.region.select(F.col("r_regionkey").alias("old_id"), F.when(F.col("r_regionkey") == 1, 3).when(
        F.col("r_regionkey") == 4, 0).otherwise(255).alias("new_id"))
    return check(L.recode(pixels(t), table, "gt", 255), "gt")


@query("p6_densify_ids", "WITH v AS (SELECT k, ROW_NUMBER() OVER (ORDER BY k) - 1 d FROM (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus='F')) "
       "SELECT o_orderkey, d AS dense_id FROM orders JOIN v ON k = o_custkey")
def _(t):
    good, _ = L.densify_ids(t.orders.select("o_orderkey", "o_custkey"), t.orders.filter("o_orderstatus = 'F'"), "o_custkey")
    return good.select("o_orderkey", "dense_id")


@query("p6_densify_ids_unknown", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')")
def _(t):
    return L.densify_ids(t.orders.select("o_orderkey", "o_custkey"), t.orders.filter("o_orderstatus = 'F'"), "o_custkey")[1].select("o_orderkey", "o_custkey")


PAL = "pal AS (SELECT n_nationkey class_id, n_nationkey*7%256 r, n_nationkey*13%256 g, n_nationkey*29%256 b FROM nation)"


def palette(t):
    k = F.col("n_nationkey")
    return t.nation.select(k.alias("class_id"), (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"))


@query("p7_color_to_class", f"WITH {PAL}, c AS (SELECT p_partkey, p_size%30*7%256 r, p_size%30*13%256 g, p_size%30*29%256 b FROM part) "
       "SELECT p_partkey, COALESCE(class_id,0) class_id FROM c LEFT JOIN pal USING (r,g,b)")
def _(t):
    k = F.col("p_size") % 30
    px = t.part.select("p_partkey", (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"))
    return L.color_to_class(px, palette(t)).select("p_partkey", "class_id")


@query("p8_subset_palette", f"WITH {VOCAB}, {PAL} SELECT new_id AS class_id, r, g, b FROM pal JOIN lm ON old_id = class_id WHERE new_id <> 255")
def _(t):
    return L.subset_palette(palette(t), L.build_label_map(*vocab(t)))


@query("p8_random_palette")
def _(t):
    return L.random_palette(t.nation.select(F.col("n_nationkey").alias("class_id")))


@query("p9_binarize", f"WITH {BAND_PIXELS} SELECT sample_id, band, COUNT(*) n, {CHECK.replace('v *', '(CAST(value AS INT)//128) *')} checksum FROM band_pixels GROUP BY ALL")
def _(t):
    return check(band_pixels(t).withColumn("v", S.binarize(F.col("value"))), "v", "sample_id", "band")


@query("p10_fundus_grey", pix_check("CASE WHEN gt < 2 THEN 1 WHEN gt < 4 THEN 2 ELSE 0 END"))
def _(t):
    grey = F.when(F.col("gt") < 2, 0).when(F.col("gt") < 4, 128).otherwise(255)
    return check(pixels(t).withColumn("v", S.lookup(grey, S.FUNDUS_GREY)), "v")


@query("p11_organ_recode", "SELECT l_suppkey, COUNT(*) n, CAST(SUM(l_orderkey * CASE CAST(l_quantity AS INT)%14 WHEN 8 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 "
       "WHEN 6 THEN 5 WHEN 11 THEN 6 WHEN 1 THEN 7 WHEN 7 THEN 8 ELSE 0 END) AS BIGINT) checksum FROM lineitem GROUP BY l_suppkey")
def _(t):
    organ = S.lookup(F.col("l_quantity").cast("int") % 14, S.ORGAN_IDS, 0)
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey") * organ).alias("checksum"))


@query("p12_clip_rescale", "SELECT event_id, ROUND((LEAST(GREATEST(value*2-200,-125),275)+125)/400*255,6) v FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.clip_rescale(F.col("value") * 2 - 200), 6).alias("v"))


@query("p13_collapse_channels", f"""WITH {PIXELS}, ch AS (SELECT sample_id, y, x, unnest([0,1,2]) c, unnest([x%2, y%2, CASE WHEN gt=2 THEN 1 ELSE 0 END]) v FROM pixels),
l AS (SELECT sample_id, y, x, COALESCE((MAX(CASE WHEN v<>0 THEN c END)+1)%3, 0) v FROM ch GROUP BY ALL) SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM l GROUP BY sample_id""")
def _(t):
    ch = pixels(t).select("sample_id", "y", "x", F.posexplode(F.array(F.col("x") % 2, F.col("y") % 2, (F.col("gt") == 2).cast("int"))).alias("c", "v"))
    return check(L.collapse_channels(ch, ["sample_id", "y", "x"], "c", "v", n_channels=3), "label")


@query("p14_mask_ignore", pix_check("CASE WHEN gt IN (3,4) THEN 255 ELSE gt END"))
def _(t):
    return check(pixels(t).withColumn("v", S.mask_ignore(F.col("gt"), [3, 4])), "v")


@query("p15_swap_labels", pix_check("CASE gt WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE gt END"))
def _(t):
    return check(pixels(t).withColumn("v", S.swap_pairs(F.col("gt"), [(1, 2), (3, 4)])), "v")


@query("p16_class_masks", f"""WITH {PIXELS}, c AS (SELECT DISTINCT sample_id, gt class_id FROM pixels WHERE gt<>255)
SELECT p.sample_id, class_id, COUNT(*) n, CAST(SUM(CASE WHEN gt=class_id THEN (y*37+x*11+1) ELSE 0 END) AS BIGINT) checksum FROM pixels p JOIN c ON c.sample_id=p.sample_id GROUP BY ALL""")
def _(t):
    return check(L.class_masks(pixels(t), "sample_id", "gt"), "mask", "sample_id", "class_id")


TREE = "tree AS (SELECT n_nationkey class_id, n_regionkey parent_id FROM nation WHERE n_nationkey <> 7)"


@query("p47_rollup_labels", f"WITH {TREE} SELECT c_custkey, CAST(COALESCE(parent_id,255) AS INT) c_nationkey FROM customer LEFT JOIN tree ON class_id=c_nationkey")
def _(t):
    tree = t.nation.filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("class_id"), F.col("n_regionkey").alias("parent_id"))
    return L.rollup_labels(t.customer.select("c_custkey", "c_nationkey"), tree, "c_nationkey")


@query("p47_tree_counts", f"WITH {TREE} SELECT parent_id, c_nationkey, COUNT(*) pixels FROM customer JOIN tree ON class_id=c_nationkey GROUP BY ROLLUP (parent_id, c_nationkey)")
def _(t):
    tree = t.nation.filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("class_id"), F.col("n_regionkey").alias("parent_id"))
    return L.tree_counts(t.customer, tree, "c_nationkey")


@query("p45_unpack_label", f"""WITH {BAND_PIXELS}, b AS (SELECT *, CASE band WHEN 'R' THEN 0 WHEN 'G' THEN 1 ELSE 2 END c FROM band_pixels)
SELECT sample_id, COUNT(*) n, CAST(SUM(CAST(value AS BIGINT)*(y*37+x*11+1)) AS BIGINT) checksum FROM b WHERE c=2 GROUP BY sample_id""")
def _(t):
    b = band_pixels(t).withColumn("c", F.when(F.col("band") == "R", 0).when(F.col("band") == "G", 1).otherwise(2)).drop("band")
    return check(L.unpack_label(b, ["sample_id"], "c", "value")[1], "label")


@query("p44_scale_depth", "SELECT l_orderkey, ROUND(SUM(l_extendedprice*0.001),6) depth FROM lineitem GROUP BY l_orderkey")
def _(t):
    scaled = B.scale_depth(t.lineitem, 0.001, "l_extendedprice")
    return scaled.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 6).alias("depth"))


@query("s_clean_text", r"""SELECT doc_id, md5(trim(regexp_replace(lower(replace(replace(replace(replace(replace(text,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',chr(39)),'&amp;','&')), '\s+', ' ', 'g'))) AS md5 FROM documents""")
def _(t):
    from ..functions.scalars import clean_text
    return t.documents.select("doc_id", F.md5(clean_text(F.col("text"))).alias("md5"))


# --- dates and names -----------------------------------------------------------------------------
@query("p32_month_to_days", "SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(try_strptime(CAST(200000 + event_id % 1500 AS VARCHAR) || '01', '%Y%m%d') AS DATE)) AS days FROM events")
def _(t):
    return t.events.select("event_id", S.month_to_days(200000 + F.col("event_id") % 1500).cast("bigint").alias("days"))


@query("p33_dates_to_days", """SELECT o_orderkey, concat_ws(',', CAST(date_diff('day', DATE '2018-09-01', CAST(o_orderdate AS DATE)) AS VARCHAR),
CAST(date_diff('day', DATE '2018-09-01', CAST(o_orderdate AS DATE)) AS VARCHAR), 'bad') AS days FROM orders""")
def _(t):
    tokens = F.array(F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyMMdd"), F.lit("20241350"))
    days = F.transform(S.dates_to_days(tokens, "2018-09-01"), lambda d: F.coalesce(d.cast("string"), F.lit("bad")))
    return t.orders.select("o_orderkey", F.array_join(days, ",").alias("days"))


@query("p34_date_from_name", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS days FROM orders")
def _(t):
    name = F.concat(F.lit("/data/S2_"), F.when(F.col("o_orderkey") % 5 == 0, "nodate").otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
                    F.lit("T101010_x.tif"))
    return t.orders.select("o_orderkey", S.date_from_name(name, "_", 1).cast("bigint").alias("days"))


@query("p35_parse_name", r"""SELECT page_id, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.*?)(\.[^.]*)?$', 1) AS stem, CASE WHEN regexp_matches(b, '[0-9]') THEN substr(regexp_extract(b, '^([^0-9]*)[0-9]', 1), 1, CAST(GREATEST(length(regexp_extract(b, '^([^0-9]*)[0-9]', 1))-1,0) AS INT)) END AS scene, array_to_string(list_slice(string_split(b, '_'), 3, 4), '_') AS pair,
array_to_string(list_transform(regexp_extract_all(url, '([0-9]+)', 1), lambda s: CAST(s AS BIGINT)), ',') AS tiles FROM (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS b FROM (SELECT page_id, replace(replace(url, '?page=', '_9_'), '-', '_') AS url FROM pages))""")
def _(t):
    u = F.replace(F.replace("url", F.lit("?page="), F.lit("_9_")), F.lit("-"), F.lit("_"))
    return t.pages.select("page_id", S.stem(u).alias("stem"), S.scene_prefix(u).alias("scene"), S.tile_pair(u).alias("pair"),
                          F.array_join(S.tile_indices(u), ",").alias("tiles"))


AFF = "aff AS (SELECT s_suppkey, s_acctbal a, 100 + s_nationkey w, 50 + s_suppkey % 17 h FROM supplier)"


def _affine(t):
    a = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", (100 + F.col("s_nationkey")).alias("w"), (50 + F.col("s_suppkey") % 17).alias("h"),
                             F.array(a, F.lit(10.0), F.lit(0.5), a * 2, F.lit(-0.25), F.lit(-10.0)).alias("geo"))


@query("p36_center_xy", f"WITH {AFF} SELECT s_suppkey, ROUND(a + (w-1)/2*10.0 + (h-1)/2*0.5, 4) cx, ROUND(a*2 + (w-1)/2*-0.25 + (h-1)/2*-10.0, 4) cy FROM aff")
def _(t):
    cx, cy = S.center_xy(F.col("geo"), F.col("w"), F.col("h"))
    return _affine(t).select("s_suppkey", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("p37_scale_affine", f"WITH {AFF} SELECT s_suppkey, ROUND(a*(w/16), 7) a0, ROUND(10.0*(h/8), 7) a1, 0.5 AS a2, ROUND(a*2*(w/16), 7) a3, ROUND(-0.25*(h/8), 7) a4, -10.0 AS a5 FROM aff".replace("0.5 AS a2", "CAST(0.5 AS DOUBLE) AS a2").replace("-10.0 AS a5", "CAST(-10.0 AS DOUBLE) AS a5"))
def _(t):
    g = S.scale_affine(F.col("geo"), F.col("w") / 16, F.col("h") / 8)
    return _affine(t).select("s_suppkey", *[F.round(g[i], 7).alias(f"a{i}") for i in range(6)])


@query("p38_prompts", "SELECT n_nationkey AS class_id, t.tid AS template_id, replace(t.tpl, '{}', n_name) AS prompt FROM nation, "
       "(VALUES (0,'a photo of a {}.'),(1,'a bad photo of the {}.'),(2,'{} seen from above')) t(tid, tpl)")
def _(t):
    from ..operators.embeddings import prompts
    classes = t.nation.select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return prompts(["a photo of a {}.", "a bad photo of the {}.", "{} seen from above"], classes)


@query("p39_ensemble_prompts", """WITH u AS (SELECT label, unnest(range(64)) d, unnest(embedding) v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) n FROM embeddings),
m AS (SELECT label, d, AVG(CAST(v AS DOUBLE)/n) v FROM u GROUP BY ALL), z AS (SELECT label, sqrt(SUM(v*v)) z FROM m GROUP BY label)
SELECT label, array_to_string(list(CAST(ROUND(v/z*100000) AS BIGINT) ORDER BY d), ',') AS vec FROM m JOIN z USING (label) GROUP BY label""")
def _(t):
    from ..operators.embeddings import ensemble_prompts
    v = ensemble_prompts(t.embeddings, "label", "embedding")
    return v.select("label", F.array_join(F.transform("vec", lambda x: F.round(x * 100000).cast("bigint")), ",").alias("vec"))


@query("p40_l2_normalize", """SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CAST(ROUND(CAST(v AS DOUBLE)*3/sqrt(9*list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))*1000) AS BIGINT)), ',') AS vec FROM embeddings""")
def _(t):
    v = F.transform(V.as_double(F.col("embedding")), lambda x: x * 3)
    return t.embeddings.select("vec_id", F.array_join(F.transform(V.l2_normalize(v), lambda x: F.round(x * 1000).cast("bigint")), ",").alias("vec"))


@query("p41_decode_scores", f"""WITH {SCORES}, z AS (SELECT vec_id, ln(SUM(exp(s))) z FROM long GROUP BY vec_id), b AS (SELECT vec_id, class_id, s, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY s DESC, class_id) r FROM long)
SELECT b.vec_id, b.class_id AS pred, ROUND(exp(s - z), 6) prob, CASE WHEN 1/(1+exp(-sc.other[1])) > 0.52 THEN 1 ELSE 0 END AS binary_pred FROM b JOIN z USING (vec_id) JOIN scores sc USING (vec_id) WHERE r = 1""")
def _(t):
    from ..operators.embeddings import decode_scores
    df = decode_scores(scores(t), "scores", "pred", "prob")
    return r6(decode_scores(df.withColumn("one", F.slice("other", 1, 1)), "one", "binary_pred", threshold=0.52).select("vec_id", "pred", "prob", "binary_pred"))


@query("p42_linear_predict", """WITH w AS (SELECT label, unnest(range(64)) d, unnest(embedding) v FROM embeddings), m AS (SELECT label, d, AVG(CAST(v AS DOUBLE)) v FROM w GROUP BY ALL),
wt AS (SELECT label, list(v ORDER BY d) wv FROM m GROUP BY label), s AS (SELECT vec_id, w.label, list_dot_product(CAST(embedding AS DOUBLE[]), wv) + 0.01*w.label sc FROM embeddings e, wt w)
SELECT vec_id, label AS pred, ROUND(sc, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY sc DESC, label) r FROM s) WHERE r = 1""")
def _(t):
    from ..operators.embeddings import class_means, linear_predict
    w = class_means(t.embeddings, "label", "embedding").withColumn("bias", F.col("label") * 0.01)
    return r6(linear_predict(t.embeddings.select("vec_id", "embedding"), w, "embedding", "label").select("vec_id", "pred", "score"))


@query("p43_score", "SELECT vec_id, ROUND(list_sum(CAST(embedding AS DOUBLE[])),6) AS score FROM embeddings")
def _(t):
    from ..operators.scoring import score

    def make():
        def fn(pdf):
            import numpy as np
            m = np.stack(pdf["embedding"].to_numpy()).astype("float64")
            return pdf[["vec_id"]].assign(score=m.sum(axis=1))
        return fn
    return r6(score(t.embeddings.select("vec_id", "embedding"), make, "vec_id bigint, score double", batch_size=512))


# --- filters ---------------------------------------------------------------------------------------
@query("fl1_valid_rows", pix_check("pred", "WHERE gt <> 255"))
def _(t):
    return check(FL.valid_rows(pixels(t)), "pred")


@query("fl2_valid_rows_mask", pix_check("pred", "WHERE COALESCE(CASE WHEN x%3=0 THEN y%2=0 END, gt<>255)"))
def _(t):
    return check(FL.valid_rows(pixels(t).withColumn("ok", F.when(F.col("x") % 3 == 0, F.col("y") % 2 == 0)), mask="ok"), "pred")


@query("fl3_in_range", pix_check("LEAST(GREATEST(pred,0),2)", "WHERE gt BETWEEN 0 AND 2"))
def _(t):
    return check(FL.in_range(pixels(t), 3), "pred")


@query("fl4_depth_mask", pix_check("gt", "WHERE gt > 1 AND gt < 4 AND y BETWEEN 2 AND 7 AND x BETWEEN 3 AND 9"))
def _(t):
    return check(FL.depth_mask(pixels(t), 1, 4, (2, 7, 3, 9)), "gt")


@query("fl5_select_split", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr','de')")
def _(t):
    return FL.select_split(t.documents.select("doc_id", "lang"), "lang", ["fr", "de"])


NANV = "CASE WHEN l_quantity = 50 THEN 'nan'::DOUBLE WHEN l_discount = 0.1 AND l_quantity = 49 THEN 'inf'::DOUBLE ELSE l_quantity END"


@query("fl6_finite_samples", f"WITH b AS (SELECT l_orderkey, {NANV} v FROM lineitem), bad AS (SELECT DISTINCT l_orderkey FROM b WHERE isnan(v) OR isinf(v)) "
       "SELECT l_orderkey, SUM(v) total FROM b WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) GROUP BY l_orderkey")
def _(t):
    v = F.when(F.col("l_quantity") == 50, float("nan")).when((F.col("l_discount") == 0.1) & (F.col("l_quantity") == 49), float("inf")).otherwise(F.col("l_quantity"))
    return FL.finite_samples(t.lineitem.select("l_orderkey", v.alias("v")), "l_orderkey", "v").groupBy("l_orderkey").agg(F.sum("v").alias("total"))


@query("fl7_check_vectors", "SELECT vec_id, CASE WHEN label = 3 THEN 'null' WHEN label = 5 THEN 'non_finite' ELSE 'zero_norm' END AS rule FROM embeddings WHERE label IN (3,5,7)")
def _(t):
    e, y = F.col("embedding"), F.col("label")
    v = F.when(y == 5, F.transform(e, lambda x, i: F.when(i == 9, float("nan")).otherwise(x))).when(
        y == 7, F.transform(e, lambda x: x * 0)).when(y != 3, e)
    return FL.check_vectors(t.embeddings.select("vec_id", v.alias("v")), "vec_id", "v")


@query("fl8_valid_obs", "SELECT l_orderkey, l_shipdate FROM lineitem GROUP BY ALL HAVING bool_or(l_discount <> 0) OR bool_or(l_tax <> 0)")
def _(t):
    long = t.lineitem.select("l_orderkey", "l_shipdate", F.explode(F.array("l_discount", "l_tax")).alias("value"))
    return FL.valid_obs(long, ["l_orderkey", "l_shipdate"])


@query("fl9_take_first", "SELECT doc_id FROM documents ORDER BY source, doc_id LIMIT 25")
def _(t):
    return FL.take(t.documents.select("source", "doc_id"), ["source", "doc_id"], 25).select("doc_id")


@query("fl9_take_indices", "SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY source, doc_id) - 1 i FROM documents) WHERE i IN (0, 7, 99, 150)")
def _(t):
    return FL.take(t.documents.select("source", "doc_id"), ["source", "doc_id"], [0, 7, 99, 150]).select("doc_id")


@query("fl10_legal_labels", f"WITH {PIXELS} SELECT DISTINCT sample_id, gt FROM pixels WHERE gt BETWEEN 0 AND 3")
def _(t):
    return FL.legal_labels(pixels(t), 4, "gt", ["sample_id"])


@query("fl11_scan_logs", "SELECT event_id FROM events WHERE regexp_matches(event_type || ' ' || props, 'error.*[13579]\\}') ORDER BY event_id LIMIT 20")
def _(t):
    lines = t.events.select("event_id", F.concat_ws(" ", "event_type", "props").alias("line"))
    return FL.scan_logs(lines, r"error.*[13579]\}", "line", ["event_id"]).select("event_id")


@query("fl11_completed", "SELECT user_id, bool_or(contains(event_type || ' ' || props, 'signup {\"k\": 9')) completed FROM events GROUP BY user_id")
def _(t):
    lines = t.events.select("user_id", F.concat_ws(" ", "event_type", "props").alias("line"))
    return FL.completed(lines, 'signup {"k": 9', "line", ["user_id"])
