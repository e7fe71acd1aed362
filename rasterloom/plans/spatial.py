"""Queries over tiles, pixel geometry, instance masks and boxes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G, labels as L, masks as K, tiles as T
from ..session import spread
from . import reports as P
from .inputs import BLOBS, PIXELS, RASTERS, SCORES, blobs, grid, pixels, rasters, scores
from .recoding import CHECK, check, pix_check
from .registry import query
from .scoring import r6

# larger rasters for grids: one per part, 30..79 wide and 25..74 high
RS = "rs AS (SELECT p_partkey AS raster_id, CAST(30 + p_size AS INT) AS width, CAST(25 + p_partkey % 50 AS INT) AS height FROM part)"


def rs(t):
    return spread(t.part).select(F.col("p_partkey").alias("raster_id"), (30 + F.col("p_size")).cast("int").alias("width"), (25 + F.col("p_partkey") % 50).cast("int").alias("height"))


G1 = f"""WITH {RS}, ys AS (SELECT *, unnest(range(0, height, 20)) y FROM rs), g AS (SELECT *, unnest(range(0, width, 20)) x FROM ys),
b AS (SELECT *, CASE WHEN x+28>=width THEN width-28 ELSE x END x0, CASE WHEN y+28>=height THEN height-28 ELSE y END y0 FROM g)
SELECT raster_id, CAST((y//20)*((width+19)//20)+x//20 AS INT) tile_no, CAST(x0 AS INT) x0, CAST(y0 AS INT) y0, 28 AS w, 28 AS h, CASE WHEN x0=0 THEN 0 ELSE 4 END crop_x, CASE WHEN y0=0 THEN 0 ELSE 4 END crop_y,
CASE WHEN x+28>=width THEN 28 ELSE 28-CASE WHEN x0=0 THEN 0 ELSE 4 END END crop_w, CASE WHEN y+28>=height THEN 28 ELSE 28-CASE WHEN y0=0 THEN 0 ELSE 4 END END crop_h, width, height FROM b"""


@query("g1_grid_centered", G1)
def _(t):
    return T.grid_centered(rs(t), 28, 20)


STRICT = RS + """, fit AS (SELECT * FROM rs WHERE width>=28 AND height>=28), xs AS (SELECT raster_id, x, ROW_NUMBER() OVER (PARTITION BY raster_id ORDER BY x)-1 ix, COUNT(*) OVER (PARTITION BY raster_id) nx
 FROM (SELECT raster_id, unnest(range(0, width-27, 20)) x FROM fit UNION SELECT raster_id, width-28 FROM fit)),
ys AS (SELECT raster_id, y, ROW_NUMBER() OVER (PARTITION BY raster_id ORDER BY y)-1 iy FROM (SELECT raster_id, unnest(range(0, height-27, 20)) y FROM fit UNION SELECT raster_id, height-28 FROM fit)),
tl AS (SELECT raster_id, CAST(iy*nx+ix AS INT) tile_no, CAST(x AS INT) x0, CAST(y AS INT) y0, 28 AS w, 28 AS h, CASE WHEN x=0 THEN 0 ELSE 4 END crop_x, CASE WHEN y=0 THEN 0 ELSE 4 END crop_y,
 CAST(28-CASE WHEN x=0 THEN 0 ELSE 4 END AS INT) crop_w, CAST(28-CASE WHEN y=0 THEN 0 ELSE 4 END AS INT) crop_h, width, height FROM fit JOIN xs USING (raster_id) JOIN ys USING (raster_id))"""


@query("g2_grid_strict", f"WITH {STRICT} SELECT * FROM tl")
def _(t):
    return T.grid_strict(rs(t), 28, 20)


@query("g2_too_small", f"WITH {RS} SELECT * FROM rs WHERE width<28 OR height<28")
def _(t):
    return T.too_small(rs(t), 28)


@query("g6_slide_grid", f"""WITH {RS}, g AS (SELECT *, unnest(range(0, GREATEST(width-40+24,0)//25+1)) i FROM (SELECT *, unnest(range(0, GREATEST(height-40+24,0)//25+1)) j FROM rs)),
b AS (SELECT *, GREATEST(LEAST(i*25+40,width)-40,0) x0, GREATEST(LEAST(j*25+40,height)-40,0) y0, GREATEST(width-40+24,0)//25+1 nx FROM g)
SELECT raster_id, CAST(j*nx+i AS INT) tile_no, CAST(x0 AS INT) x0, CAST(y0 AS INT) y0, CAST(LEAST(40,width-x0) AS INT) w, CAST(LEAST(40,height-y0) AS INT) h, width, height FROM b""")
def _(t):
    return T.slide_grid(rs(t), 40, 25)


CLIP = RS + """, b AS (SELECT DISTINCT raster_id, width, height, GREATEST(LEAST(i*{s},width-32),0) x0, GREATEST(LEAST(j*{s},height-32),0) y0 FROM (SELECT *, unnest(range(0, GREATEST(CAST(ceil((width-32)/20) AS INT),0)+1)) i FROM
 (SELECT *, unnest(range(0, GREATEST(CAST(ceil((height-32)/20) AS INT),0)+1)) j FROM rs)))
SELECT raster_id, CAST(x0 AS INT) x0, CAST(y0 AS INT) y0, CAST(LEAST(32,width-x0) AS INT) w, CAST(LEAST(32,height-y0) AS INT) h FROM b"""


@query("g5_clip_grid", "WITH " + CLIP.format(s=20))
def _(t):
    return T.clip_grid(rs(t), 32, 20).select("raster_id", "x0", "y0", "w", "h")


@query("g5_clip_grid_legacy", "WITH " + CLIP.format(s=32))
def _(t):
    return T.clip_grid(rs(t), 32, 20, legacy=True).select("raster_id", "x0", "y0", "w", "h")


SC = PIXELS + """, dm AS (SELECT sample_id, h, w, CASE WHEN h<12 AND w<>12 THEN 12 ELSE h END ph, CASE WHEN w<12 AND h<>12 THEN 12 ELSE w END pw FROM rasters),
tl AS (SELECT DISTINCT sample_id, h, w, ph, pw, GREATEST(LEAST(y,ph-12),0) y0, GREATEST(LEAST(x,pw-12),0) x0 FROM (SELECT *, unnest(range(0,pw,8)) x FROM (SELECT *, unnest(range(0,ph,8)) y FROM dm))),
tp AS (SELECT *, unnest(range(0, LEAST(x0+12,pw)-x0)) tx FROM (SELECT *, unnest(range(0, LEAST(y0+12,ph)-y0)) ty FROM tl))"""


@query("g3_slide_crop", f"""WITH {SC} SELECT tp.sample_id || '_' || y0 || '_' || LEAST(y0+12,ph) || '_' || x0 || '_' || LEAST(x0+12,pw) AS name, COUNT(*) n, CAST(SUM(COALESCE(p.gt,255)*(ty*37+tx*11+1)) AS BIGINT) checksum
FROM tp LEFT JOIN pixels p ON p.sample_id=tp.sample_id AND p.y=y0+ty AND p.x=x0+tx GROUP BY ALL""")
def _(t):
    px = pixels(t).withColumnRenamed("sample_id", "raster_id").select("raster_id", "y", "x", F.col("gt").alias("label"))
    r = rasters(t).select(F.col("sample_id").alias("raster_id"), F.col("w").alias("width"), F.col("h").alias("height"))
    return check(T.slide_crop(px, r, 12, 4), "label", "name")


@query("j7_crop_tiles", f"""WITH {PIXELS}, tl AS (SELECT DISTINCT sample_id, GREATEST(LEAST(y,h-6),0) y0, GREATEST(LEAST(x,w-6),0) x0 FROM (SELECT *, unnest(range(0,w-2,4)) x FROM (SELECT *, unnest(range(0,h-2,4)) y FROM rasters)))
SELECT p.sample_id AS raster_id, CAST(y0 AS INT) y0, CAST(x0 AS INT) x0, COUNT(*) n, CAST(SUM(gt*(p.y*37+p.x*11+1)) AS BIGINT) checksum FROM pixels p JOIN tl ON tl.sample_id=p.sample_id AND p.y>=y0 AND p.y<y0+6 AND p.x>=x0 AND p.x<x0+6 GROUP BY ALL""")
def _(t):
    r = rasters(t).select(F.col("sample_id").alias("raster_id"), F.col("w").alias("width"), F.col("h").alias("height"))
    tiles = T.slide_grid(r, 6, 4)
    px = pixels(t).select(F.col("sample_id").alias("raster_id"), "y", "x", "gt")
    return check(T.crop_tiles(px, tiles, 6), "gt", "raster_id", "y0", "x0")


FT = """rf AS (SELECT p_partkey AS raster_id, CAST(32 + 4*(p_size%9) AS INT) AS width, CAST(24 + 4*(p_partkey%11) AS INT) AS height FROM part),
xs AS (SELECT raster_id, x, ROW_NUMBER() OVER (PARTITION BY raster_id ORDER BY x)-1 ix, COUNT(*) OVER (PARTITION BY raster_id) nx FROM (SELECT raster_id, unnest(range(0, width-31, 24)) x FROM rf WHERE width>32 UNION SELECT raster_id, GREATEST(width-32,0) FROM rf)),
ys AS (SELECT raster_id, y, ROW_NUMBER() OVER (PARTITION BY raster_id ORDER BY y)-1 iy FROM (SELECT raster_id, unnest(range(0, height-31, 24)) y FROM rf WHERE height>32 UNION SELECT raster_id, GREATEST(height-32,0) FROM rf)),
ft AS (SELECT raster_id, CAST(iy*nx+ix AS INT) tile_no, CAST(x AS INT) x0, CAST(y AS INT) y0, CAST(LEAST(32,width-x) AS INT) w, CAST(LEAST(32,height-y) AS INT) h, width, height FROM rf JOIN xs USING (raster_id) JOIN ys USING (raster_id)),
ov AS (SELECT *, GREATEST(0,COALESCE(LAG(x0+w) OVER r-x0,0)) "left", GREATEST(0,COALESCE(x0+w-LEAD(x0) OVER r,0)) "right", GREATEST(0,COALESCE(LAG(y0+h) OVER c-y0,0)) "top", GREATEST(0,COALESCE(y0+h-LEAD(y0) OVER c,0)) bottom
 FROM ft WINDOW r AS (PARTITION BY raster_id, y0 ORDER BY x0), c AS (PARTITION BY raster_id, x0 ORDER BY y0))"""


def rf(t):
    return spread(t.part).select(F.col("p_partkey").alias("raster_id"), (32 + 4 * (F.col("p_size") % 9)).cast("int").alias("width"), (24 + 4 * (F.col("p_partkey") % 11)).cast("int").alias("height"))


@query("g20_feature_tiles", f"WITH {FT} SELECT * FROM ft")
def _(t):
    return T.feature_tiles(rf(t), 32, 0.25, 4)


@query("g20_indivisible", f"WITH {RS} SELECT * FROM rs WHERE width%4<>0 OR height%4<>0")
def _(t):
    return T.indivisible(rs(t), 4)


@query("j8_tile_overlaps", f"WITH {FT} SELECT * FROM ov")
def _(t):
    return T.tile_overlaps(T.feature_tiles(rf(t), 32, 0.25, 4))


BLEND = f"""WITH {FT}, f AS (SELECT raster_id, tile_no, x0//4 x0, y0//4 y0, w//4 w, h//4 h, width//4 fw, height//4 fh, "left"//4 l, "right"//4 r, "top"//4 tp, bottom//4 bt FROM ov),
p AS (SELECT *, unnest(range(w)) x FROM (SELECT *, unnest(range(h)) y FROM f)),
q AS (SELECT *, LEAST(CASE WHEN l>0 AND x0<>0 AND x<l THEN CASE WHEN l=1 THEN 0.5 ELSE 1.0/(l+1)+x*(1-1.0/(l+1))/(l-1) END ELSE 1.0 END, CASE WHEN r>0 AND x0+w<>fw AND x>=w-r THEN CASE WHEN r=1 THEN 1.0 ELSE 1+(x-(w-r))*(1.0/(r+1)-1)/(r-1) END ELSE 1.0 END)
 * LEAST(CASE WHEN tp>0 AND y0<>0 AND y<tp THEN CASE WHEN tp=1 THEN 0.5 ELSE 1.0/(tp+1)+y*(1-1.0/(tp+1))/(tp-1) END ELSE 1.0 END, CASE WHEN bt>0 AND y0+h<>fh AND y>=h-bt THEN CASE WHEN bt=1 THEN 1.0 ELSE 1+(y-(h-bt))*(1.0/(bt+1)-1)/(bt-1) END ELSE 1.0 END) wt FROM p)
SELECT raster_id, CAST(y+y0 AS BIGINT) y, CAST(x+x0 AS BIGINT) x, 0 AS class_id, ROUND(SUM(wt*(tile_no*10+y+x))/GREATEST(SUM(wt),1e-6),6) AS value FROM q GROUP BY ALL"""


@query("a32_blend_tiles", BLEND)
def _(t):
    ov = T.feature_overlaps(rf(t), 32, 0.25, 4)
    v = ov.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("h") / 4).cast("int") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("w") / 4).cast("int") - 1)))
    v = v.select("raster_id", "y", "x", F.lit(0).alias("class_id"), (F.col("tile_no") * 10 + F.col("y") + F.col("x")).cast("double").alias("value"), *T.TILE_FACTS)
    return r6(T.blend_carried(v, 4))


@query("a31_merge_windows", f"""WITH {PIXELS}, tl AS (SELECT DISTINCT sample_id, GREATEST(LEAST(y,h-6),0) y0, GREATEST(LEAST(x,w-6),0) x0 FROM (SELECT *, unnest(range(0,w-2,4)) x FROM (SELECT *, unnest(range(0,h-2,4)) y FROM rasters))),
m AS (SELECT p.sample_id, p.y, p.x, SUM(pred+y0*0.5+x0*0.25)/COUNT(*) AS value, COUNT(*) windows FROM pixels p JOIN tl ON tl.sample_id=p.sample_id AND p.y>=y0 AND p.y<y0+6 AND p.x>=x0 AND p.x<x0+6 GROUP BY ALL)
SELECT sample_id AS raster_id, COUNT(*) n, SUM(windows)::BIGINT AS windows, ROUND(SUM(value*(y+1)),4) total FROM m GROUP BY sample_id""")
def _(t):
    r = rasters(t).select(F.col("sample_id").alias("raster_id"), F.col("w").alias("width"), F.col("h").alias("height"))
    px = pixels(t).select(F.col("sample_id").alias("raster_id"), "y", "x", "pred")
    cut = T.crop_tiles(px, T.slide_grid(r, 6, 4), 6).withColumn("value", F.col("pred") + F.col("y0") * 0.5 + F.col("x0") * 0.25)
    m = T.merge_windows(cut, ["raster_id", "y", "x"])
    return m.groupBy("raster_id").agg(F.count("*").alias("n"), F.sum("windows").alias("windows"), F.round(F.sum(F.col("value") * (F.col("y") + 1)), 4).alias("total"))


VIEWS = SCORES + """, vw AS (SELECT vec_id//3 AS item, class_id, {f} p FROM long {j}), av AS (SELECT item, class_id, AVG(p) p FROM vw GROUP BY ALL)
SELECT item, class_id AS pred, ROUND(p,6) p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY p DESC, class_id) r FROM av) WHERE r=1"""


def _views(t):
    return scores(t).withColumn("item", F.floor(F.col("vec_id") / 3))


@query("a33_merge_views", "WITH " + VIEWS.format(f="exp(s)/z", j="JOIN (SELECT vec_id, SUM(exp(s)) z FROM long GROUP BY vec_id) USING (vec_id)"))
def _(t):
    return r6(T.merge_views(_views(t), ["item"], "scores"))


@query("a33_merge_views_binary", f"WITH {SCORES}, b AS (SELECT vec_id//3 AS item, AVG(1/(1+exp(-scores[1]))) p FROM scores GROUP BY 1) SELECT item, CASE WHEN p>0.5 THEN 1 ELSE 0 END pred, ROUND(p,6) p FROM b")
def _(t):
    return r6(T.merge_views(_views(t), ["item"], "scores", threshold=0.5))


@query("a34_mean_logits", "WITH " + VIEWS.format(f="s", j=""))
def _(t):
    return r6(T.mean_logits(_views(t), ["item"], "scores"))


@query("g19_stitch", f"""WITH {STRICT}, p AS (SELECT *, unnest(range(crop_x, crop_x+crop_w)) x FROM (SELECT *, unnest(range(crop_y, crop_y+crop_h)) y FROM tl)),
m AS (SELECT raster_id, y+y0 yy, x+x0 xx, arg_max(tile_no*100+y*3+x, tile_no) l FROM p GROUP BY ALL) SELECT raster_id, COUNT(*) n, CAST(SUM(l*(yy*37+xx*11+1)) AS BIGINT) checksum FROM m GROUP BY raster_id""")
def _(t):
    tiles = T.owned_boxes(T.grid_strict(rs(t), 28, 20))
    v = tiles.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(27)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(27))))
    v = v.select("raster_id", "y", "x", (F.col("tile_no") * 100 + F.col("y") * 3 + F.col("x")).alias("label"), *T.BOX)
    return check(T.stitch_carried(v), "label", "raster_id")


def _pixel_model(stride, value):
    """A stand-in model: one row per (strided) pixel of each tile."""
    def make():
        def fn(pdf):
            import numpy as np
            import pandas as pd
            h, w = pdf["h"].to_numpy() // stride, pdf["w"].to_numpy() // stride
            n = h * w
            at = np.repeat(np.arange(len(pdf)), n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            y, x, tile = i // w[at], i % w[at], pdf["tile_no"].to_numpy()[at]
            return pd.DataFrame({"raster_id": pdf["raster_id"].to_numpy()[at], "tile_no": tile, "y": y, "x": x, **value(tile, y, x)})
        return fn
    return make


@query("m9_extract_tiled", BLEND)
def _(t):
    make = _pixel_model(4, lambda n, y, x: {"class_id": 0, "value": n * 10.0 + y + x})
    return r6(P.extract_tiled(rf(t), make, "raster_id bigint, tile_no int, y int, x int, class_id int, value double", 32, 0.25, 4))


@query("m10_infer_raster", f"""WITH {STRICT}, p AS (SELECT *, unnest(range(crop_x, crop_x+crop_w)) x FROM (SELECT *, unnest(range(crop_y, crop_y+crop_h)) y FROM tl)),
m AS (SELECT raster_id, y+y0 yy, x+x0 xx, arg_max((tile_no+y+x)%5, tile_no) l FROM p GROUP BY ALL) SELECT raster_id, COUNT(*) n, CAST(SUM(l*(yy*37+xx*11+1)) AS BIGINT) checksum FROM m GROUP BY raster_id""")
def _(t):
    make = _pixel_model(1, lambda n, y, x: {"label": (n + y + x) % 5})
    out = P.infer_raster(rs(t), make, "raster_id bigint, tile_no int, y int, x int, label int", 28, 20)
    return check(out, "label", "raster_id")


@query("m10_infer_with_rejects", f"""WITH {STRICT}, p AS (SELECT *, unnest(range(crop_x, crop_x+crop_w)) x FROM (SELECT *, unnest(range(crop_y, crop_y+crop_h)) y FROM tl)),
m AS (SELECT raster_id, y+y0 yy, x+x0 xx, arg_max((tile_no+y+x)%5, tile_no) l FROM p GROUP BY ALL), c AS (SELECT raster_id, COUNT(*) n, SUM(l*(yy*37+xx*11+1)) s FROM m GROUP BY raster_id)
SELECT raster_id, CASE WHEN width<28 OR height<28 THEN 'rejected' ELSE 'accepted' END kind, CASE WHEN width<28 OR height<28 THEN 'too_small' END reject, COALESCE(n, 0) n, CAST(COALESCE(s, 0) AS BIGINT) checksum
FROM rs LEFT JOIN c USING (raster_id)""")
def _(t):
    make = _pixel_model(1, lambda n, y, x: {"label": (n + y + x) % 5})
    out = P.with_rejects(rs(t), lambda ok: P.infer_raster(ok, make, "raster_id bigint, tile_no int, y int, x int, label int", 28, 20), window=28)
    sums = [F.count("y").alias("n"), F.coalesce(F.sum(F.col("label") * (F.col("y") * 37 + F.col("x") * 11 + 1)), F.lit(0)).cast("bigint").alias("checksum")]
    return out.groupBy("raster_id", "kind", "reject").agg(*sums)


@query("m9_extract_with_rejects", """WITH rs AS (SELECT p_partkey AS raster_id, 30 + p_size AS width, 25 + p_partkey % 50 AS height FROM part)
SELECT raster_id, CASE WHEN width%4<>0 OR height%4<>0 THEN 'rejected' ELSE 'accepted' END kind, CASE WHEN width%4<>0 OR height%4<>0 THEN 'indivisible' END reject,
CAST(CASE WHEN width%4<>0 OR height%4<>0 THEN 0 ELSE (width//4)*(height//4) END AS BIGINT) n FROM rs""")
def _(t):
    make = _pixel_model(4, lambda n, y, x: {"class_id": 0, "value": n * 10.0 + y + x})
    out = P.with_rejects(rs(t), lambda ok: P.extract_tiled(ok, make, "raster_id bigint, tile_no int, y int, x int, class_id int, value double", 32, 0.25, 4), stride=4)
    return out.groupBy("raster_id", "kind", "reject").agg(F.count("y").alias("n"))


# --- geometry ------------------------------------------------------------------------------------------
def gq(select, where=""):
    """Checksum of gt after moving pixels: select gives y, x, v."""
    return f"WITH {PIXELS} SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM (SELECT sample_id, {select} FROM pixels {where}) GROUP BY sample_id"


@query("g4_flip_horizontal", gq("y, w-1-x AS x, gt AS v"))
def _(t):
    return check(G.flip(pixels(t)), "gt")


@query("g4_flip_diagonal", gq("h-1-y AS y, w-1-x AS x, gt AS v"))
def _(t):
    return check(G.flip(pixels(t), "diagonal"), "gt")


@query("g10_rot90", gq("w-1-x AS y, y AS x, gt AS v"))
def _(t):
    return check(G.rot90(pixels(t), 1), "gt")


@query("g10_rot270_flip", gq("x AS y, h-1-(h-1-y) AS x, gt AS v"))
def _(t):
    return check(G.flip(G.rot90(pixels(t), 3)), "gt")


@query("g8_crop", gq("y-2 AS y, x-1 AS x, gt AS v", "WHERE y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 6"))
def _(t):
    return check(G.crop(pixels(t), 2, 1, 5, 6), "gt")


@query("g8_center_crop", gq("y-(h-9)//2 AS y, x-(w-9)//2 AS x, gt AS v", "WHERE h>=9 AND w>=9 AND y>=(h-9)//2 AND y<(h-9)//2+9 AND x>=(w-9)//2 AND x<(w-9)//2+9"))
def _(t):
    return check(G.center_crop(pixels(t), 9), "gt")


@query("g8_crop_too_large", f"WITH {RASTERS} SELECT * FROM rasters WHERE h<9 OR w<9")
def _(t):
    return G.crop_too_large(rasters(t), 9, 9)


@query("g22_crop_ratio", gq("y-CAST(round_even(h*0.2,0) AS INT) AS y, x-CAST(round_even(w*0.1,0) AS INT) AS x, gt AS v", "WHERE y>=round_even(h*0.2,0) AND y<round_even(h*0.2,0)+round_even(h*0.5,0) AND x>=round_even(w*0.1,0) AND x<round_even(w*0.1,0)+round_even(w*0.6,0)"))
def _(t):
    return check(G.crop_ratio(pixels(t), (0.2, 0.1), (0.5, 0.6)), "gt")


@query("g23_cut_padding", gq("y-1 AS y, x-sample_id%2 AS x, gt AS v", "WHERE y>=1 AND y<h-1 AND x>=sample_id%2 AND x<w-2"))
def _(t):
    px = pixels(t).withColumn("pl", (F.col("sample_id") % 2).cast("int")).withColumn("pr", F.lit(2)).withColumn("pt", F.lit(1)).withColumn("pb", F.lit(1))
    return check(G.cut_padding(px, "pl", "pr", "pt", "pb"), "gt")


def padq(sy, sx):
    return f"""WITH {PIXELS}, tg AS (SELECT sample_id, h, w, {sy} sy, {sx} sx, CAST(i//12 AS INT) y, CAST(i%12 AS INT) x FROM (SELECT *, unnest(range(144)) i FROM rasters)),
j AS (SELECT tg.sample_id, tg.y, tg.x, COALESCE(p.gt,255) AS v, COALESCE(p.pred,0) AS v2 FROM tg LEFT JOIN pixels p ON p.sample_id=tg.sample_id AND p.y=tg.y-sy AND p.x=tg.x-sx)
SELECT sample_id, COUNT(*) n, {CHECK} checksum, CAST(SUM(v2) AS BIGINT) preds FROM j GROUP BY sample_id"""


def pad_check(df):
    return df.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.col("gt").cast("bigint") * (F.col("y") * 37 + F.col("x") * 11 + 1)).alias("checksum"), F.sum("pred").alias("preds"))


@query("g7_pad_right_bottom", padq("0", "0"))
def _(t):
    return pad_check(G.pad_to(pixels(t), rasters(t), 12, 12, {"gt": 255, "pred": 0}))


@query("g7_pad_center", padq("CAST(floor((12-h)/2.0) AS INT)", "CAST(floor((12-w)/2.0) AS INT)"))
def _(t):
    return pad_check(G.pad_to(pixels(t), rasters(t), 12, 12, {"gt": 255, "pred": 0}, "center"))


def resq(h, w):
    return f"""WITH {PIXELS}, tg AS (SELECT sample_id, h, w, CAST(unnest(range({w})) AS INT) x, y FROM (SELECT *, CAST(unnest(range({h})) AS INT) y FROM rasters)),
j AS (SELECT tg.sample_id, tg.y, tg.x, p.gt AS v FROM (SELECT *, y*h//({h}) sy, x*w//({w}) sx FROM tg) tg JOIN pixels p ON p.sample_id=tg.sample_id AND p.y=tg.sy AND p.x=tg.sx) SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM j GROUP BY sample_id"""


@query("g11_resize_up", resq("23", "17"))
def _(t):
    return check(G.resize_nearest(pixels(t), 23, 17), "gt")


@query("g11_rescale_down", resq("CAST(floor(h*0.5) AS INT)", "CAST(floor(w*0.7) AS INT)"))
def _(t):
    return check(G.resize_nearest(pixels(t), F.floor(F.col("h") * 0.5), F.floor(F.col("w") * 0.7)), "gt")


@query("g12_short_edge_size", f"""WITH {RS}, s AS (SELECT *, CASE WHEN height<width THEN 40.0 ELSE 40.0/LEAST(height,width)*height END nh, CASE WHEN height<width THEN 40.0/LEAST(height,width)*width ELSE 40.0 END nw FROM rs)
SELECT raster_id, CAST(floor(nh*LEAST(1.0,70.0/GREATEST(nh,nw))+0.5) AS INT) new_h, CAST(floor(nw*LEAST(1.0,70.0/GREATEST(nh,nw))+0.5) AS INT) new_w FROM s""".replace("40.0", "40.0::DOUBLE").replace("70.0", "70.0::DOUBLE"))
def _(t):
    r = rs(t).withColumnRenamed("height", "h").withColumnRenamed("width", "w")
    return G.short_edge_size(r, 40, 70).select("raster_id", "new_h", "new_w")


@query("a38_pad_shapes", f"WITH {RS} SELECT raster_id, CAST(ceil(MAX(height) OVER (PARTITION BY raster_id//16)/32)*32 AS INT) pad_h, CAST(ceil(MAX(width) OVER (PARTITION BY raster_id//16)/32)*32 AS INT) pad_w FROM rs")
def _(t):
    r = rs(t).select("raster_id", F.col("height").alias("h"), F.col("width").alias("w"), F.floor(F.col("raster_id") / 16).alias("batch"))
    return G.pad_shapes(r, "batch", 32).select("raster_id", "pad_h", "pad_w")


@query("g14_cutout", gq("y, x, CASE WHEN (x BETWEEN sample_id%5 AND sample_id%5+2 AND y BETWEEN 1 AND 3) OR (x BETWEEN 4 AND 6 AND y BETWEEN 2 AND 5) THEN 255 ELSE gt END AS v"))
def _(t):
    b = t.part.select(F.col("p_partkey").alias("sample_id"), F.inline(F.array(
        F.struct((F.col("p_partkey") % 5).cast("int").alias("x1"), F.lit(1).alias("y1"), (F.col("p_partkey") % 5 + 3).cast("int").alias("x2"), F.lit(4).alias("y2")),
        F.struct(F.lit(4).alias("x1"), F.lit(2).alias("y1"), F.lit(7).alias("x2"), F.lit(6).alias("y2")))))
    return check(G.cutout(pixels(t), b, {"gt": 255}, cell=4), "gt")


RCROP = PIXELS + """, tried AS (SELECT sample_id, t, least(h, 9) bh, least(w, 9) bw,
 CAST(('0x' || substr(md5('3:' || sample_id || ':' || t || ':y'), 1, 8))::BIGINT % (h - least(h, 9) + 1) AS INT) oy,
 CAST(('0x' || substr(md5('3:' || sample_id || ':' || t || ':x'), 1, 8))::BIGINT % (w - least(w, 9) + 1) AS INT) ox FROM rasters, (SELECT unnest(range(10)) t)),
 cl AS (SELECT sample_id, t, gt, COUNT(*) c FROM pixels JOIN tried USING (sample_id) WHERE y>=oy AND y<oy+bh AND x>=ox AND x<ox+bw AND gt<>255 GROUP BY ALL),
 okt AS (SELECT sample_id, t, COUNT(*)>1 AND MAX(c)/SUM(c)<0.4 ok FROM cl GROUP BY ALL),
 pick AS (SELECT sample_id, arg_min(t, CASE WHEN ok THEN t ELSE 100-t END) t FROM okt GROUP BY ALL),
 got AS (SELECT sample_id, p.y-oy AS y, p.x-ox AS x, gt AS v FROM pixels p JOIN tried USING (sample_id) JOIN pick USING (sample_id, t) WHERE p.y>=oy AND p.y<oy+bh AND p.x>=ox AND p.x<ox+bw)"""


@query("g9_random_crop", f"WITH {RCROP} SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM got GROUP BY sample_id")
def _(t):
    return check(G.random_crop(pixels(t), 9, 0.4, "gt", seed=3, cell=4), "gt")


MOS = PIXELS + """, n AS (SELECT COUNT(*) n FROM part), mem AS (SELECT p_partkey sample_id, CAST(s AS INT) slot, CASE WHEN s=0 THEN p_partkey ELSE (p_partkey*7+s*13)%n END src FROM part, n, (SELECT unnest(range(4)) s)),
dm AS (SELECT sample_id, h, w, CAST(floor(h*LEAST(10.0::DOUBLE/h,12.0::DOUBLE/w)) AS INT) nh, CAST(floor(w*LEAST(10.0::DOUBLE/h,12.0::DOUBLE/w)) AS INT) nw FROM rasters),
rz AS (SELECT d.sample_id src, nh, nw, y, x, h, w FROM (SELECT *, unnest(range(nw)) x FROM (SELECT *, unnest(range(nh)) y FROM dm)) d),
rp AS (SELECT src, nh, nw, rz.y, rz.x, p.gt FROM rz JOIN pixels p ON p.sample_id=src AND p.y=rz.y*rz.h//nh AND p.x=rz.x*rz.w//nw),
ps AS (SELECT m.sample_id, CASE WHEN slot IN (0,2) THEN x+11-nw ELSE x+11 END x, CASE WHEN slot IN (0,1) THEN y+9-nh ELSE y+9 END y, gt FROM mem m JOIN rp USING (src)),
cv AS (SELECT sample_id, CAST(i//24 AS INT) y, CAST(i%24 AS INT) x FROM (SELECT sample_id, unnest(range(480)) i FROM rasters)), j AS (SELECT cv.sample_id, cv.y, cv.x, COALESCE(ps.gt,255) AS v FROM cv LEFT JOIN ps ON ps.sample_id=cv.sample_id AND ps.y=cv.y AND ps.x=cv.x)"""


@query("g15_mosaic", f"WITH {MOS} SELECT sample_id, COUNT(*) n, {CHECK} checksum FROM j GROUP BY sample_id")
def _(t):
    n = t.part.count()
    parts = rasters(t).select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("slot"))
    parts = parts.withColumn("partner", (F.col("sample_id") * 7 + F.col("slot") * 13) % n)
    return check(G.mosaic(pixels(t), parts, (10, 12), (11, 9), "gt"), "gt")


@query("g16_depth_mix", gq("y, x, CASE WHEN x>=sample_id%4 AND x<sample_id%4+3 THEN y*10+x ELSE gt END AS v"))
def _(t):
    px = pixels(t).withColumn("value", F.col("gt").cast("double")).withColumn("left", (F.col("sample_id") % 4).cast("int")).withColumn("width", F.lit(3))
    d = grid(rasters(t)).select("sample_id", "y", "x", ((F.col("y") * 10 + F.col("x")) * 2.0).alias("depth"))
    return check(G.depth_mix(px, d, "left", "width", factor=2.0), "value")


EDGE = PIXELS + """, mk AS (SELECT DISTINCT a.sample_id, a.h, a.w, a.y, a.x FROM pixels a, (VALUES (-1,0),(0,1),(1,1),(1,-1)) o(dy,dx) JOIN pixels b ON b.sample_id=a.sample_id AND b.y=a.y+o.dy AND b.x=a.x+o.dx WHERE a.gt<>b.gt AND a.gt<>255 AND b.gt<>255 AND a.sample_id%3=b.sample_id%3),
dl AS (SELECT DISTINCT sample_id, y+dy y, x+dx x FROM mk, (SELECT unnest(range(-1,2)) dy), (SELECT unnest(range(-1,2)) dx) WHERE y+dy BETWEEN 0 AND h-1 AND x+dx BETWEEN 0 AND w-1)"""


@query("g17_edge_map", f"WITH {EDGE.replace(' AND a.sample_id%3=b.sample_id%3', '')} SELECT sample_id, COUNT(*) n, CAST(SUM(y*37+x*11+1) AS BIGINT) checksum FROM dl GROUP BY sample_id")
def _(t):
    return check(G.edge_map(pixels(t), "gt").withColumn("v", F.lit(1)), "v")


VOL = RASTERS + """, vol AS (SELECT sample_id, 3 AS d, h, w, CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x, CAST((x*7+y*13+z*5+sample_id)%6 AS INT) v FROM (SELECT *, unnest(range(w)) x FROM (SELECT *, unnest(range(h)) y FROM (SELECT *, unnest(range(3)) z FROM rasters))))"""
VCHECK = "sample_id, COUNT(*) n, CAST(SUM(v*(z*101+y*37+x*11+1)) AS BIGINT) checksum"


def volume(t):
    v = rasters(t).withColumn("d", F.lit(3)).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return grid(v).withColumn("v", ((F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 5 + F.col("sample_id")) % 6).cast("int"))


def vcheck(df):
    return df.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("bigint") * (F.col("z") * 101 + F.col("y") * 37 + F.col("x") * 11 + 1)).alias("checksum"))


@query("g18_flip3d", f"WITH {VOL} SELECT {VCHECK} FROM (SELECT sample_id, 2-z z, y, w-1-x x, v FROM vol) GROUP BY sample_id")
def _(t):
    return vcheck(G.flip3d(volume(t), ["z", "x"]))


@query("g18_crop3d", f"WITH {VOL} SELECT {VCHECK} FROM (SELECT sample_id, z-1 z, y-2 y, x-1 x, v FROM vol WHERE z BETWEEN 1 AND 2 AND y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 4) GROUP BY sample_id")
def _(t):
    return vcheck(G.crop3d(volume(t), (1, 2, 1), (2, 5, 4)))


@query("g18_pad3d", f"""WITH {VOL}, tg AS (SELECT *, unnest(range(GREATEST(11,w))) x FROM (SELECT *, unnest(range(GREATEST(12,h))) y FROM (SELECT *, unnest(range(4)) z FROM rasters)))
SELECT {VCHECK} FROM (SELECT tg.sample_id, tg.z, tg.y, tg.x, COALESCE(vol.v,9) v FROM tg LEFT JOIN vol ON vol.sample_id=tg.sample_id AND vol.z=tg.z AND vol.y=tg.y AND vol.x=tg.x) GROUP BY sample_id""")
def _(t):
    v = rasters(t).withColumn("d", F.lit(3))
    return vcheck(G.pad3d(volume(t), v, (4, 12, 11), {"v": 9}))


# --- masks and boxes -----------------------------------------------------------------------------------
RLE = BLOBS + """, f AS (SELECT *, x*h+y p, LAG(v,1,0) OVER (PARTITION BY sample_id ORDER BY x*h+y) pv FROM blobs), st AS (SELECT sample_id, p FROM f WHERE v<>pv UNION ALL SELECT sample_id, h*w FROM rasters),
rl AS (SELECT sample_id, p, p-LAG(p,1,0) OVER (PARTITION BY sample_id ORDER BY p) n FROM st), enc AS (SELECT sample_id, list(n ORDER BY p) counts FROM rl GROUP BY sample_id)"""


@query("k1_rle_encode", f"WITH {RLE} SELECT sample_id, array_to_string(counts, ',') counts FROM enc")
def _(t):
    return K.rle_encode(blobs(t)).select("sample_id", F.array_join("counts", ",").alias("counts"))


@query("k2_rle_decode", f"WITH {BLOBS} SELECT sample_id, COUNT(*) n, CAST(SUM(y*37+x*11+1) AS BIGINT) checksum FROM blobs WHERE v=1 GROUP BY sample_id")
def _(t):
    return check(K.rle_decode(K.rle_encode(blobs(t))).withColumn("v", F.lit(1)), "v")


@query("k3_rle_area", f"WITH {BLOBS} SELECT sample_id, CAST(SUM(v) AS BIGINT) area FROM blobs GROUP BY sample_id")
def _(t):
    return K.rle_encode(blobs(t)).select("sample_id", K.rle_area(F.col("counts")).alias("area"))


@query("k4_stability", f"WITH {SCORES} SELECT label, class_id, ROUND(COUNT(*) FILTER (WHERE s>0.05)/NULLIF(COUNT(*) FILTER (WHERE s>-0.05),0),6) stability FROM long GROUP BY ALL")
def _(t):
    long = scores(t).select("label", F.posexplode("scores").alias("class_id", "s"))
    return r6(K.stability(long, ["label", "class_id"], "s", 0.0, 0.05))


@query("k5_mask_to_box", f"WITH {BLOBS}, b AS (SELECT sample_id, x, y, CASE WHEN sample_id%10=0 THEN 0 ELSE v END v FROM blobs) SELECT sample_id, COALESCE(MIN(CASE WHEN v=1 THEN x END),0) x0, COALESCE(MIN(CASE WHEN v=1 THEN y END),0) y0, COALESCE(MAX(CASE WHEN v=1 THEN x END),0) x1, COALESCE(MAX(CASE WHEN v=1 THEN y END),0) y1 FROM b GROUP BY sample_id")
def _(t):
    return K.mask_to_box(blobs(t).withColumn("v", F.when(F.col("sample_id") % 10 == 0, 0).otherwise(F.col("v"))))


@query("a37_label_anchor", f"""WITH {PIXELS}, r AS (SELECT sample_id, gt, y, COUNT(*) c FROM pixels WHERE gt<>255 GROUP BY ALL), b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, gt ORDER BY c DESC, y) k FROM r) WHERE k=1),
i AS (SELECT p.sample_id, p.gt, p.y, p.x, c, ROW_NUMBER() OVER (PARTITION BY p.sample_id, p.gt ORDER BY p.x)-1 i FROM pixels p JOIN b ON b.sample_id=p.sample_id AND b.gt=p.gt AND b.y=p.y) SELECT sample_id, gt, y, x FROM i WHERE i=c//2""")
def _(t):
    return L.label_anchor(pixels(t).filter("gt <> 255").select("sample_id", "gt", "y", "x"), ["sample_id", "gt"])


REG = """WITH RECURSIVE {B}, wk AS (SELECT sample_id, y, x, y*w+x i, w FROM blobs WHERE v={on}), nb AS (SELECT a.sample_id, a.i, b.i j FROM wk a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy,dx) JOIN wk b ON b.sample_id=a.sample_id AND b.y=a.y+dy AND b.x=a.x+dx),
rc(sample_id, i, root) AS (SELECT sample_id, i, i FROM wk UNION SELECT rc.sample_id, nb.j, rc.root FROM rc JOIN nb ON nb.sample_id=rc.sample_id AND nb.i=rc.i WHERE nb.j>rc.root),
lb AS (SELECT sample_id, i, MIN(root) comp FROM rc GROUP BY ALL), sz AS (SELECT sample_id, comp, COUNT(*) n FROM lb GROUP BY ALL), tp AS (SELECT sample_id, MAX(n) top, COUNT(*) FILTER (WHERE n<6) small FROM sz GROUP BY ALL),
ft AS (SELECT sz.sample_id, sz.comp, n, top, small, ROW_NUMBER() OVER (PARTITION BY sz.sample_id ORDER BY n DESC, sz.comp) k FROM sz JOIN tp USING (sample_id)),
o AS (SELECT b.sample_id, b.y, b.x, CASE WHEN {hit} THEN {to} ELSE b.v END v, COALESCE(tp.small>0,false) changed FROM blobs b LEFT JOIN lb ON lb.sample_id=b.sample_id AND lb.i=b.y*b.w+b.x LEFT JOIN ft ON ft.sample_id=b.sample_id AND ft.comp=lb.comp LEFT JOIN tp ON tp.sample_id=b.sample_id)
SELECT sample_id, changed, COUNT(*) n, CAST(SUM(v*(y*37+x*11+1)) AS BIGINT) checksum FROM o GROUP BY ALL"""


@query("k6_fill_holes", REG.format(B=BLOBS, on=0, hit="ft.n<6", to=1))
def _(t):
    return check(K.drop_small_regions(blobs(t), 6, "holes"), "v", "sample_id", "changed")


@query("k6_drop_islands", REG.format(B=BLOBS, on=1, hit="ft.n<6 AND NOT (ft.top<6 AND ft.k=1)", to=0))
def _(t):
    return check(K.drop_small_regions(blobs(t), 6, "islands"), "v", "sample_id", "changed")


PYR = RS + """, ly AS (SELECT *, l, CAST(pow(2,l) AS INT) n FROM rs, (VALUES (1),(2)) v(l)), o AS (SELECT *, CAST(floor(0.341::DOUBLE*LEAST(width,height)*(2.0::DOUBLE/n)) AS INT) ov FROM ly),
c AS (SELECT *, CAST(ceil((ov*(n-1)+width)/n) AS INT) cw, CAST(ceil((ov*(n-1)+height)/n) AS INT) ch FROM o)"""


@query("k7_crop_pyramid", f"""WITH {PYR} SELECT raster_id, 0 AS layer, 0 AS box_no, 0 AS x0, 0 AS y0, width AS x1, height AS y1 FROM rs UNION ALL
SELECT raster_id, l, CAST(i*n+j AS INT), CAST((cw-ov)*i AS INT), CAST((ch-ov)*j AS INT), CAST(LEAST((cw-ov)*i+cw,width) AS INT), CAST(LEAST((ch-ov)*j+ch,height) AS INT) FROM (SELECT *, unnest(range(n)) i FROM (SELECT *, unnest(range(n)) j FROM c))""")
def _(t):
    return K.crop_pyramid(rs(t), 2, 0.341)


@query("k8_point_grid", f"""WITH {RS}, l AS (SELECT *, CAST(layer AS INT) ly, CAST(floor(8/pow(2,layer)) AS INT) n FROM rs, (SELECT unnest(range(3)) layer)) SELECT raster_id, ly AS layer, CAST(j*n+i AS INT) point_no, ROUND((2*i+1)/(2*n),6) px, ROUND((2*j+1)/(2*n),6) py,
ROUND((2*i+1)/(2*n)*width,6) x, ROUND((2*j+1)/(2*n)*height,6) y FROM (SELECT *, unnest(range(n)) i FROM (SELECT *, unnest(range(n)) j FROM l))""")
def _(t):
    return r6(K.point_grid(rs(t), 8, 2, 2))


BOX = """bx AS (SELECT o_orderkey box_id, o_custkey image, o_orderkey*7%60 x0, o_orderkey*13%50 y0, o_orderkey*7%60+20+o_orderkey%25 x1, o_orderkey*13%50+20+CAST(floor(o_totalprice) AS BIGINT)%20 y1, o_totalprice score FROM orders)"""


def boxes(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("box_id"), F.col("o_custkey").alias("image"), (k * 7 % 60).alias("x0"), (k * 13 % 50).alias("y0"), (k * 7 % 60 + 20 + k % 25).alias("x1"),
                           (k * 13 % 50 + 20 + F.floor("o_totalprice") % 20).alias("y1"), F.col("o_totalprice").alias("score"))


@query("k9_near_edge", f"""WITH {BOX}, c AS (SELECT *, x0+30 ax0, y0+10 ay0, x1+30 ax1, y1+10 ay1 FROM bx) SELECT box_id, ((ABS(ax0-30)<=5 AND NOT ABS(ax0)<=5) OR (ABS(ay0-10)<=5 AND NOT ABS(ay0)<=5) OR (ABS(ax1-130)<=5 AND NOT ABS(ax1-200)<=5) OR (ABS(ay1-90)<=5 AND NOT ABS(ay1-90)<=5)) near_crop_edge FROM c""")
def _(t):
    b = boxes(t).select("*", F.lit(30).alias("crop_x0"), F.lit(10).alias("crop_y0"), F.lit(130).alias("crop_x1"), F.lit(90).alias("crop_y1"), F.lit(200).alias("img_w"), F.lit(90).alias("img_h"))
    return K.near_edge(b, 5).select("box_id", "near_crop_edge")


@query("k10_uncrop_points", f"WITH {PIXELS} SELECT sample_id, COUNT(*) n, SUM(x + 30) sx, SUM(y + 10) sy, SUM((x + 30) * (y + 10) * gt) checksum FROM pixels GROUP BY sample_id")
def _(t):
    moved = K.uncrop_points(pixels(t).withColumn("crop_x0", F.lit(30)).withColumn("crop_y0", F.lit(10)))
    return moved.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y") * F.col("gt")).alias("checksum"))


@query("k10_centre_boxes", f"WITH {BOX} SELECT box_id, CAST(x0 AS DOUBLE) x0, CAST(y0 AS DOUBLE) y0, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1 FROM bx")
def _(t):
    from ..functions.scalars import cxcywh_to_xyxy, xyxy_to_cxcywh
    back = cxcywh_to_xyxy(*xyxy_to_cxcywh(*[F.col(n) for n in ("x0", "y0", "x1", "y1")]))
    return boxes(t).select("box_id", *[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), back)])


@query("k10_uncrop", f"WITH {BOX} SELECT box_id, x0+30 AS x, y0+10 AS y, x1-x0 AS w, y1-y0 AS h, (x0+x1+60)/2 AS cx, (y0+y1+20)/2 AS cy FROM bx")
def _(t):
    from ..functions.scalars import xyxy_to_cxcywh, xyxy_to_xywh
    u = K.uncrop_boxes(boxes(t).withColumn("crop_x0", F.lit(30)).withColumn("crop_y0", F.lit(10)))
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    x, y, w, h = xyxy_to_xywh(*c)
    cx, cy, _, _ = xyxy_to_cxcywh(*c)
    return u.select("box_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), cx.alias("cx"), cy.alias("cy"))


@query("k11_filter_masks", "SELECT l_orderkey, COUNT(*) n FROM lineitem WHERE l_discount > 0.05 AND l_tax >= 0.02 GROUP BY l_orderkey")
def _(t):
    return K.filter_masks(t.lineitem, "l_discount", "l_tax", 0.05, 0.02).groupBy("l_orderkey").agg(F.count("*").alias("n"))


NMS = """WITH RECURSIVE {BOX}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image ORDER BY score DESC, box_id) rn FROM bx),
st(image, rn, kept) AS (SELECT image, rn, [{{'i': box_id, 'a': x0, 'b': y0, 'c': x1, 'd': y1}}] FROM r WHERE rn=1 UNION ALL
SELECT r.image, r.rn, CASE WHEN len(list_filter(st.kept, lambda k: GREATEST(LEAST(k.c,r.x1)-GREATEST(k.a,r.x0),0)*GREATEST(LEAST(k.d,r.y1)-GREATEST(k.b,r.y0),0)
 > 0.3*((k.c-k.a)*(k.d-k.b)+(r.x1-r.x0)*(r.y1-r.y0)-GREATEST(LEAST(k.c,r.x1)-GREATEST(k.a,r.x0),0)*GREATEST(LEAST(k.d,r.y1)-GREATEST(k.b,r.y0),0))))=0 THEN list_append(st.kept, {{'i': r.box_id, 'a': r.x0, 'b': r.y0, 'c': r.x1, 'd': r.y1}}) ELSE st.kept END
FROM st JOIN r ON r.image=st.image AND r.rn=st.rn+1) SELECT image, unnest(kept).i AS box_id FROM (SELECT image, arg_max(kept, rn) kept FROM st GROUP BY image)"""


@query("k12_nms", NMS.format(BOX=BOX))
def _(t):
    return K.nms(boxes(t), 0.3).select("image", "box_id")
