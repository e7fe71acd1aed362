"""Queries over label pairs, depth pairs and class scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D, filters as FL, losses as E, metrics as M, ranking as R
from .inputs import DEPTH, PIXELS, SCORES, depth, pixels, scores
from .registry import query


def r6(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and (not names or c in names) else F.col(c)
                       for c, t in df.dtypes])


VALID = PIXELS + ", valid AS (SELECT * FROM pixels WHERE gt <> 255)"
AREA_SQL = """
, hits AS (SELECT sample_id, class_id, SUM(i) i, SUM(p) p, SUM(l) l FROM (
   SELECT sample_id, gt AS class_id, CASE WHEN gt=pred THEN 1 ELSE 0 END i, 0 p, 1 l FROM valid
   UNION ALL SELECT sample_id, pred, 0, 1, 0 FROM valid) WHERE class_id BETWEEN 0 AND 4 GROUP BY ALL)
, tot AS (SELECT c.class_id, CAST(COALESCE(SUM(i),0) AS BIGINT) intersect_, CAST(COALESCE(SUM(p),0) AS BIGINT) pred_area,
   CAST(COALESCE(SUM(l),0) AS BIGINT) label_area, CAST(COALESCE(SUM(p+l-i),0) AS BIGINT) union_area
   FROM (SELECT CAST(unnest(range({n})) AS INT) AS class_id) c LEFT JOIN hits USING (class_id) GROUP BY c.class_id)
, per AS (SELECT *, intersect_/NULLIF(union_area,0) iou, intersect_/NULLIF(label_area,0) acc,
   2*intersect_/NULLIF(pred_area+label_area,0) dice, intersect_/NULLIF(pred_area,0) prec FROM tot)
, per2 AS (SELECT *, (1+{b2})*prec*acc/NULLIF({b2}*prec+acc,0) fscore FROM per)"""


@query("a1_areas", f"WITH {VALID} {AREA_SQL.format(n=5, b2=1)} SELECT sample_id, class_id, CAST(i AS BIGINT) AS \"intersect\", "
       "CAST(p AS BIGINT) AS pred_area, CAST(l AS BIGINT) AS label_area, CAST(p+l-i AS BIGINT) AS union_area FROM hits")
def _(t):
    return M.areas(pixels(t), 5, by=["sample_id"])


@query("a2_total_areas", f"WITH {VALID} {AREA_SQL.format(n=6, b2=1)} SELECT class_id, intersect_ AS \"intersect\", pred_area, "
       "label_area, union_area FROM tot")
def _(t):
    return M.total_areas(pixels(t), 6)


@query("a3_per_class", f"WITH {VALID} {AREA_SQL.format(n=6, b2=4)} SELECT class_id, ROUND(iou,6) iou, ROUND(acc,6) acc, "
       "ROUND(dice,6) dice, ROUND(fscore,6) fscore, ROUND(prec,6) AS \"precision\", ROUND(acc,6) recall FROM per2")
def _(t):
    return r6(M.per_class(M.total_areas(pixels(t), 6), beta=2.0)).select(
        "class_id", "iou", "acc", "dice", "fscore", "precision", "recall")


@query("a3_seg_metrics", f"WITH {VALID} {AREA_SQL.format(n=6, b2=1)} SELECT ROUND(100*SUM(intersect_)/SUM(label_area),2) aacc, "
       "ROUND(100*AVG(iou),2) m_iou, ROUND(100*AVG(acc),2) m_acc, ROUND(100*AVG(dice),2) m_dice, ROUND(100*AVG(fscore),2) m_fscore, "
       "ROUND(100*AVG(prec),2) m_precision, ROUND(100*AVG(acc),2) m_recall FROM per2")
def _(t):
    return M.seg_metrics(M.total_areas(pixels(t), 6), ["mIoU", "mDice", "mFscore"])


@query("a3_seg_metrics_nan_to_num", f"WITH {VALID} {AREA_SQL.format(n=6, b2=1)} SELECT "
       "ROUND(100*SUM(intersect_)/SUM(label_area),2) aacc, ROUND(100*AVG(COALESCE(iou,0)),2) m_iou, "
       "ROUND(100*AVG(COALESCE(acc,0)),2) m_acc FROM per2")
def _(t):
    return M.seg_metrics(M.total_areas(pixels(t), 6), ["mIoU"], nan_to_num=0)


EO_VALID = PIXELS + ", valid AS (SELECT sample_id, gt, LEAST(GREATEST(pred,0),3) AS pred FROM pixels WHERE gt <> 255 AND (x+y) % 9 <> 0 AND gt BETWEEN 0 AND 3)"


@query("a4_seg_metrics_eo", f"WITH {EO_VALID} {AREA_SQL.format(n=4, b2=1)} SELECT ROUND(100*SUM(intersect_)/SUM(label_area),2) aacc, "
       "ROUND(100*AVG(iou),2) m_iou, ROUND(100*AVG(acc),2) m_acc FROM per2")
def _(t):
    px = pixels(t).withColumn("valid", (F.col("gt") != 255) & ((F.col("x") + F.col("y")) % 9 != 0))
    return M.seg_metrics(M.total_areas(px, 4, mode="eo", mask="valid"), ["mIoU"])


@query("a5_pixel_accuracy", f"WITH {PIXELS} SELECT COUNT(*) pixels, ROUND(AVG(CASE WHEN gt=pred THEN 1.0 ELSE 0.0 END),6) accuracy "
       "FROM pixels WHERE gt <> 255")
def _(t):
    return r6(M.pixel_accuracy(pixels(t)))


CM = """
, cm AS (SELECT g.gt, g.pred, COUNT(v.gt) n FROM (SELECT a.c gt, b.c pred FROM (SELECT CAST(unnest(range(6)) AS INT) c) a,
   (SELECT CAST(unnest(range(6)) AS INT) c) b) g LEFT JOIN valid v ON v.gt=g.gt AND v.pred=g.pred GROUP BY g.gt, g.pred)
, cls AS (SELECT class_id, SUM(tp) tp, SUM(s) s, SUM(p) p FROM (SELECT gt class_id, CASE WHEN gt=pred THEN n ELSE 0 END tp, n s, 0 p FROM cm
   UNION ALL SELECT pred, 0, 0, n FROM cm) GROUP BY class_id)
, sc AS (SELECT *, COALESCE(tp/NULLIF(p,0),0) pr, COALESCE(tp/NULLIF(s,0),0) re, COALESCE(2*tp/NULLIF(s+p,0),0) f1 FROM cls WHERE s>0 OR p>0)"""


@query("a6_confusion", f"WITH {VALID} {CM} SELECT gt, pred, n FROM cm")
def _(t):
    return M.confusion(pixels(t), 6)


@query("a7_confusion_pct", f"WITH {VALID} {CM} SELECT gt, pred, ROUND(COALESCE(n*100.0/NULLIF(SUM(n) OVER (PARTITION BY gt),0),-1.0),6) pct FROM cm")
def _(t):
    return r6(M.confusion_pct(M.confusion(pixels(t), 6)))


@query("a8_miou_from_confusion", f"WITH {VALID} {CM} SELECT ROUND(AVG(tp/(s+p-tp)),6) miou FROM cls WHERE s+p-tp>0")
def _(t):
    return r6(M.miou_from_confusion(M.confusion(pixels(t), 6)))


@query("a9_cls_metrics_from_confusion", f"WITH {VALID} {CM} SELECT ROUND(SUM(tp)/SUM(s),6) accuracy, ROUND(AVG(re),6) balanced_accuracy, "
       "ROUND(AVG(f1),6) macro_f1 FROM sc WHERE s>0")
def _(t):
    return r6(M.cls_metrics_from_confusion(M.confusion(pixels(t), 6)))


CAT = """pairs AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END gt, CASE l_linestatus WHEN 'F' THEN 0 ELSE 3 END pred FROM lineitem),
valid AS (SELECT * FROM pairs)"""


@query("a10_classification_report", f"WITH {CAT} {CM} SELECT ROUND(SUM(tp)/SUM(s),6) accuracy, ROUND(AVG(CASE WHEN s>0 THEN re END),6) balanced_accuracy, "
       "ROUND(AVG(f1),6) macro_f1, ROUND(SUM(f1*s)/SUM(s),6) weighted_f1, ROUND(AVG(pr),6) macro_precision, ROUND(AVG(re),6) macro_recall FROM sc")
def _(t):
    li = t.lineitem.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("gt"),
                           F.when(F.col("l_linestatus") == "F", 0).otherwise(3).alias("pred"))
    return r6(M.classification_report(M.confusion(li, 6, ignore=None)))


@query("a10_class_scores", "WITH valid AS (SELECT quality gt, toxic pred FROM labels) " + CM + " SELECT class_id, CAST(tp AS BIGINT) tp, CAST(s AS BIGINT) support, "
       "CAST(p AS BIGINT) predicted, ROUND(pr,6) AS \"precision\", ROUND(re,6) recall, ROUND(f1,6) f1 FROM sc")
def _(t):
    return r6(M.class_scores(M.confusion(t.labels, 6, gt="quality", pred="toxic", ignore=None)))


# --- class-score rankings ----------------------------------------------------------------------
TR = SCORES + """, own AS (SELECT vec_id, label, scores, scores[label+1] own FROM scores),
ranked AS (SELECT o.vec_id, o.label, o.own, 1 + COUNT(*) FILTER (WHERE l.s > o.own OR (l.s = o.own AND l.class_id < o.label)) r,
  COUNT(*) FILTER (WHERE l.s >= o.own) rge FROM own o JOIN long l USING (vec_id) GROUP BY ALL)"""


@query("a11_topk_accuracy", f"WITH {TR} SELECT ROUND(100*(COUNT(*) FILTER (WHERE r<=1 AND own>0.05)+1.1920928955078125e-07)/(COUNT(*)+1.1920928955078125e-07),6) top1, "
       "ROUND(100*(COUNT(*) FILTER (WHERE r<=5 AND own>0.05)+1.1920928955078125e-07)/(COUNT(*)+1.1920928955078125e-07),6) top5 FROM ranked WHERE label <> 9")
def _(t):
    return r6(R.topk_accuracy(scores(t), "label", "scores", (1, 5), thresh=0.05, ignore=9))


def _targets(t):
    # two targets per vector; -1 pads, label 9 has none at all
    y = F.col("label")
    return scores(t).withColumn("targets", F.when(y == 9, F.array(F.lit(-1), F.lit(-1))).when(y % 2 == 0, F.array(y, F.lit(-1)))
                                .otherwise(F.array(y, (y + 3) % 10)))


ANY = SCORES + """, top AS (SELECT vec_id, list(class_id) ids FROM (SELECT vec_id, class_id, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY s DESC, class_id) r FROM long) WHERE r <= 3 GROUP BY vec_id),
tg AS (SELECT vec_id, label, CAST(label % 3 AS INT) AS region, CAST(vec_id % 2 AS INT) AS side, CASE WHEN label % 2 = 0 THEN [label] ELSE [label, (label+3)%10] END tg FROM scores WHERE label <> 9),
hits AS (SELECT t.*, CASE WHEN list_has_any(top.ids, t.tg) THEN 1.0 ELSE 0.0 END hit FROM tg t JOIN top USING (vec_id))"""


@query("a12_any_match", f"WITH {ANY} SELECT ROUND(AVG(hit),6) accuracy, COUNT(*) AS \"rows\" FROM hits")
def _(t):
    return r6(R.any_match(_targets(t), "scores", "targets", k=3))


@query("a13_any_match_by", f"WITH {ANY} SELECT region, side, CAST(GROUPING(region)*2+GROUPING(side) AS BIGINT) AS level, ROUND(AVG(hit),6) accuracy, COUNT(*) AS \"rows\" "
       "FROM hits GROUP BY GROUPING SETS ((region),(side),())")
def _(t):
    df = _targets(t).withColumn("region", (F.col("label") % 3).cast("int")).withColumn("side", (F.col("vec_id") % 2).cast("int"))
    return r6(R.any_match_by(df, "scores", "targets", ["region", "side"], k=3))


@query("a14_macro_mrr", f"WITH {TR} SELECT ROUND(SUM(m)/10,6) macro_mrr FROM (SELECT label, SUM(1.0/rge)/(COUNT(*)+1e-6) m FROM ranked GROUP BY label)")
def _(t):
    return r6(R.macro_mrr(scores(t), "label", "scores", 10))


@query("a15_map_11pt", f"""WITH {SCORES}, c AS (SELECT class_id, s, SUM(CASE WHEN label=class_id THEN 1 ELSE 0 END) p, COUNT(*) n FROM long GROUP BY ALL),
cu AS (SELECT class_id, SUM(p) OVER w tp, SUM(n) OVER w seen, SUM(p) OVER (PARTITION BY class_id) pos FROM c WINDOW w AS (PARTITION BY class_id ORDER BY s DESC)),
lv AS (SELECT unnest(range(11))/10.0 r), best AS (SELECT class_id, r, MAX(CASE WHEN tp/pos >= r THEN tp/seen END) b FROM cu, lv GROUP BY ALL)
SELECT ROUND(AVG(CASE WHEN r=0 THEN 1.0 ELSE COALESCE(b,0) END),6) map_11pt FROM best""")
def _(t):
    long = scores(t).select("label", F.posexplode("scores").alias("class_id", "s"))
    return r6(R.map_11pt(long.withColumn("pos", (F.col("label") == F.col("class_id")).cast("int")), "class_id", "s", "pos"))


MCE = """res AS (SELECT event_type AS kind, CAST(json_extract(props,'$.k') AS INT) % 5 + 1 AS level, AVG(value/1000) accuracy FROM events GROUP BY ALL),
ref AS (SELECT event_type AS kind, CAST(json_extract(props,'$.k') AS INT) % 5 + 1 AS level, AVG(CASE WHEN value > 100 THEN 0.7 ELSE 0.4 END) ref_error FROM events WHERE event_type <> 'signup' GROUP BY ALL),
rel AS (SELECT kind, AVG(1.0-accuracy)/AVG(ref_error) e FROM ref JOIN res USING (kind, level) GROUP BY kind)"""


def _mce(t):
    e = t.events.withColumn("level", F.from_json("props", "k int")["k"] % 5 + 1).withColumnRenamed("event_type", "kind")
    res = e.groupBy("kind", "level").agg(F.avg(F.col("value") / 1000).alias("accuracy"))
    ref = (e.filter("kind <> 'signup'").groupBy("kind", "level")
            .agg(F.avg(F.when(F.col("value") > 100, 0.7).otherwise(0.4)).alias("ref_error")))
    return res, ref


@query("a16_corruption_error", f"WITH {MCE} SELECT kind, ROUND(e,6) relative_error FROM rel")
def _(t):
    return r6(R.corruption_error(*_mce(t)))


@query("a16_mean_corruption_error", f"WITH {MCE} SELECT ROUND(AVG(e),6) mce FROM rel")
def _(t):
    return r6(R.mean_corruption_error(*_mce(t)))


DEPTH_SQL = DEPTH + """, per AS (SELECT sample_id, AVG(CASE WHEN GREATEST(gt/pred,pred/gt)<1.25 THEN 1.0 ELSE 0 END) d1,
 AVG(CASE WHEN GREATEST(gt/pred,pred/gt)<1.5625 THEN 1.0 ELSE 0 END) d2, AVG(CASE WHEN GREATEST(gt/pred,pred/gt)<1.953125 THEN 1.0 ELSE 0 END) d3,
 AVG(ABS(pred-gt)/gt) abs_rel, AVG((pred-gt)*(pred-gt)/gt) sq_rel, SQRT(AVG((pred-gt)*(pred-gt))) rmse, SQRT(AVG((ln(pred)-ln(gt))*(ln(pred)-ln(gt)))) rmse_log,
 AVG(ABS(log10(pred)-log10(gt))) log10, SQRT(GREATEST(AVG((ln(pred)-ln(gt))*(ln(pred)-ln(gt)))-0.5*AVG(ln(pred)-ln(gt))*AVG(ln(pred)-ln(gt)),0)) silog,
 100*SQRT(GREATEST(AVG((ln(pred)-ln(gt))*(ln(pred)-ln(gt)))-AVG(ln(pred)-ln(gt))*AVG(ln(pred)-ln(gt)),0)) silog_b, AVG(ABS(pred-gt)) mae FROM depth {where} GROUP BY sample_id)"""


@query("a17_depth_metrics", f"WITH {DEPTH_SQL.format(where='WHERE gt > 1000 AND gt < 60000')} SELECT " +
       ", ".join(f"ROUND(AVG({c}),4) {c}" for c in D.DEPTH) + " FROM per")
def _(t):
    return r6(D.depth_metrics(FL.depth_mask(depth(t), 1000, 60000), "sample_id"), digits=4)


@query("a18_depth_metrics_b", f"WITH {DEPTH_SQL.format(where='')} SELECT ROUND(AVG(d1),4) a1, ROUND(AVG(d2),4) a2, ROUND(AVG(d3),4) a3, ROUND(AVG(mae),4) mae, "
       "ROUND(AVG(abs_rel),4) abs_rel, ROUND(AVG(sq_rel),4) sq_rel, ROUND(AVG(rmse),4) rmse, ROUND(AVG(rmse_log),4) rmse_log, ROUND(AVG(silog_b),4) silog, ROUND(AVG(log10),4) log_10 FROM per")
def _(t):
    return r6(D.depth_metrics(depth(t), "sample_id", variant="b"), digits=4)


@query("a19_label_stats", f"""WITH {PIXELS}, c AS (SELECT gt, COUNT(*) pixels, COUNT(DISTINCT sample_id) samples FROM pixels GROUP BY gt)
SELECT COALESCE(k, gt) AS label, CASE WHEN COALESCE(k,gt)=255 THEN 'ignore' WHEN COALESCE(k,gt) BETWEEN 0 AND 3 THEN 'class' ELSE 'out_of_range' END kind,
COALESCE(pixels,0) pixels, COALESCE(samples,0) samples FROM (SELECT CAST(unnest(range(4)) AS INT) k) FULL OUTER JOIN c ON k=gt""")
def _(t):
    return M.label_stats(pixels(t), 4, "sample_id", "gt")


@query("a20_sample_summary", f"""WITH {PIXELS} SELECT sample_id, MAX(y)+1 AS h, MAX(x)+1 AS w, MIN(gt) min_label, MAX(gt) max_label,
array_to_string(list_sort(list(DISTINCT gt)), ',') uniques, COUNT(*) FILTER (WHERE gt<>255) valid_pixels, COUNT(*) pixels FROM pixels GROUP BY sample_id""")
def _(t):
    return M.sample_summary(pixels(t), "sample_id", "gt")


@query("a35_crop_ok", f"""WITH {PIXELS}, tl AS (SELECT sample_id, CAST(y//4 AS INT) ty, CAST(x//4 AS INT) tx, gt FROM pixels), c AS (SELECT sample_id, ty, tx, gt, COUNT(*) c FROM tl WHERE gt<>255 GROUP BY ALL)
SELECT sample_id, ty, tx, COALESCE(ok,false) ok FROM (SELECT DISTINCT sample_id, ty, tx FROM tl) LEFT JOIN (SELECT sample_id, ty, tx, (COUNT(*)>1 AND MAX(c)/SUM(c)<0.3) AS ok FROM c GROUP BY ALL) USING (sample_id, ty, tx)""")
def _(t):
    px = pixels(t).withColumn("ty", F.floor(F.col("y") / 4).cast("int")).withColumn("tx", F.floor(F.col("x") / 4).cast("int"))
    return M.crop_ok(px, ["sample_id", "ty", "tx"], 0.3, "gt")


@query("a40_average_tries", "SELECT event_type AS metric, ROUND(AVG(value),6) mean, ROUND(STDDEV_SAMP(value),6) std FROM events GROUP BY event_type")
def _(t):
    return r6(R.average_tries(t.events.withColumnRenamed("event_type", "metric"), "metric", "value"))


@query("a41_presence_vector", f"""WITH {PIXELS} SELECT s.sample_id, c.class_id, CAST(MAX(CASE WHEN p.gt IS NULL THEN 0 ELSE 1 END) AS INT) present
FROM (SELECT DISTINCT sample_id FROM pixels) s CROSS JOIN (SELECT CAST(unnest(range(6)) AS INT) class_id) c LEFT JOIN pixels p ON p.sample_id=s.sample_id AND p.gt=c.class_id GROUP BY ALL""")
def _(t):
    return M.presence(pixels(t), 6, "sample_id", "gt")


# parents are classes 0 and 1; classes 2..9 hang below them by parity
@query("a42_tree_scores", f"""WITH {SCORES}, tr AS (SELECT vec_id, class_id, CASE WHEN class_id >= 2 THEN class_id % 2 END parent, s FROM long),
kid AS (SELECT vec_id, parent p, MAX(s) m FROM tr WHERE parent IS NOT NULL GROUP BY ALL)
SELECT t.vec_id, t.class_id, t.parent, ROUND(CASE WHEN t.parent IS NULL THEN GREATEST(t.s, k.m) ELSE LEAST(t.s, o.s) END, 6) AS fixed
FROM tr t LEFT JOIN kid k ON k.vec_id=t.vec_id AND k.p=t.class_id LEFT JOIN tr o ON o.vec_id=t.vec_id AND o.class_id=t.parent""")
def _(t):
    long = scores(t).select("vec_id", F.posexplode("scores").alias("class_id", "score"))
    long = long.withColumn("parent", F.when(F.col("class_id") >= 2, F.col("class_id") % 2))
    return r6(M.tree_scores(long, ["vec_id"], "class_id", "parent", "score"))


# --- losses ------------------------------------------------------------------------------------
LSE = SCORES + """, lse AS (SELECT vec_id, label, ln(SUM(exp(s))) z, MAX(CASE WHEN class_id=label THEN s END) sy FROM long GROUP BY ALL),
ce AS (SELECT *, CASE WHEN label=9 THEN 0 ELSE z-sy END l, CASE WHEN label=9 THEN 0 WHEN label%2=0 THEN 0.5 ELSE 2.0 END w FROM lse)"""
W = {i: (0.5 if i % 2 == 0 else 2.0) for i in range(10)}

for _avg, _sql in (("all", "SUM(l)/COUNT(*)"), ("valid", "SUM(l)/COUNT(*) FILTER (WHERE label<>9)")):
    query(f"e1_cross_entropy_{_avg}", f"WITH {LSE} SELECT ROUND({_sql},6) loss FROM ce")(
        lambda t, a=_avg: r6(E.cross_entropy(scores(t), "label", "scores", ignore=9, avg=a)))


@query("e1_cross_entropy_weight", f"WITH {LSE} SELECT ROUND(SUM(l*w)/SUM(w),6) loss FROM ce")
def _(t):
    return r6(E.cross_entropy(scores(t), "label", "scores", ignore=9, avg="weight", class_weight=W))


BCE = "GREATEST(s,0)-s*y+ln(1+exp(-ABS(s)))"
HOT = SCORES + ", hot AS (SELECT *, CASE WHEN label=class_id THEN 1.0 ELSE 0.0 END y, 1/(1+exp(-s)) p FROM long)"


@query("e2_binary_cross_entropy", f"WITH {HOT} SELECT ROUND(SUM(CASE WHEN label=9 THEN 0 ELSE {BCE} END)/COUNT(*),6) loss FROM hot")
def _(t):
    return r6(E.binary_cross_entropy(scores(t), "label", "scores", ignore=9))


@query("e2_binary_cross_entropy_valid", f"WITH {HOT} SELECT ROUND(SUM({BCE})/COUNT(*),6) loss FROM hot WHERE label<>9")
def _(t):
    return r6(E.binary_cross_entropy(scores(t), "label", "scores", ignore=9, avg="valid"))


@query("e3_focal_loss", f"WITH {HOT} SELECT ROUND(AVG(({BCE})*(0.5*y+0.5*(1-y))*POW((1-p)*y+p*(1-y),2)),6) loss FROM hot")
def _(t):
    return r6(E.focal_loss(scores(t), "label", "scores"))


@query("e3_focal_loss_alpha_list", f"WITH {HOT} SELECT ROUND(AVG(({BCE})*((class_id+1)/20*y+(1-(class_id+1)/20)*(1-y))*POW((1-p)*y+p*(1-y),1.5)*CASE WHEN class_id%2=0 THEN 0.5 ELSE 2 END*CASE WHEN label=9 THEN 0 ELSE 1 END),6) loss FROM hot")
def _(t):
    return r6(E.focal_loss(scores(t), "label", "scores", 1.5, [(i + 1) / 20 for i in range(10)], ignore=9, class_weight=W))


PR = SCORES + """, z AS (SELECT vec_id, SUM(exp(s)) z FROM long GROUP BY vec_id), hot AS (SELECT vec_id, CAST(vec_id % 20 AS INT) img, label, class_id, exp(s)/z p, CASE WHEN label=class_id THEN 1 ELSE 0 END y FROM long JOIN z USING (vec_id))"""


def _probs(t):
    from ..functions.vectors import softmax
    return scores(t).select("vec_id", (F.col("vec_id") % 20).cast("int").alias("img"), "label", softmax(F.col("scores")).alias("probs"))


@query("e4_dice_loss", f"WITH {PR} SELECT ROUND(AVG(d),6) loss FROM (SELECT img, 1-2*SUM(p*y)/(SUM(p*p)+0.001+SUM(y*y)+0.001) d FROM hot GROUP BY img)")
def _(t):
    return r6(E.dice_loss(_probs(t), "img", "label", "probs"))


@query("e4_dice_loss_naive", f"WITH {PR} SELECT ROUND(AVG(d),6) loss FROM (SELECT img, 1-(2*SUM(p*y)+0.001)/(SUM(p)+SUM(y)+0.001) d FROM hot GROUP BY img)")
def _(t):
    return r6(E.dice_loss(_probs(t), "img", "label", "probs", naive=True))


@query("e5_tversky_loss", f"""WITH {PR}, c AS (SELECT img, class_id, 1-(SUM(p*y*v)+1)/(SUM(p*y*v)+0.3*SUM(p*(1-y)*v)+0.7*SUM((1-p)*y*v)+1) l
FROM (SELECT *, CASE WHEN label=9 THEN 0 ELSE 1 END v FROM hot) GROUP BY ALL) SELECT ROUND(AVG(l),6) loss FROM (SELECT img, AVG(l) l FROM c GROUP BY img)""")
def _(t):
    return r6(E.tversky_loss(_probs(t), "img", "label", "probs", ignore=9))


LOV = """, r AS (SELECT *, SUM(fg) OVER w cf, SUM(1-fg) OVER w cb, SUM(fg) OVER (PARTITION BY {by}) g, ROW_NUMBER() OVER w i FROM e WINDOW w AS (PARTITION BY {by} ORDER BY err DESC, vec_id)),
j AS (SELECT *, 1-(g-cf)/NULLIF(g+cb,0) j1, CASE WHEN i=1 THEN 0 ELSE 1-(g-cf+fg)/NULLIF(g+cb-1+fg,0) END j0 FROM r)"""


@query("e6_lovasz_softmax", f"WITH {PR}, e AS (SELECT vec_id, class_id, ABS(y-p) err, y fg FROM hot WHERE label<>9) {LOV.format(by='class_id')} "
       "SELECT ROUND(AVG(l),6) loss FROM (SELECT class_id, SUM(GREATEST(err,0)*(j1-j0)) l FROM j WHERE g>0 GROUP BY class_id)")
def _(t):
    return r6(E.lovasz_softmax(_probs(t), "label", "probs", ["vec_id"], ignore=9))


@query("e6_lovasz_hinge", f"WITH {SCORES}, e AS (SELECT vec_id, CAST(vec_id%20 AS INT) img, 1-10*scores[1]*(2.0*(label%2)-1) err, label%2 fg FROM scores WHERE label<>9) {LOV.format(by='img')} "
       "SELECT ROUND(AVG(l),6) loss FROM (SELECT img, SUM(GREATEST(err,0)*(j1-j0)) l FROM j GROUP BY img)")
def _(t):
    df = scores(t).select("vec_id", (F.col("vec_id") % 20).cast("int").alias("img"), (F.col("scores")[0] * 10).alias("score"),
                          F.when(F.col("label") == 9, 255).otherwise(F.col("label") % 2).alias("y"))
    return r6(E.lovasz_hinge(df, "y", "score", ["vec_id"], per_image=["img"]))


@query("e7_silog_loss", f"""WITH {DEPTH}, d AS (SELECT sample_id, ln(GREATEST(gt,1e-4))-ln(GREATEST(pred-5000,1e-4)) d FROM depth)
SELECT ROUND(AVG(l),6) loss FROM (SELECT sample_id, SQRT(AVG(d*d)-0.5*AVG(d)*AVG(d)) l FROM d GROUP BY sample_id)""")
def _(t):
    return r6(E.silog_loss(depth(t).withColumn("pred", F.col("pred") - 5000), "sample_id"))


@query("e8_kl_divergence", f"""WITH {SCORES}, z AS (SELECT vec_id, SUM(exp(s/2)) zs, SUM(exp(o/2)) zo FROM long GROUP BY vec_id)
SELECT vec_id, ROUND(AVG(exp(o/2)/zo*(ln(exp(o/2)/zo)-exp(s/2)/zs)*4),6) loss FROM long JOIN z USING (vec_id) GROUP BY vec_id""")
def _(t):
    return r6(E.kl_divergence(scores(t), "vec_id", "scores", "other", temperature=2.0))


@query("e9_boundary_bce", f"""WITH {SCORES}, e AS (SELECT scores[1] s, CASE WHEN label<3 THEN 1 ELSE 0 END y FROM scores), c AS (SELECT SUM(y) p, SUM(1-y) q FROM e)
SELECT ROUND(AVG(({BCE})*CASE WHEN y=1 THEN q/(p+q) ELSE p/(p+q) END),6) loss FROM e, c""")
def _(t):
    df = scores(t).select((F.col("label") < 3).cast("int").alias("edge"), F.col("scores")[0].alias("score"))
    return r6(E.boundary_bce(df, "edge", "score"))


TP = LSE + ", tp AS (SELECT vec_id, label, exp(sy-z) p FROM lse), v AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, vec_id) r, COUNT(*) OVER () n FROM tp WHERE label<>9)"


@query("e10_ohem_cross_entropy", f"WITH {TP}, b AS (SELECT GREATEST(MAX(p),0.1) th FROM v WHERE r=LEAST(201,n)) SELECT ROUND(AVG(-ln(p)),6) loss, COUNT(*) kept FROM v, b WHERE p<th")
def _(t):
    return r6(E.ohem_cross_entropy(scores(t), "label", "scores", ["vec_id"], thr=0.1, min_kept=200, ignore=9))


@query("e11_reduce_loss", "SELECT ROUND(AVG(value),6) mean_loss, ROUND(SUM(value),4) sum_loss, ROUND(SUM(value)/(1000+1.1920928955078125e-07),6) factor_loss FROM events")
def _(t):
    v = F.col("value")
    return t.events.agg(F.round(E.reduce_loss(v), 6).alias("mean_loss"), F.round(E.reduce_loss(v, "sum"), 4).alias("sum_loss"),
                        F.round(E.reduce_loss(v, "mean", 1000), 6).alias("factor_loss"))


@query("w10_hard_pixels", f"WITH {TP}, b AS (SELECT GREATEST(MAX(p),0.09) th FROM v WHERE r=LEAST(151,n)) SELECT vec_id, CASE WHEN label<>9 AND p<th THEN 1 ELSE 0 END AS weight FROM tp, b")
def _(t):
    df = E.with_target_prob(scores(t), "label", "scores", "p")
    return E.hard_pixels(df, "p", "label", ["vec_id"], 0.09, 150, ignore=9).select("vec_id", "weight")


@query("w10_hard_pixels_topn", f"""WITH {LSE}, v AS (SELECT vec_id, CAST(vec_id%20 AS INT) img, ROW_NUMBER() OVER (PARTITION BY vec_id%20 ORDER BY l DESC, vec_id) r FROM ce WHERE label<>9)
SELECT c.vec_id, CAST(c.vec_id%20 AS INT) img, CASE WHEN r<=10 THEN 1 ELSE 0 END weight FROM ce c LEFT JOIN v USING (vec_id)""")
def _(t):
    df = scores(t).select("vec_id", (F.col("vec_id") % 20).cast("int").alias("img"), "label",
                          E.row_cross_entropy(F.col("label"), F.col("scores"), 9).alias("loss"))
    return E.hard_pixels(df, "loss", "label", ["vec_id"], None, 10, ["img"], ignore=9).select("vec_id", "img", "weight")
