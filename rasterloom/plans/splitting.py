"""Queries over splits, sampling, set operations, logs and audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as V, labels as L, runlog as LG, sampling as S
from .inputs import PIXELS, RUNLOG, pixels, runlog
from .registry import SQL, query
from .scoring import r6

DOC = "d AS (SELECT doc_id, source, lang, ROW_NUMBER() OVER (ORDER BY doc_id) rn, COUNT(*) OVER () n FROM documents)"


def docs(t):
    return t.documents.select("doc_id", "source", "lang")


@query("l1_sort_manifest", "SELECT source, doc_id FROM documents")
def _(t):
    return S.sort_manifest(t.documents.select("source", "doc_id"), "doc_id")


@query("l2_topk", "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 3")
def _(t):
    return S.topk(t.orders, ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("l3_spot_rows", f"WITH {DOC} SELECT doc_id, rn FROM d WHERE rn IN (1, n//2+1, n)")
def _(t):
    return S.spot_rows(docs(t), ["doc_id"]).select("doc_id", "rn")


@query("l4_split_iid", f"WITH {DOC}, s AS (SELECT *, round_even(n*0.33,0) a, round_even(n*0.335,0) b FROM d) SELECT doc_id, CASE WHEN rn<=a THEN 'train' WHEN rn<=a+b THEN 'valid' ELSE 'test' END AS split FROM s")
def _(t):
    return S.split_iid(docs(t), "doc_id", {"train": 0.33, "valid": 0.335, "test": 0.335}, seed=None).select("doc_id", "split")


@query("l4_split_iid_sizes", "WITH n AS (SELECT COUNT(*) n FROM documents) SELECT 'train' AS split, CAST(round_even(n*0.7,0) AS BIGINT) c FROM n UNION ALL SELECT 'test', n-CAST(round_even(n*0.7,0) AS BIGINT) FROM n")
def _(t):
    return S.split_iid(docs(t), "doc_id", {"train": 0.7, "test": 0.3}).groupBy("split").agg(F.count("*").alias("c"))


@query("l5_resplit", f"WITH {DOC}, s AS (SELECT doc_id, CASE WHEN lang='en' THEN 'train' WHEN lang='fr' THEN 'valid' ELSE 'test' END AS split FROM d), p AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) rn, COUNT(*) OVER () n FROM s WHERE split<>'train') "
       "SELECT doc_id, split FROM s WHERE split='train' UNION ALL SELECT doc_id, CASE WHEN rn<=round_even(n*0.5,0) THEN 'valid' ELSE 'test' END FROM p")
def _(t):
    df = t.documents.select("doc_id", F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "valid").otherwise("test").alias("split"))
    return S.resplit(df, "doc_id", ["valid", "test"], [0.5, 0.5], seed=None)


@query("l6_train_val_split", f"WITH {DOC} SELECT doc_id, CASE WHEN rn<=n-CAST(ceil(n*0.2) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM d")
def _(t):
    return S.train_val_split(docs(t), "doc_id", 0.2, seed=None).select("doc_id", "split")


@query("l7_first_n_split", "SELECT page_id, CASE WHEN ROW_NUMBER() OVER (ORDER BY url COLLATE C, page_id)<=60 THEN 'train' ELSE 'val' END AS split FROM pages".replace(" COLLATE C", ""))
def _(t):
    return S.first_n_split(t.pages.select("page_id", "url"), ["url", "page_id"], 60).select("page_id", "split")


@query("l8_split_by_ids", "SELECT d.doc_id, CASE WHEN l.quality=1 THEN 'train' WHEN l.quality=0 THEN 'test' ELSE 'val' END AS split FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    lists = t.labels.select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return S.split_by_ids(t.documents.select("doc_id"), lists, "doc_id")


CLS = "c AS (SELECT c_custkey, c_nationkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) rn, COUNT(*) OVER (PARTITION BY c_nationkey) n FROM customer)"


def cust(t):
    return t.customer.select("c_custkey", "c_nationkey")


@query("l9_stratified_split", f"WITH {CLS} SELECT c_custkey, CASE WHEN n>1 AND rn<=GREATEST(1,CAST(floor(n*0.1) AS INT)) THEN 'val' ELSE 'train' END AS split FROM c")
def _(t):
    return S.stratified_split(cust(t), "c_nationkey", "c_custkey", 0.1).select("c_custkey", "split")


@query("l10_few_shot", f"WITH {CLS} SELECT c_custkey, CAST(unnest(range(3)) AS INT) AS try FROM c WHERE rn<=5")
def _(t):
    return S.few_shot(cust(t), "c_nationkey", "c_custkey", 5, 3, seed=None).select("c_custkey", "try")


@query("l10_few_shot_percent", f"WITH {CLS} SELECT c_custkey FROM c WHERE rn<=GREATEST(CAST(floor(n*0.15) AS INT),1)")
def _(t):
    return S.few_shot(cust(t), "c_nationkey", "c_custkey", 0.15, seed=None).select("c_custkey")


@query("l10_few_shot_seeded_counts", f"WITH {CLS} SELECT c_nationkey, CAST(unnest(range(2)) AS INT) AS try, LEAST(7, MAX(n)) AS k FROM c GROUP BY c_nationkey")
def _(t):
    return S.few_shot(cust(t), "c_nationkey", "c_custkey", 7, 2).groupBy("c_nationkey", "try").agg(F.count("*").alias("k"))


@query("l11_rebalance_multilabel")
def _(t):
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 10).cast("int")).alias("labels"))
    return S.rebalance_multilabel(orders, "l_orderkey", "labels", 0.1)


@query("l12_fraction_partitions", f"WITH {DOC} SELECT doc_id, f.fraction FROM d JOIN (VALUES (0.01::DOUBLE),(0.1::DOUBLE),(0.5::DOUBLE),(1.0::DOUBLE)) f(fraction) ON rn<=GREATEST(1,round_even(n*f.fraction,0))")
def _(t):
    return S.fraction_partitions(docs(t), "doc_id", [0.01, 0.1, 0.5, 1.0], seed=None)


@query("l13_epoch_index", "WITH n AS (SELECT COUNT(*) n FROM documents), e AS (SELECT unnest(range(n*5//2)) pos, n FROM n) SELECT pos, pos % n AS sample FROM e WHERE pos >= 2 AND (pos-2) % 3 = 0")
def _(t):
    n = t.documents.count()
    return S.epoch_index(t.spark, n * 5 // 2, n, start=2, step=3)


@query("l13_epoch_index_shuffled")
def _(t):
    n = t.documents.count()
    return S.epoch_index(t.spark, n * 3 // 2, n, shuffle=True, seed=7)


@query("l14_shard", f"WITH {DOC} SELECT doc_id, CAST((rn-1) % 7 AS INT) AS shard FROM d")
def _(t):
    return S.shard(docs(t), ["doc_id"], 7).select("doc_id", "shard")


@query("l15_temporal_dropout", "SELECT o_custkey, CAST(LEAST(4, COUNT(DISTINCT o_orderdate)) AS BIGINT) n FROM orders GROUP BY o_custkey")
def _(t):
    d = t.orders.select("o_custkey", "o_orderdate").distinct()
    return S.temporal_dropout(d, "o_custkey", "o_orderdate", 4, 3).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("l16_foreground_voxel")
def _(t):
    return S.foreground_voxel(pixels(t).filter("gt <> 255"), "sample_id", "gt", ["y", "x"], 5)


@query("l18_natural_sort", r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key FROM pages")
def _(t):
    from ..functions.scalars import natural_key
    return t.pages.select("page_id", natural_key(F.col("url")).alias("sort_key")).orderBy("sort_key", "page_id")


@query("w8_balanced_sample", f"WITH {CLS} SELECT c_custkey, c_nationkey FROM c WHERE rn<=8")
def _(t):
    return S.balanced_sample(cust(t), "c_nationkey", "c_custkey", 8, seed=None)


@query("w8_balanced_sample_seeded", f"WITH {CLS} SELECT c_nationkey, CAST(LEAST(8,COUNT(*)) AS BIGINT) n FROM c GROUP BY c_nationkey")
def _(t):
    return S.balanced_sample(cust(t), "c_nationkey", "c_custkey", 8).groupBy("c_nationkey").agg(F.count("*").alias("n"))


DATES = """dt AS (SELECT DISTINCT o_custkey s, o_orderdate d FROM orders), r AS (SELECT s, d, ROW_NUMBER() OVER (PARTITION BY s ORDER BY d)-1 i FROM dt), c AS (SELECT s, COUNT(*) n FROM dt GROUP BY s)"""


@query("w6_sample_dates_chunks", f"""WITH {DATES}, sl AS (SELECT s, n, CAST(unnest(range(6)) AS INT) slot FROM c),
p AS (SELECT s, slot, CASE WHEN n<6 THEN CAST(round_even(slot*(n-1)/5.0,0) AS BIGINT) ELSE slot*(n//6)+LEAST(slot,n%6)+((n//6)+CASE WHEN slot<n%6 THEN 1 ELSE 0 END)//2 END i FROM sl)
SELECT p.s AS o_custkey, slot, d AS o_orderdate FROM p JOIN r ON r.s=p.s AND r.i=p.i""")
def _(t):
    return S.sample_dates_chunks(t.orders, "o_custkey", "o_orderdate", 6)


@query("w7_sample_dates_linspace", f"""WITH {DATES}, sl AS (SELECT s, n, CAST(unnest(range(5)) AS INT) slot FROM c), p AS (SELECT s, slot, CASE WHEN n<=5 THEN LEAST(slot,n-1) ELSE slot*(n-1)//4 END i FROM sl)
SELECT p.s AS o_custkey, slot, d AS o_orderdate FROM p JOIN r ON r.s=p.s AND r.i=p.i""")
def _(t):
    return S.sample_dates_linspace(t.orders, "o_custkey", "o_orderdate", 5)


@query("w12_uncertain_points", "SELECT user_id, event_id, CAST(r AS INT) AS point FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ABS(value-100), event_id) r FROM events) WHERE r<=6")
def _(t):
    e = t.events.select("user_id", "event_id", (F.col("value") - 100).alias("logit"))
    return S.uncertain_points(e, "user_id", ["event_id"], "logit", 8, importance=0.75, seed=None).select("user_id", "event_id", "point")


@query("w12_uncertain_points_seeded")
def _(t):
    e = t.events.select("user_id", "event_id", (F.col("value") - 100).alias("logit"))
    return S.uncertain_points(e, "user_id", ["event_id"], "logit", 8)


@query("j10_mix_partners")
def _(t):
    return S.mix_partners(docs(t), "doc_id", 3, 11)


# --- sets -------------------------------------------------------------------------------------------
@query("u1_merge_exclude", "(SELECT o_custkey FROM orders WHERE o_orderstatus='F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def _(t):
    o = t.orders
    return S.merge_exclude(o.filter("o_orderstatus='F'").select("o_custkey"), o.filter("o_orderpriority='1-URGENT'").select("o_custkey"),
                           o.filter("o_orderstatus='P'").select("o_custkey"))


@query("u1_extra_only", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def _(t):
    o = t.orders
    return S.extra_only(t.customer.select("c_custkey"), o.filter("o_orderstatus='F'").select("o_custkey"), o.filter("o_orderstatus='P'").select("o_custkey"))


@query("u2_check_subset", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return S.check_subset(t.customer.select("c_custkey"), t.orders.select("o_custkey"))


PARTS = """pt AS (SELECT 'p' || (event_id % 3) AS partition, event_type AS split, user_id AS sample_name FROM events)"""


def parts(t):
    return t.events.select(F.concat(F.lit("p"), F.col("event_id") % 3).alias("partition"), F.col("event_type").alias("split"), F.col("user_id").alias("sample_name"))


@query("u3_check_disjoint", f"""WITH {PARTS}, c AS (SELECT partition, sample_name, split, COUNT(*) c FROM pt GROUP BY ALL), g AS (SELECT partition, sample_name, COUNT(*) s, MAX(c) m FROM c GROUP BY ALL)
SELECT partition, sample_name, CASE WHEN s>1 THEN 'in_several_splits' ELSE 'duplicate' END AS rule FROM g WHERE s>1 OR m>1""")
def _(t):
    return S.check_disjoint(parts(t), "partition", "split", "sample_name")


@query("u4_diff_names", "(SELECT user_id, 'unexpected' AS side FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment<>'BUILDING')) UNION ALL (SELECT c_custkey, 'missing' FROM (SELECT c_custkey FROM customer WHERE c_mktsegment<>'BUILDING' EXCEPT SELECT user_id FROM events))")
def _(t):
    return S.diff_names(t.events.select("user_id"), t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey"))


@query("u5_concat_datasets", "SELECT doc_id, lang, NULL::INT AS quality, 0 AS dataset_index FROM documents UNION ALL SELECT doc_id, NULL, quality, 1 FROM labels")
def _(t):
    return S.concat_datasets(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"))


@query("u6_observed_labels", "SELECT DISTINCT label FROM (SELECT c_nationkey AS label FROM customer UNION SELECT s_nationkey FROM supplier) WHERE label <> 7")
def _(t):
    return S.observed_labels("label", t.customer.select(F.col("c_nationkey").alias("label")), t.supplier.select(F.col("s_nationkey").alias("label")), ignore=7)


# --- logs --------------------------------------------------------------------------------------------
FILLED = RUNLOG + ", fl AS (SELECT *, COALESCE(last_value(NULLIF(step,0) IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING),0) AS filled FROM runlog)"


@query("w1_fill_steps", f"WITH {FILLED} SELECT file, pos, key, value, CAST(filled AS INT) AS step FROM fl")
def _(t):
    return LG.fill_steps(runlog(t), "file", "pos").select("file", "pos", "key", "value", "step")


@query("w2_metric_curve_eval", f"WITH {FILLED} SELECT file, CAST(filled AS INT) AS step, MIN(pos) AS pos, arg_min(value, pos) AS value FROM fl WHERE key='purchase' GROUP BY file, filled")
def _(t):
    return LG.metric_curve(LG.fill_steps(runlog(t), "file", "pos"), "purchase", True)


@query("w2_metric_curve_all", f"WITH {FILLED} SELECT file, CAST(filled AS INT) AS step, pos, value FROM fl WHERE key='click'")
def _(t):
    return LG.metric_curve(LG.fill_steps(runlog(t), "file", "pos"), "click", False)


@query("w11_best_run", """WITH r AS (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) k FROM events), b AS (SELECT user_id, event_id, value FROM r WHERE k=1)
SELECT *, user_id = (SELECT user_id FROM b ORDER BY value DESC, user_id LIMIT 1) AS best FROM b""")
def _(t):
    return LG.best_run(t.events, "user_id", "event_id", "value")


FPS = "f AS (SELECT user_id, COUNT(*)/SUM(value) fps FROM (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events) WHERE i>5 GROUP BY user_id)"


@query("a23_fps_stats", f"WITH {FPS} SELECT ROUND(AVG(fps),6) mean_fps, ROUND(VAR_POP(fps),8) var_fps, COUNT(*) runs FROM f")
def _(t):
    s = LG.fps_stats(t.events, "user_id", "event_id", "value")[1]
    return s.select(F.round("mean_fps", 6).alias("mean_fps"), F.round("var_fps", 8).alias("var_fps"), "runs")


TITLE, KIND, HREF = r"<title>([^<]*)</title>", r"""<html lang="([a-z]+)">""", r'href="([^"]+)"'
ZOO = f"""z AS (SELECT page_id, trim(replace(regexp_extract(html, '{TITLE}', 1), '#', '')) title, regexp_extract(html, '{KIND}', 1) kind,
list_sort(list_distinct(list_transform(regexp_extract_all(html, '{HREF}', 1), lambda u: lower(trim(u))))) urls FROM pages WHERE len(regexp_extract_all(html, '{HREF}', 1)) > 0)"""


@query("sc12_scan_model_zoo", f"WITH {ZOO} SELECT page_id, title, kind, array_to_string(urls, ' ') AS urls FROM z")
def _(t):
    z = LG.zoo_entries(t.pages, "html", TITLE, KIND, HREF, ["page_id"])
    return z.withColumn("urls", F.array_join("urls", " "))


@query("a22_zoo_stats", f"""WITH {ZOO}, p AS (SELECT kind, COUNT(DISTINCT title) papers, GROUPING(kind) g FROM z GROUP BY ROLLUP(kind)), u AS (SELECT kind, COUNT(DISTINCT url) checkpoints, GROUPING(kind) g FROM (SELECT kind, unnest(urls) url FROM z) GROUP BY ROLLUP(kind))
SELECT p.kind, CAST(p.g AS INT) AS all_kinds, papers, COALESCE(checkpoints,0) checkpoints FROM p LEFT JOIN u ON p.kind IS NOT DISTINCT FROM u.kind AND p.g=u.g""")
def _(t):
    z = LG.zoo_stats(LG.zoo_entries(t.pages, "html", TITLE, KIND, HREF))
    return z.withColumn("all_kinds", F.col("all_kinds").cast("int"))


# --- named steps -------------------------------------------------------------------------------------
@query("apply_steps", f"WITH {PIXELS} SELECT sample_id, COUNT(*) n, CAST(SUM(gt) AS BIGINT) total FROM (SELECT sample_id, CASE WHEN gt=4 THEN 255 ELSE gt END gt FROM pixels WHERE gt<>255) GROUP BY sample_id")
def _(t):
    from ..functions.scalars import mask_ignore
    from ..operators.filters import valid_rows
    from ..operators.geometry import flip
    from ..operators.steps import apply_steps
    steps = [("valid", valid_rows, {}), ("flip", flip, {"direction": "vertical"}), ("drop_all", lambda df: df.limit(0), {}),
             ("ignore", lambda df, values: df.withColumn("gt", mask_ignore(F.col("gt"), values)), {"values": [4]})]
    return apply_steps(pixels(t), steps, skip={"drop_all"}).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("gt").alias("total"))


# --- audits ------------------------------------------------------------------------------------------
@query("v1_audit_labels", f"WITH {PIXELS} SELECT sample_id, array_to_string(list_sort(list(DISTINCT gt)), ',') bad_values, COUNT(*) pixels FROM pixels WHERE gt NOT BETWEEN 0 AND 2 AND gt<>255 GROUP BY sample_id")
def _(t):
    return V.audit_labels(pixels(t), "sample_id", "gt", 3)


MAN = """m AS (SELECT CASE WHEN doc_id%50=7 THEN doc_id-1 ELSE doc_id END sample_id, lang AS split, CASE WHEN doc_id%97=3 THEN 'v0' ELSE 'v1' END AS format, source || '/' || doc_id AS path FROM documents),
fi AS (SELECT source || '/' || doc_id AS path FROM documents WHERE source<>'src5'), ve AS (SELECT vec_id sample_id, label, embedding FROM embeddings)"""


@query("v2_audit_manifest", f"""WITH {MAN}, sz AS (SELECT split, COUNT(*) n FROM m GROUP BY split), u AS (
SELECT 'format' AS rule, CAST(sample_id AS VARCHAR) AS key, format AS detail FROM m WHERE format<>'v1' UNION ALL SELECT 'split', CAST(sample_id AS VARCHAR), split FROM m WHERE split NOT IN ('en','fr','de')
UNION ALL SELECT 'split_count', split, CAST(n AS VARCHAR) FROM sz WHERE split IN ('en','fr','de') AND n<>100 UNION ALL SELECT 'duplicate_id', CAST(sample_id AS VARCHAR), CAST(COUNT(*) AS VARCHAR) FROM m GROUP BY sample_id HAVING COUNT(*)>1
UNION ALL SELECT 'missing_file', CAST(sample_id AS VARCHAR), path FROM m WHERE path NOT IN (SELECT path FROM fi) UNION ALL SELECT 'vector_size', CAST(sample_id AS VARCHAR), '63' FROM ve WHERE label=2)
SELECT rule, key, detail FROM u""")
def _(t):
    return _manifest_audit(t)


def _manifest_audit(t):
    d = F.col("doc_id")
    m = t.documents.select(F.when(d % 50 == 7, d - 1).otherwise(d).alias("sample_id"), F.col("lang").alias("split"), F.when(d % 97 == 3, "v0").otherwise("v1").alias("format"),
                           F.concat_ws("/", "source", "doc_id").alias("path"))
    files = t.documents.filter("source <> 'src5'").select(F.concat_ws("/", "source", "doc_id").alias("path"))
    vec = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") == 2, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    return V.audit_manifest(m, files, vec, {"en": 100, "fr": 100, "de": 100}, "v1", 64)


@query("v2_audit_counts", SQL["v2_audit_manifest"].replace("SELECT rule, key, detail FROM u", "SELECT rule, COUNT(*) n FROM u GROUP BY ROLLUP(rule)"))
def _(t):
    return V.count_violations(_manifest_audit(t))


@query("v3_audit_partition", f"""WITH {PARTS}, c AS (SELECT partition, sample_name, split, COUNT(*) c FROM pt GROUP BY ALL), g AS (SELECT partition, sample_name, COUNT(*) s, MAX(c) m FROM c GROUP BY ALL)
SELECT partition, CAST(sample_name AS VARCHAR) sample_name, CASE WHEN s>1 THEN 'in_several_splits' ELSE 'duplicate' END AS rule FROM g WHERE s>1 OR m>1
UNION ALL SELECT partition, CAST(sample_name AS VARCHAR), 'not_in_dataset' FROM pt WHERE sample_name NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
UNION ALL SELECT DISTINCT partition, 'holdout', 'empty_split' FROM pt""")
def _(t):
    p = parts(t).withColumn("sample_name", F.col("sample_name").cast("string"))
    names = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("sample_name"))
    return V.audit_partition(p, names, ["click", "view", "holdout"])


@query("v4_audit_dataset", """WITH b AS (SELECT p_partkey sample_id, unnest([0,1,2]) i, unnest(CASE WHEN p_partkey%10=3 THEN ['R','B','G'] ELSE ['R','G','B'] END) band, 8+p_size%2 h, 8 w FROM part),
g AS (SELECT sample_id, COUNT(*) n_bands, COUNT(*) FILTER (WHERE band<>['R','G','B'][i+1]) misplaced, MAX(h) h, MAX(w) w FROM b GROUP BY sample_id)
SELECT sample_id, CASE WHEN n_bands<>3 OR misplaced>0 THEN 'band_order' ELSE 'patch_size' END AS rule, n_bands, misplaced, h, w FROM g WHERE n_bands<>3 OR misplaced>0 OR h<>8 OR w<>8""")
def _(t):
    order = F.when(F.col("p_partkey") % 10 == 3, F.array(F.lit("R"), F.lit("B"), F.lit("G"))).otherwise(F.array(F.lit("R"), F.lit("G"), F.lit("B")))
    b = t.part.select(F.col("p_partkey").alias("sample_id"), (8 + F.col("p_size") % 2).alias("h"), F.lit(8).alias("w"), F.posexplode(order).alias("band_index", "band"))
    return V.audit_dataset(b, ["R", "G", "B"], 8)


@query("v5_audit_label_type", "SELECT c_custkey AS key, 'classification' AS kind FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 19 UNION ALL SELECT p_partkey, 'segmentation' FROM part WHERE p_size > 40 UNION ALL SELECT s_suppkey, 'multilabel' FROM supplier WHERE s_nationkey % 3 = 2 OR s_nationkey > 22")
def _(t):
    a = V.audit_label_type(t.customer.select(F.col("c_custkey").alias("key"), "c_nationkey"), "key", "c_nationkey", "classification", 20)
    b = V.audit_label_type(t.part.select(F.col("p_partkey").alias("key"), F.array(F.lit(0), F.col("p_size") - 1).alias("m")), "key", "m", "segmentation", 40)
    v = F.when(F.col("s_nationkey") > 22, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.col("s_nationkey") % 3))
    c = V.audit_label_type(t.supplier.select(F.col("s_suppkey").alias("key"), v.alias("v")), "key", "v", "multilabel", 2)
    return a.unionByName(b).unionByName(c)


@query("v6_audit_palette", """WITH c AS (SELECT n_regionkey dataset, n_nationkey class_id, n_nationkey%4 r, n_nationkey%3 g, 0 b FROM nation)
SELECT dataset, 'class_ids' AS rule, CAST(COUNT(*) AS VARCHAR) detail FROM c GROUP BY dataset HAVING COUNT(*)<>COUNT(DISTINCT class_id) OR MAX(class_id)+1<>COUNT(*)
UNION ALL SELECT dataset, 'shared_color', concat_ws(',', r, g, b) FROM c GROUP BY dataset, r, g, b HAVING COUNT(*)>1""")
def _(t):
    k = F.col("n_nationkey")
    return V.audit_palette(t.nation.select(F.col("n_regionkey").alias("dataset"), k.alias("class_id"), (k % 4).alias("r"), (k % 3).alias("g"), F.lit(0).alias("b")))


@query("v7_audit_series", """SELECT event_id AS key, event_type AS modality, CASE WHEN event_id%10=0 THEN 'two_sources' WHEN event_id%10=1 THEN 'no_source' WHEN event_type='view' THEN 'static_with_dates' ELSE 'date_count' END AS rule FROM events
WHERE event_id%10 IN (0,1) OR (event_type='view' AND event_id%3>0) OR (event_type<>'view' AND event_id%3<>event_id%4)""")
def _(t):
    e = F.col("event_id")
    df = t.events.select(e.alias("key"), F.col("event_type").alias("modality"), F.array_repeat(F.lit("d"), (e % 3).cast("int")).alias("dates"), (e % 4).alias("steps"),
                         F.when(e % 10 != 1, "a").alias("sa"), F.when(e % 10 == 0, "b").alias("sb"))
    return V.audit_series(df, "key", "modality", "dates", "steps", ["view"], "sa", "sb")


@query("v8_audit_shapes", "SELECT l_orderkey, MIN(l_linenumber) h0, MAX(l_linenumber) h1, 5 AS w0, 5 AS w1 FROM lineitem GROUP BY l_orderkey HAVING MIN(l_linenumber)<>MAX(l_linenumber)")
def _(t):
    return V.audit_shapes(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("h"), F.lit(5).alias("w")), "l_orderkey")


@query("v9_audit_counts", "SELECT COALESCE(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_prediction' ELSE 'no_sample' END AS rule FROM (SELECT doc_id FROM labels) l FULL OUTER JOIN (SELECT doc_id FROM documents WHERE lang <> 'de') d USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def _(t):
    return V.audit_counts(t.labels, t.documents.filter("lang <> 'de'"), "doc_id")


@query("sc9_embedding_contract", "SELECT COUNT(*) AS \"rows\", 0::BIGINT AS null_vectors, MIN(len(embedding))::INT AS min_dim, MAX(len(embedding))::INT AS max_dim, 0::BIGINT AS non_finite, COUNT(*) FILTER (WHERE label<0) AS negative_labels FROM embeddings")
def _(t):
    return V.audit_vectors(t.embeddings)


@query("a36_split_fingerprint")
def _(t):
    return L.split_fingerprint(t.customer, "c_mktsegment", "c_custkey", "c_nationkey")
