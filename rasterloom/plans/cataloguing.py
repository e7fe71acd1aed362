"""Queries over sources, sinks and streams. Path and JSON inputs are derived from whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import manifests as S, sinks as K
from ..streaming import jobs as ST
from .inputs import RUNLOG, runlog
from ..session import scratch_path
from .registry import SQL, query
from .scoring import AREA_SQL, r6

PATHS = "im AS (SELECT doc_id, '/data/img/' || source || '/' || doc_id || '.jpg' AS path FROM documents), an AS (SELECT '/data/ann/' || source || '/' || doc_id || '.png' AS path FROM documents WHERE lang <> 'fr')"


def paths(t):
    d = t.documents
    return (d.select(F.concat(F.lit("/data/img/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("path")),
            d.filter("lang <> 'fr'").select(F.concat(F.lit("/data/ann/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("path")))


@query("sc1_scan_pairs", f"WITH {PATHS} SELECT replace(replace(im.path,'/data/img/',''),'.jpg','') AS stem, im.path AS img_path, an.path AS seg_map_path FROM im LEFT JOIN an ON replace(replace(an.path,'/data/ann/',''),'.png','') = replace(replace(im.path,'/data/img/',''),'.jpg','')")
def _(t):
    return S.pair_paths(*paths(t), ".jpg", ".png", "/data/img", "/data/ann")


@query("sc2_scan_split", "SELECT doc_id, 'img/' || source || '_' || doc_id || '.jpg' AS img_path, 'ann/' || source || '_' || doc_id || '.png' AS seg_map_path FROM documents WHERE lang <> 'de'")
def _(t):
    name = F.when(F.col("lang") == "de", "  ").otherwise(F.concat(F.lit(" "), "source", F.lit("_"), "doc_id", F.lit("  ")))
    return S.split_paths(t.documents.select("doc_id", name.alias("value")), "img", "ann", ".jpg", ".png")


@query("sc3_scan_change", "SELECT doc_id, 'a/' || doc_id || CASE WHEN doc_id%3=0 THEN '.tif' ELSE '.png' END AS img_path, 'b/' || doc_id || CASE WHEN doc_id%3=0 THEN '.tif' ELSE '.png' END AS img_path2, 'm/' || doc_id || '.png' AS seg_map_path FROM documents")
def _(t):
    name = F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, ".tif").otherwise(""))
    return S.change_paths(t.documents.select("doc_id", name.alias("value")), "a", "b", "m", ".png", ".png")


@query("sc4_read_manifest", """SELECT doc_id, doc_id || '_' || k AS sample_id, CASE WHEN k=0 THEN '/abs/' ELSE '/root/rel/' END || source || '.tif' AS img_path, '/root/p1,/p2' AS img_paths, '/root/m/' || doc_id || '.png' AS seg_map_path,
CASE WHEN doc_id%2=0 THEN lang ELSE 'default' END AS dataset FROM documents, (SELECT unnest(range(2)) k)""")
def _(t):
    def sample(k, p):
        return F.struct(F.concat_ws("_", "doc_id", F.lit(k)).alias("sample_id"), F.concat(F.lit(p), "source", F.lit(".tif")).alias("img_path"), F.array(F.lit("p1"), F.lit("/p2")).alias("img_paths"),
                        F.concat(F.lit("m/"), "doc_id", F.lit(".png")).alias("seg_map_path"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("dataset_name"))
    two = F.array(sample("0", "/abs/"), sample("1", "rel/"))
    text = F.when(F.col("doc_id") % 3 == 0, F.to_json(two)).otherwise(F.to_json(F.struct(two.alias("samples"))))
    out = S.parse_manifest(t.documents.select("doc_id", text.alias("text")), "text", "/root", keys=["doc_id"]).drop("valid_mask_path", "embedding_path")
    return out.withColumn("img_paths", F.array_join("img_paths", ","))


DEC = """SELECT doc_id, lang || ',x' AS classes, 'imagesTr/' || doc_id || '.nii' AS img_path, 'labelsTr/' || doc_id || '.nii' AS seg_map_path, source AS dataset FROM documents"""


def _decathlon(t):
    return t.documents.select("doc_id", F.to_json(F.struct(
        F.col("source").alias("name"), F.struct(F.col("lang").alias("0"), F.lit("x").alias("1")).alias("labels"), F.array(F.struct(F.concat(F.lit("./imagesTr/"), "doc_id", F.lit(".nii")).alias("image"), F.concat(F.lit("./labelsTr/"), "doc_id", F.lit(".nii")).alias("label"))).alias("training"),
        F.array(F.concat(F.lit("./imagesTs/"), "doc_id", F.lit(".nii")), F.lit("x.nii")).alias("test"))).alias("text"))


@query("sc5_read_decathlon", DEC)
def _(t):
    return S.parse_decathlon(_decathlon(t), "text", keys=["doc_id"]).withColumn("classes", F.array_join("classes", ","))


@query("sc5_read_decathlon_test", "SELECT doc_id, unnest(['imagesTs/' || doc_id || '.nii', 'x.nii']) AS img_path, NULL::VARCHAR AS seg_map_path, source AS dataset FROM documents")
def _(t):
    return S.parse_decathlon(_decathlon(t), "text", test=True, keys=["doc_id"]).drop("classes")


@query("sc6_read_geojson_folds", """SELECT o_orderkey AS patch_id, CAST(o_orderkey%5+1 AS INT) AS fold, m.k AS modality, CASE m.k WHEN 'S2' THEN strftime(o_orderdate, '%Y%m%d') || ',20190101' ELSE '20180902,' || strftime(o_orderdate, '%Y%m%d') END AS dates FROM orders, (VALUES ('S2'),('S1A')) m(k) WHERE o_orderkey%5+1 IN (1,3,4)""")
def _(t):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    props = F.struct(F.col("o_orderkey").alias("ID_PATCH"), (F.col("o_orderkey") % 5 + 1).alias("Fold"),
                     F.struct(day.alias("0"), F.lit("20190101").alias("1")).alias("dates-S2"), F.array(F.lit("20180902"), day).alias("dates-S1A"))
    text = F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features")))
    out = S.parse_geojson_folds(t.orders.select(text.alias("text")), "text", [1, 3, 4])
    return out.withColumn("dates", F.array_join("dates", ","))


@query("sc7_check_unique", "SELECT l_orderkey, COUNT(*) n FROM lineitem GROUP BY l_orderkey HAVING COUNT(*)>1")
def _(t):
    return S.check_unique(t.lineitem, "l_orderkey")


@query("sc8_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t):
    return S.last_wins(t.events, "user_id", "event_type", "event_id")


@query("sc11_read_runlog", "SELECT event_id, CASE WHEN event_type<>'error' THEN CAST(json_extract(props,'$.k') AS BIGINT) END AS step, unnest(['loss','mode']) AS key, unnest([value, NULL]) AS value FROM events WHERE event_type<>'signup'")
def _(t):
    k = F.from_json("props", "k int")["k"]
    line = F.when(F.col("event_type") == "signup", "not json").otherwise(F.to_json(F.struct(
        F.when(F.col("event_type") != "error", k).alias("step"), F.col("value").alias("loss"), F.lit("train").alias("mode"))))
    return S.parse_runlog(t.events.select("event_id", line.alias("text")), "text", ["event_id"])


@query("sc13_explode_targets", "SELECT vec_id, CAST(i AS INT) AS \"index\", CAST(embedding[i+1] AS DOUBLE) AS mask, CAST(200001+i AS INT) AS \"month\" FROM embeddings, (SELECT unnest(range(12)) i)")
def _(t):
    df = t.embeddings.select("vec_id", F.slice("embedding", 1, 12).cast("array<double>").alias("mask"), F.sequence(F.lit(200001), F.lit(200012)).alias("month"))
    return S.explode_targets(df, "mask", "month")


@query("sc14_join_captions", "SELECT c_custkey, COALESCE(string_agg(o_orderpriority, '|' ORDER BY o_orderkey), '') AS captions FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey")
def _(t):
    img = t.customer.select("c_custkey")
    ann = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return S.join_captions(img, ann, "c_custkey", "o_orderpriority", "o_orderkey").withColumn("captions", F.array_join("captions", "|"))


@query("sc14_caption_files", """WITH i AS (SELECT c_custkey, c_custkey // 200 AS block, COALESCE(string_agg(o_orderpriority, '|' ORDER BY o_orderkey), '') AS captions
 FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey)
SELECT CAST(block AS INT) block, c_custkey AS image_id, c_custkey || '.jpg' AS file_name, captions, CAST(NULL AS VARCHAR) AS error FROM i WHERE block % 5 <> 3
UNION ALL SELECT DISTINCT CAST(block AS INT), CAST(NULL AS BIGINT), NULL, NULL, 'malformed' FROM i WHERE block % 5 = 3""")
def _(t):
    # files of 200 images each; every fifth is cut in the middle
    block = F.floor(F.col("c_custkey") / 200).cast("int").alias("block")
    images = t.customer.groupBy(block).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.concat("c_custkey", F.lit(".jpg")).alias("file_name"))).alias("images"))
    known = t.orders.join(t.customer.select(F.col("c_custkey")), F.col("o_custkey") == F.col("c_custkey"))
    notes = known.groupBy(block).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("image_id"), F.col("o_orderpriority").alias("caption"))).alias("annotations"))
    text = F.to_json(F.struct("images", "annotations"))
    docs = images.join(notes, "block", "left").select("block", F.when(F.col("block") % 5 == 3, F.substring(text, 1, 1000)).otherwise(text).alias("value"))
    path = scratch_path(t.spark, "captions")
    docs.repartition("block").write.partitionBy("block").text(path)
    out = S.parse_captions(t.spark.read.schema("value string, block int").text(path, wholetext=True), "value", ["block"])
    return out.withColumn("captions", F.array_join("captions", "|"))


@query("sc15_read_sample_list", "SELECT doc_id, 'media/' || doc_id || '.jpg' AS img_path, 'maps/' || doc_id || '.png' AS seg_map_path, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 255 END || ',255' AS new_ids FROM documents")
def _(t):
    text = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("media/"), "doc_id", F.lit(".jpg")).alias("image")).alias("media"),
                                               F.concat(F.lit("maps/"), "doc_id", F.lit(".png")).alias("label_map"), F.array("lang", F.lit("other")).alias("classes"))).alias("samples")))
    out = S.parse_sample_list(t.documents.select("doc_id", text.alias("text")), "text", ["fr", "en"], keys=["doc_id"])
    return out.select("doc_id", "img_path", "seg_map_path", F.array_join("new_ids", ",").alias("new_ids"))


@query("sc16_class_folders", """WITH f AS (SELECT doc_id, source AS folder, DENSE_RANK() OVER (ORDER BY source)-1 i FROM documents) SELECT doc_id, folder, CAST(i AS INT) class_index, CASE WHEN folder<>'src3' THEN upper(folder) END AS class_name FROM f""")
def _(t):
    p = t.documents.select("doc_id", F.concat(F.lit("/train/"), "source", F.lit("/img_"), "doc_id", F.lit(".JPEG")).alias("path"))
    names = t.documents.select("source").distinct().filter("source <> 'src3'").select(F.col("source").alias("folder"), F.upper("source").alias("class_name"))
    return S.class_folders(p, names).select("doc_id", "folder", "class_index", "class_name")


# --- sinks -------------------------------------------------------------------------------------------
def _back(t, name, write):
    """Write below the shared folder, read back."""
    from ..session import scratch_path
    path = scratch_path(t.spark, name)
    write(path)
    return path


@query("sk1_write_predictions", "SELECT doc_id || '.png' AS name, quality+1 AS pred, 'q' || toxic AS split FROM labels")
def _(t):
    df = t.labels.select(F.concat(F.lit("/img/"), "doc_id", F.lit(".jpg")).alias("img_path"), F.col("quality").alias("pred"), F.concat(F.lit("q"), "toxic").alias("split"))
    path = _back(t, "pred", lambda p: K.write_predictions(df, p, reduced=True))
    return t.spark.read.parquet(path).select("name", "pred", "split")


@query("sk2_write_depth", "SELECT event_id, CAST(floor(value*256) AS BIGINT) AS depth FROM events")
def _(t):
    path = _back(t, "depth", lambda p: K.write_depth(t.events.select("event_id", F.col("value").alias("depth")), p, 256.0))
    return t.spark.read.parquet(path)


@query("sk3_to_raw_ids", "SELECT c_custkey, CAST(n_nationkey*3+7 AS INT) AS c_nationkey FROM customer JOIN nation ON n_nationkey=c_nationkey")
def _(t):
    table = t.nation.select(F.col("n_nationkey").alias("train_id"), (F.col("n_nationkey") * 3 + 7).alias("raw_id"))
    return K.to_raw_ids(t.customer.select("c_custkey", "c_nationkey"), table, "c_nationkey")


@query("sk4_write_split_lists", "SELECT lang AS split, source || '_' || doc_id AS value FROM documents")
def _(t):
    df = t.documents.select(F.col("lang").alias("split"), F.concat_ws("_", "source", "doc_id").alias("stem"))
    return t.spark.read.text(_back(t, "lists", lambda p: K.write_split_lists(df, p))).select("split", "value")


@query("sk5_write_manifest", "SELECT CAST(p_partkey AS BIGINT) sample_id, p_size AS h, p_brand AS dataset FROM part")
def _(t):
    df = t.part.select(F.col("p_partkey").alias("sample_id"), F.col("p_size").alias("h"), F.col("p_brand").alias("dataset"), F.array(F.lit(10.0), F.lit(0.0)).alias("transform"))
    path = _back(t, "manifest", lambda p: K.write_manifest(df, p))
    return t.spark.read.schema("sample_id bigint, h int, dataset string").json(path)


@query("sk6_merge_manifests", "SELECT doc_id AS source_index, lang FROM documents UNION ALL SELECT doc_id+1000000, NULL FROM labels")
def _(t):
    a = t.documents.select(F.col("doc_id").alias("source_index"), "lang")
    return K.merge_manifests([a, t.labels.select((F.col("doc_id") + 1000000).alias("source_index"))])


@query("sk7_write_details", "SELECT event_id, value FROM events")
def _(t):
    path = _back(t, "details", lambda p: K.write_details(t.events.select("event_id", "value"), p))
    return t.spark.read.schema("event_id bigint, value double").json(path)


@query("sk8_report_json", """SELECT user_id, '{"a_rows":' || COUNT(*) || ',"b_bad":null,"user":"u' || user_id || '"}' AS report FROM events GROUP BY user_id""")
def _(t):
    df = t.events.groupBy("user_id").agg(F.count("*").alias("a_rows"), F.max(F.when(F.col("user_id") % 2 == 0, float("nan")).otherwise(float("inf"))).alias("b_bad"))
    df = df.withColumn("user", F.concat(F.lit("u"), "user_id"))
    rep = K.report_json(df.drop("user_id"))
    return rep.select(F.regexp_extract("report", '"user":"u([0-9]+)"', 1).cast("bigint").alias("user_id"), "report")


@query("sk11_append_results", "SELECT 'a' AS run, lang, COUNT(*) n FROM documents GROUP BY lang UNION ALL SELECT 'b', source, COUNT(*) FROM documents GROUP BY source")
def _(t):
    a = t.documents.groupBy("lang").agg(F.count("*").alias("n")).withColumn("run", F.lit("a"))
    b = t.documents.groupBy(F.col("source").alias("lang")).agg(F.count("*").alias("n")).withColumn("run", F.lit("b"))

    def write(p):
        for d in (a, b):
            K.append_results(d, p + ".csv", "run string, lang string, n bigint")
    path = _back(t, "results", write)
    return t.spark.read.schema("run string, lang string, n bigint").option("header", "true").csv(path + ".csv")


@query("sk11_stack_results", "SELECT lang, NULL AS source, COUNT(*) n, 'x' AS run FROM documents GROUP BY lang UNION ALL SELECT NULL, source, COUNT(*), 'y' FROM documents GROUP BY source")
def _(t):
    d = t.documents
    return K.stack_results({"x": d.groupBy("lang").agg(F.count("*").alias("n")), "y": d.groupBy("source").agg(F.count("*").alias("n"))})


PACK = """m AS (SELECT CASE WHEN vec_id%100=4 THEN vec_id-1 ELSE vec_id END sample_id FROM embeddings), v AS (SELECT vec_id sample_id, CASE WHEN label=1 THEN 60 ELSE 64 END d FROM embeddings WHERE label<>3),
l AS (SELECT vec_id sample_id, label FROM embeddings WHERE label<>5), j AS (SELECT m.sample_id, d, label FROM m LEFT JOIN v USING (sample_id) LEFT JOIN l USING (sample_id))"""


def _pack(t):
    v = F.col("vec_id")
    e = t.embeddings
    m = e.select(F.when(v % 100 == 4, v - 1).otherwise(v).alias("sample_id"))
    vec = e.filter("label <> 3").select(v.alias("sample_id"), F.when(F.col("label") == 1, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"))
    return K.pack_bundle(m, vec, e.filter("label <> 5").select(v.alias("sample_id"), "label"))


@query("sk10_pack_bundle", f"WITH {PACK} SELECT sample_id, d AS dim, label FROM j")
def _(t):
    return _pack(t)[0].select("sample_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), "label")


@query("sk10_pack_violations", f"WITH {PACK} SELECT sample_id, 'duplicate_id' AS rule FROM m GROUP BY sample_id HAVING COUNT(*)>1 UNION ALL SELECT sample_id, 'no_vector' FROM j WHERE d IS NULL "
       "UNION ALL SELECT sample_id, 'shape_drift' FROM j WHERE d<>(SELECT MIN(d) FROM j) UNION ALL SELECT sample_id, 'mixed_labels' FROM j WHERE label IS NULL")
def _(t):
    return _pack(t)[1]


# --- streams: whole tables as file streams, compared with the batch result ------------------------------
def _stream(t, table):
    return ST.file_stream(t.spark, t.folder, getattr(t, table).schema, f"{table}.parquet")


LP = "valid AS (SELECT 0 AS sample_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END gt, CASE l_linestatus WHEN 'F' THEN 0 ELSE 2 END pred FROM lineitem)"


def _late_events(t):
    """The events as four files, the newest first, one file a batch."""
    events, folder = t.events, scratch_path(t.spark, "late-events")
    top = events.agg(F.max("event_id")).first()[0] or 0
    for i in range(4):
        part = events.filter(F.floor(F.col("event_id") * 4 / F.lit(top + 1)) == 3 - i)
        part.coalesce(1).write.parquet(f"{folder}/f{i}")
    return ST.file_stream(t.spark, f"{folder}/f*", events.schema, files_per_batch=1)


def _pairs(df):
    return df.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("gt"), F.when(F.col("l_linestatus") == "F", 0).otherwise(2).alias("pred"))


@query("st1_stream_areas", f"WITH {LP} {AREA_SQL.format(n=4, b2=1)} SELECT class_id, intersect_ AS \"intersect\", pred_area, label_area, union_area FROM tot")
def _(t):
    return ST.stream_seg_metrics(_pairs(_stream(t, "lineitem")), 4)


@query("st1_stream_seg_metrics", f"WITH {LP} {AREA_SQL.format(n=4, b2=1)} SELECT ROUND(100*SUM(intersect_)/SUM(label_area),2) aacc, ROUND(100*AVG(iou),2) m_iou, ROUND(100*AVG(acc),2) m_acc FROM per2")
def _(t):
    return M.seg_metrics(ST.stream_seg_metrics(_pairs(_stream(t, "lineitem")), 4))


@query("st2_stream_windowed_metrics", "SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) n, ROUND(SUM(value),4) total, MAX(value) AS top FROM events GROUP BY ALL")
def _(t):
    # event times carry no zone: read them as UTC whatever the session zone is
    return _windows(_stream(t, "events"))


def _windows(stream):
    events = stream.withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    w = ST.stream_windowed_metrics(events, "ts", "1 day", "2 days", "value", ["event_type"])
    return w.select(F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), "event_type", "n", F.round("total", 4).alias("total"), "top")


@query("st2_stream_late_files", SQL["st2_stream_windowed_metrics"])
def _(t):
    return _windows(_late_events(t))


@query("st3_stream_fill_steps", f"WITH {RUNLOG} SELECT file, pos, key, value, CAST(COALESCE(last_value(NULLIF(step,0) IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING),0) AS BIGINT) AS step FROM runlog")
def _(t):
    class Streamed:
        events = _stream(t, "events")
    return ST.stream_fill_steps(runlog(Streamed), "file", "pos").select("file", "pos", "key", "value", "step")


@query("st3_stream_late_files", SQL["st3_stream_fill_steps"])
def _(t):
    class Streamed:
        events = _late_events(t)
    return ST.stream_fill_steps(runlog(Streamed), "file", "pos").select("file", "pos", "key", "value", "step")


@query("st4_stream_score", "SELECT event_id, ROUND(value*2+1,6) AS score FROM events")
def _(t):
    def make():
        def fn(pdf):
            return pdf[["event_id"]].assign(score=(pdf["value"] * 2 + 1).round(6))
        return fn
    path = _back(t, "scored", lambda p: ST.stream_score(_stream(t, "events").select("event_id", "value"), make, "event_id bigint, score double", p))
    return t.spark.read.parquet(f"{path}/rows").select("event_id", "score")
