"""Views of the given tables in the shapes the operators take, in Spark and as SQL text.

Every view covers whole tables; pixel grids are derived by integer arithmetic so both engines agree.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .registry import Tables

IGNORE = 255


# --- pixel grids: one sample per part, side 8..16 ------------------------------------------------
def rasters(t: Tables) -> DataFrame:
    """sample_id, h, w (not square)."""
    return spread(t.part.select(F.col("p_partkey").alias("sample_id"), (8 + F.col("p_size") % 9).cast("int").alias("h"),
                                (8 + F.col("p_partkey") % 7).cast("int").alias("w")))


RASTERS = """rasters AS (SELECT p_partkey AS sample_id, CAST(8 + p_size % 9 AS INT) AS h,
 CAST(8 + p_partkey % 7 AS INT) AS w FROM part)"""


def grid(df: DataFrame) -> DataFrame:
    """All (y, x) of each raster."""
    return (df.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
              .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))))


def pixels(t: Tables) -> DataFrame:
    """sample_id, h, w, y, x, gt (255 = ignore), pred."""
    k = F.col("x") * 7 + F.col("y") * 13 + F.col("sample_id")
    g, g5 = (k % 6).cast("int"), (k % 5).cast("int")
    return (grid(rasters(t))
            .withColumn("gt", F.when(g == 5, IGNORE).otherwise(g))
            .withColumn("pred", F.when((F.col("x") * 3 + F.col("y") * 5 + F.col("sample_id")) % 4 == 0, (g5 + 1) % 5)
                        .otherwise(F.when(g == 5, g5).otherwise(g)).cast("int")))


PIXELS = RASTERS + """,
grid AS (SELECT *, CAST(unnest(range(w)) AS INT) AS x FROM
  (SELECT *, CAST(unnest(range(h)) AS INT) AS y FROM rasters)),
pixels AS (SELECT sample_id, h, w, y, x,
  CAST(CASE WHEN (x*7 + y*13 + sample_id) % 6 = 5 THEN 255 ELSE (x*7 + y*13 + sample_id) % 6 END AS INT) AS gt,
  CAST(CASE WHEN (x*3 + y*5 + sample_id) % 4 = 0 THEN ((x*7 + y*13 + sample_id) % 5 + 1) % 5
       WHEN (x*7 + y*13 + sample_id) % 6 = 5 THEN (x*7 + y*13 + sample_id) % 5
       ELSE (x*7 + y*13 + sample_id) % 6 END AS INT) AS pred
  FROM grid)"""


# --- blobs: two-class masks with connected shapes ------------------------------------------------
def blobs(t: Tables) -> DataFrame:
    """sample_id, h, w, y, x, v in {0, 1}: coarse blocks with single-pixel holes and specks."""
    coarse = (F.floor(F.col("x") / 3) * 5 + F.floor(F.col("y") / 3) * 3 + F.col("sample_id")) % 3 == 0
    speck = (F.col("x") * 11 + F.col("y") * 17 + F.col("sample_id")) % 23 == 0
    return grid(rasters(t)).withColumn("v", (coarse != speck).cast("int"))


BLOBS = RASTERS + """,
grid AS (SELECT *, CAST(unnest(range(w)) AS INT) AS x FROM
  (SELECT *, CAST(unnest(range(h)) AS INT) AS y FROM rasters)),
blobs AS (SELECT *, CAST((((x//3)*5 + (y//3)*3 + sample_id) % 3 = 0) <> ((x*11 + y*17 + sample_id) % 23 = 0) AS INT) AS v
  FROM grid)"""


# --- bands: measurements per order ---------------------------------------------------------------
# a row key for lineitem: (orderkey, linenumber) is not unique, so copies are counted
def bands(t: Tables) -> DataFrame:
    """sample_id, band, value."""
    return t.lineitem.select(F.col("l_orderkey").alias("sample_id"), F.expr(
        "stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) as (band, value)"))


BANDS = """bands AS (SELECT l_orderkey AS sample_id, unnest(['quantity','price','discount','tax']) AS band,
 unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"""


def band_pixels(t: Tables) -> DataFrame:
    """sample_id, y, x, band, value in 0..255 for three bands of the pixel grids."""
    v = (F.col("x") * 31 + F.col("y") * 17 + F.col("sample_id") * 7 + F.col("b") * 41) % 256
    return (grid(rasters(t)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .select("sample_id", "y", "x", F.element_at(F.array(*[F.lit(n) for n in "RGB"]), F.col("b") + 1).alias("band"),
                    v.cast("double").alias("value")))


BAND_PIXELS = RASTERS + """,
grid AS (SELECT *, CAST(unnest(range(w)) AS INT) AS x FROM
  (SELECT *, CAST(unnest(range(h)) AS INT) AS y FROM rasters)),
band_pixels AS (SELECT sample_id, y, x, ['R','G','B'][b+1] AS band,
  CAST((x*31 + y*17 + sample_id*7 + b*41) % 256 AS DOUBLE) AS value
  FROM (SELECT *, CAST(unnest(range(3)) AS INT) AS b FROM grid))"""


# --- depth pairs ---------------------------------------------------------------------------------
def depth(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("sample_id"), F.col("l_extendedprice").alias("gt"),
                             (F.col("l_quantity") * 1000).alias("pred"))


DEPTH = """depth AS (SELECT l_orderkey AS sample_id, l_extendedprice AS gt, l_quantity*1000 AS pred FROM lineitem)"""


# --- class scores: the first ten vector entries are the scores of the ten labels -------------------
def scores(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.slice("embedding", 1, 10).cast("array<double>").alias("scores"),
                               F.slice("embedding", 11, 10).cast("array<double>").alias("other"))


SCORES = """scores AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS scores,
  list_transform(embedding[11:20], lambda v: CAST(v AS DOUBLE)) AS other FROM embeddings),
long AS (SELECT vec_id, label, CAST(unnest(range(10)) AS INT) AS class_id, unnest(scores) AS s, unnest(other) AS o FROM scores)"""


# --- run log: one file per user, step in the JSON properties ---------------------------------------
def runlog(t: Tables) -> DataFrame:
    """file, pos (0-based line), step (NULL or 0 on some lines), key, value."""
    k = F.from_json("props", "k int")["k"]
    e = t.events.select("event_id", F.col("user_id").alias("file"), F.col("event_type").alias("key"), "value",
                        F.when(F.col("event_type") == "error", None).when(k % 7 == 0, 0).otherwise(k).alias("step"))
    return e.withColumnRenamed("event_id", "pos")


RUNLOG = """runlog AS (SELECT event_id AS pos, user_id AS file, event_type AS key, value,
  CASE WHEN event_type = 'error' THEN NULL
       WHEN CAST(json_extract(props, '$.k') AS INT) % 7 = 0 THEN 0
       ELSE CAST(json_extract(props, '$.k') AS INT) END AS step FROM events)"""
