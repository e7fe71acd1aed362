"""Centroid clustering (Lloyd's rounds) with the dimensions dealt to shards, in exact integers.

Vectors are cut into chunks of rows and every chunk into blocks of columns. A block's key is (chunk, shard) and blocks stay where
a hash of the key has put them; only numbers about them move. In a round the task of a block computes exact partial distances from its
columns to its slice of the centroids, ``reduceByKey`` adds the blocks of a chunk and takes the nearest centroid, the
assignments go back to the blocks, and each shard adds up its columns by cluster and so gets its own slice of the new centroids.
The driver holds the slices (clusters x dimensions numbers, whatever the number of vectors) and nothing else.

Numbers are 64-bit where no distance can leave 64 bits, else Python's own whole numbers, so every step is exact. Sums are
the same in whatever order tasks end, so a repeated task changes nothing.

Defined results: vectors of another length, null vectors and those with a null or non-finite component are left out; repeated rows are
vectors of their own; equal distances go to the smaller number; a centroid without vectors stays; fewer vectors than
centroids make fewer centroids; null ids come last among the starting points; a distance or inertia beyond 64 bits is null; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

MOST = (1 << 63) - 1


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of doubles: 64-bit numbers if no squared distance of such rows can pass 64 bits, else Python's."""
    scaled = np.floor(scale * rows)
    if not scaled.size or np.abs(scaled).max() < math.isqrt(MOST // rows.shape[1]) // 2:
        return scaled.astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 2.0 ** 50 else int(v) * scale for v in r] for r in rows.tolist()], object)


def fitting(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(vec_id, v as doubles) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("vec_id"), v.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return whole(np.array([r["v"] for r in rows], float), scale) if rows else np.empty((0, 0), np.int64)


def column_blocks(kept: DataFrame, size: int, scale: int, shards: int, chunk_rows: int) -> DataFrame:
    """(chunk, shard, values) for each block of columns and (chunk, ids) once for each chunk, written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind, id_type = dict(kept.dtypes)["vec_id"], to_arrow_type(kept.schema["vec_id"].dataType)
    names = ["chunk", "shard", "values", "ids"]

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                piece = batch.slice(at, chunk_rows)
                data = whole(piece.column(1).flatten().to_numpy().reshape(-1, size), scale)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * (shards + 1), pa.int64()), pa.array([*range(shards), None], pa.int32()),
                    pa.array([*[to_bytes(p) for p in np.array_split(data, shards, 1)], None], pa.binary()),
                    pa.array([*[None] * shards, piece.column(0).to_pylist()], pa.list_(id_type))], names=names)
                chunk += 1

    return stored(kept.mapInArrow(run, f"chunk bigint, shard int, values binary, ids array<{kind}>"), "column-blocks")


def to_bytes(block: np.ndarray) -> bytes:
    """A block behind its number of columns: 64-bit numbers as they are, others as text."""
    head = np.array([block.shape[1]], "<i8").tobytes()
    if block.dtype == object:
        return b"t" + head + ",".join(map(str, block.ravel().tolist())).encode()
    return b"i" + head + np.ascontiguousarray(block, "<i8").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    width = int(np.frombuffer(data[1:9], "<i8")[0])
    if data[:1] == b"t":
        return np.array([int(x) for x in bytes(data[9:]).decode().split(",")], object).reshape(-1, width)
    return np.frombuffer(data[9:], "<i8").reshape(-1, width)


def slices_of(centroids: np.ndarray, shards: int) -> list[np.ndarray]:
    return np.array_split(centroids, shards, 1)


def partial_distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the centroids over the columns of one block."""
    return np.stack([((block - c) ** 2).sum(1) for c in centroids], 1)


def nearest(blocks: RDD, centroids: np.ndarray, shards: int, parts: int) -> RDD:
    """(chunk, (cluster, distance) arrays): the blocks of a chunk are added up, then the nearest centroid is taken."""
    slices = slices_of(centroids, shards)
    exact = centroids.dtype != object

    def partial(item):
        (chunk, shard), data = item
        block, own = from_bytes(data), slices[shard]
        return chunk, partial_distances(block if exact else block.astype(object), own)

    def choose(d):
        cluster = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()]) if d.dtype == object else d.argmin(1)
        return cluster, d[np.arange(len(d)), cluster]

    return blocks.map(partial).reduceByKey(np.add, parts).mapValues(choose)


def updated(blocks: RDD, assigned: RDD, centroids: np.ndarray, shards: int, parts: int) -> np.ndarray:
    """The new centroids: each shard adds up its columns by cluster and divides by the number of vectors."""
    k, slices = len(centroids), slices_of(centroids, shards)

    def sums(item):
        (_, shard), (data, cluster) = item
        block = from_bytes(data)
        total = np.zeros((k, block.shape[1]), object if block.dtype == object else np.int64)
        np.add.at(total, cluster, block)
        return shard, (total.astype(object), np.bincount(cluster, minlength=k))

    def divide(item):
        shard, (total, n) = item
        return shard, np.array([[x // int(n[c]) for x in row] if n[c] else slices[shard][c].tolist() for c, row in enumerate(total.tolist())], object)

    back = assigned.flatMap(lambda item: [((item[0], s), item[1][0].astype(np.int32)) for s in range(shards)]).partitionBy(parts)
    found = dict(blocks.join(back).map(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards).map(divide).collect())
    new = np.concatenate([found[s].reshape(k, -1) for s in range(shards)], 1)
    small = max(map(abs, new.ravel().tolist())) < math.isqrt(MOST // new.shape[1]) // 2
    return new.astype(np.int64) if small else new


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3,
             scale: int = 1024, shards: int = 4, chunk_rows: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids)."""
    spark, shards = vectors.sparkSession, max(1, min(shards, size))
    kept = fitting(vectors, id_col, vec_col, size)
    kind = dict(kept.dtypes)["vec_id"]
    schema = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(kept, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    table = column_blocks(kept, size, scale, shards, chunk_rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = table.filter("shard IS NOT NULL").select("chunk", "shard", "values").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2]))).partitionBy(parts)
    parts = blocks.getNumPartitions()
    for _ in range(rounds):
        centroids = updated(blocks, nearest(blocks, centroids, shards, parts), centroids, shards, parts)
    fits = lambda x: int(x) if x <= MOST else None
    last = nearest(blocks, centroids, shards, parts).map(lambda item: (item[0], item[1][0].tolist(), [fits(x) for x in item[1][1].tolist()]))
    final = stored(spark.createDataFrame(last, "chunk bigint, cluster array<int>, distance array<bigint>"), "assigned")
    # one row for each cluster, so this and the centroids are bounded by their number
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    totals = dict(final.select(F.inline(F.arrays_zip("cluster", "distance"))).groupBy("cluster").agg(total).collect())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = None not in totals.values()
    inertia = fits(int(sum(totals.values()))) if known else None
    facts = spark.createDataFrame([(c, fits(int(t)) if t is not None else None, inertia, digest[c]) for c, t in totals.items()],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = table.filter("shard IS NULL").select("chunk", "ids").join(final, "chunk").select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
