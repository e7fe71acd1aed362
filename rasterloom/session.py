"""Session helpers: lineage cutting and scratch folders on shared storage."""
from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job of this library relies on.

    Size estimates made before a run are far too low after ``explode`` (a few megabytes of sample rows
    become gigabytes of pixels), so no join is broadcast on an estimate: only on a size measured by AQE
    at run time, or behind an explicit row count (``lookup_join``).
    """
    for key, value in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true"),
                       ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
                       ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")):
        spark.conf.set(key, value)
    return spark


SPREAD_ROWS = 8192      # rasters of a task, about a million pixels of 12 x 12 each


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deal out rows before they are multiplied: a short table in few files would explode in few tasks, a long one fill their memory.

    Rows are still narrow here. There is a partition for each core and for every ``rows`` rows, which are counted; tables that
    already have as many pass unchanged.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


TASK_ROWS = 1 << 20      # rows of a partition that a task sorts or groups


def dealt(df: DataFrame, *keys: str, wanted: int | None = None) -> DataFrame:
    """Partitioned by ``keys`` with about ``TASK_ROWS`` rows in each of ``wanted`` partitions, which are counted if not given; groupings
    and joins by these keys need no other shuffle."""
    if wanted is None:
        wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))
    return df.repartition(wanted, *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster, files written
    there would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="spark-rasterloom-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so iterative plans stay short and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name below the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
