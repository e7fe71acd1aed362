"""Structured Streaming jobs: incremental scoring, windowed metrics, log forward-fill, tile scoring.

Every job reads a file stream, keeps its state in Spark's state store, and writes below the shared
folder; ``availableNow`` ends it when the input is drained, and a restarted job goes on from its
checkpoint.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import class_list
from ..operators.ordering import rank_rows
from ..operators.runlog import fill_steps
from ..operators.scoring import score
from ..session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _run(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def stream_areas(stream: DataFrame, n: int, gt: str = "gt", pred: str = "pred", ignore: int | None = 255) -> DataFrame:
    """Running class areas as one streaming aggregate (state: one row per class)."""
    rows = stream if ignore is None else stream.filter(F.col(gt) != ignore)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    hit = F.when(F.col(gt) == F.col(pred), one).otherwise(zero)
    sides = F.array(F.struct(F.col(gt).alias("class_id"), hit.alias("i"), zero.alias("p"), one.alias("l")),
                    F.struct(F.col(pred).alias("class_id"), zero.alias("i"), one.alias("p"), zero.alias("l")))
    long = rows.select(F.inline(sides)).filter(F.col("class_id").between(0, n - 1))
    return long.groupBy("class_id").agg(F.sum("i").alias("intersect"), F.sum("p").alias("pred_area"), F.sum("l").alias("label_area"))


def stream_seg_metrics(stream: DataFrame, n: int, gt: str = "gt", pred: str = "pred", ignore: int | None = 255) -> DataFrame:
    """Drain the stream batch by batch; returns the final areas of all n classes."""
    spark = stream.sparkSession
    out = scratch_path(spark, "seg-metrics")
    _run(stream_areas(stream, n, gt, pred, ignore), "complete", lambda df, _: df.write.mode("overwrite").parquet(f"{out}/areas"), f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/areas")
    full = class_list(got, n).join(got, "class_id", "left")
    full = full.select("class_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("intersect", "pred_area", "label_area")])
    return full.withColumn("union_area", F.col("pred_area") + F.col("label_area") - F.col("intersect"))


def windowed_metrics(df: DataFrame, ts: str, window: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean and maximum per tumbling window; works on batch and streaming tables."""
    return df.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))


def stream_windowed_metrics(stream: DataFrame, ts: str, window: str, watermark: str, value: str, by: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Periodic evaluation: every batch appends the partial aggregates of its rows, which add up per window.

    So a row counts however late it comes. ``n_late`` says how many rows of a window came more than ``watermark`` after the
    newest event time of the batches before. ``folder`` (output and checkpoint) lets a restarted job go on.
    """
    spark = stream.sparkSession
    out = folder or scratch_path(spark, "windows")

    def write(df, batch):
        # a retried batch replaces its own folder
        seen = spark.read.parquet(f"{out}/newest").filter(F.col("batch") < batch).agg(F.max("newest")).first()[0] if batch else None
        late = F.col(ts) < F.lit(seen) - F.expr(f"INTERVAL {watermark}") if seen is not None else F.lit(False)
        parts = df.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"),
                                                                     F.count(F.when(late, 1)).alias("n_late"))
        df.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/batch={batch}")
        parts.write.mode("overwrite").parquet(f"{out}/windows/run={batch}")
    _run(stream, "append", write, f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/windows")
    return rows.groupBy("w", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"), F.sum("n_late").alias("n_late"))


def stream_fill_steps(stream: DataFrame, file: str, pos: str, step: str = "step", key: str = "key", value: str = "value", folder: str | None = None) -> DataFrame:
    """Forward-fill of missing or zero steps per file; the state is the last step and position of each file.

    Rows are filled as they come. A row whose position lies before one already seen is flagged; files with such a row are
    filled once more from all their rows when the input is drained, so the result does not depend on the order of batches.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    class Fill(StatefulProcessor):
        def init(self, handle) -> None:
            from pyspark.sql.types import LongType, StructField, StructType
            self.last = handle.getValueState("last", StructType([StructField("step", LongType()), StructField("pos", LongType())]))

        def handleInputRows(self, k, rows, timerValues) -> Iterator:
            import pandas as pd
            pdf = pd.concat(list(rows)).sort_values("pos")
            carry, newest = self.last.get() if self.last.exists() else (0, None)
            seen = pdf["step"].where(pdf["step"] != 0)
            filled = seen.ffill().fillna(carry).astype("int64")
            late = pdf["pos"] < newest if newest is not None else pd.Series(False, index=pdf.index)
            top = int(pdf["pos"].iloc[-1])
            self.last.update((int(filled.iloc[-1]), top if newest is None else max(top, newest)))
            yield pd.DataFrame({"file": k[0], "pos": pdf["pos"], "key": pdf["key"], "value": pdf["value"], "step": filled, "given": seen, "late": late})

        def close(self) -> None:
            pass

    rows = stream.select(F.col(file).alias("file"), F.col(pos).alias("pos"), F.col(key).alias("key"), F.col(value).alias("value"),
                         F.col(step).cast("double").alias("step"))
    out = folder or scratch_path(spark, "steps")
    filled = rows.groupBy("file").transformWithStateInPandas(
        statefulProcessor=Fill(), outputStructType="file bigint, pos bigint, key string, value double, step bigint, given double, late boolean", outputMode="Append", timeMode="None")
    _run(filled, "append", lambda df, b: df.write.mode("overwrite").parquet(f"{out}/rows/run={b}"), f"{out}/checkpoint")
    done = spark.read.parquet(f"{out}/rows").drop("run")
    again = done.filter("late").select("file").distinct()
    in_order = done.join(again, "file", "left_anti").drop("given", "late")
    redone = done.join(again, "file", "left_semi").withColumn("step", F.col("given")).drop("given", "late")
    # positions are dense within a file in a whole log; ranks make them so
    ranked = rank_rows(redone, ["pos"], ["file"], name="_at")
    return in_order.unionByName(fill_steps(ranked, "file", "_at").drop("_at").withColumn("step", F.col("step").cast("bigint")))


def stream_score(stream: DataFrame, make_model: Callable, schema: str, sink: str, batch_size: int = 1024) -> None:
    """Read, score, write; each batch owns one folder of the sink, so a retry does not duplicate rows."""
    _run(stream, "append", lambda df, b: score(df, make_model, schema, batch_size).write.mode("overwrite").parquet(f"{sink}/rows/run={b}"), f"{sink}/checkpoint")
