"""Helpers the text operators share."""
from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: White space that separates words: space and the control characters 9 to 13 (fixed values).
SPACES = " \t\n\x0b\f\r"

#: Bytes of rows that a Python worker gets at once in ``small_batches``; the lists made from a batch are several times as large.
BATCH_BYTES = 4 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when the body's lambdas read it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """Words of a text (null: none)."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and whole after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage(spark, ...)`` in a session that bounds Arrow batches by bytes, not only by rows, from then on: texts are long, and
    a worker keeps what its largest batch took."""
    @functools.wraps(stage)
    def run(spark: SparkSession, *rest) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, *rest)
    return run


def arrow_map(df: DataFrame, fn: Callable[[list, list], dict], schema: str, keep: str, text: str) -> DataFrame:
    """Map batches of (keep, text as UTF-8 bytes) to columns named in ``schema``; ``keep`` stays the first column.

    ``fn(keeps, texts)`` gets Python lists and returns a dict of equally long columns.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keeps, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            out = fn(keeps, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], names=names)

    return df.select(F.col(keep), F.col(text).cast("string")).mapInArrow(run, schema)
