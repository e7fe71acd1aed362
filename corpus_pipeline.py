"""Cleaning of a document corpus for training: five stages, each a Spark job over what the one before kept.

``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents`` of a folder. The result of each stage but the last is
written as Parquet to the shared folder and read again, so a lost executor repeats one stage's tasks only.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import bytebpe, decontaminate, linededup, simhash, toxicity
from rasterloom.llm.common import small_batches, stored


@small_batches
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; the model is fitted on a bounded sample of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


@small_batches
def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; ``n_chars`` follows the text."""
    return linededup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


@small_batches
def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (Jaccard similarity of five-word shingles of 0.8 or more)."""
    return simhash.near_duplicates_dropped(docs)


@small_batches
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): byte-level BPE ids as little-endian unsigned 32-bit integers."""
    codec = bytebpe.build_codec(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.encoded(docs, codec)


STAGES = [("toxicity", toxic_out), ("line_dedup", repeated_lines_out), ("near_duplicates", near_copies_out),
          ("decontamination", benchmark_out), ("byte_bpe", to_tokens)]

#: A fitted model, chunk hashes and merges have no SQL twin; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
