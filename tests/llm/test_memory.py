"""What Python workers of the pipeline hold at once."""
from __future__ import annotations

import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import bytebpe
from rasterloom.llm.common import BATCH_BYTES, small_batches

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["n", "rows"])


def test_long_texts_reach_a_worker_in_small_batches(spark):
    before = spark.conf.get(SETTING)
    docs = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        got = small_batches(lambda spark: docs.mapInArrow(_sizes, "n bigint, rows bigint"))(spark).collect()
    finally:
        spark.conf.set(SETTING, before)
    assert max(r["n"] for r in got) < 1.25 * BATCH_BYTES and sum(r["rows"] for r in got) == 2000


def test_every_stage_bounds_its_batches(spark, tmp_path):
    before = spark.conf.get(SETTING)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(SETTING, before)
            try:
                stage(spark, None, str(tmp_path))           # no table: it ends, but after its session was set
            except Exception:
                pass
            assert spark.conf.get(SETTING) == str(BATCH_BYTES), name
    finally:
        spark.conf.set(SETTING, before)


def test_packed_rank_map_holds_every_pair_in_little_memory():
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tracemalloc.start()
    starts, codes = bytebpe.slotted(ranks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = bytebpe.pair_ranks(ranks)
    assert len(codes) == len(pairs) and {(c >> 40, c >> 20 & 0xFFFFF): c & 0xFFFFF for c in codes.tolist()} == pairs
    slot = [s for s in range(len(starts) - 1) for _ in range(starts[s + 1] - starts[s])]
    assert slot == [((c >> 40) * 40503 + (c >> 20 & 0xFFFFF) * 10007) % (1 << bytebpe.SLOT_BITS) for c in codes.tolist()]
    assert peak < 64 * len(pairs)


def test_rank_map_stands_in_no_plan_of_the_driver(spark, capsys):
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [f" no{i:x}x{w}" for i in range(400) for w in ("", "häß", "日本", "ing")] + ["a", "zq", "", None]
    table = spark.createDataFrame([(p,) for p in pieces + pieces[:50]], "piece string")
    coded = bytebpe.encode_pieces(table, ranks)
    capsys.readouterr()
    coded.explain(True)
    assert 0 < len(capsys.readouterr().out) < 50_000
    got = [(r["piece"], r["ids"]) for r in coded.collect()]
    assert len(got) == len(set(pieces)) - 2 and all(ids == bytebpe.fold(p.encode(), ranks) for p, ids in got if p.encode() not in ranks)
    assert {p for p, _ in got} == {p for p in pieces if p}
