"""The registered text queries and the pipeline: SQL twins, contracts, and the pipeline against a brute-force version."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import linededup, queries, toxicity
from tests.llm import cases
from tests.oracle import ROOT, duck

SF = f"{ROOT}/sf0.001"
COLUMNS = {
    "op1_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2_": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_": {"doc_id": "bigint", "licence": "string"},
    "op7_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_": {"doc_id": "bigint", "text_sha256": "string"},
    "op9_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11_": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op12_": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op13_": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
}
INPUT = {"op12_": "pages", "op13_": "embeddings"}


def test_one_query_for_each_operator():
    for prefix in COLUMNS:
        assert sum(name.startswith(prefix) for name in entry.queries()) == 1
    assert "pipeline" in entry.queries() and set(queries.SQL) == {"op1_quality", "op6_licences", "op10_decontamination", "op12_warc", "op13_clusters"}


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    out = queries.QUERIES[name](spark, SF)
    assert COLUMNS[prefix].items() <= dict(out.dtypes).items()
    assert out.count() == duck(SF).sql(f"select count(*) from {INPUT.get(prefix, 'documents')}").fetchall()[0][0]


def test_pipeline_by_brute_force(spark, tmp_path):
    import numpy as np
    import tiktoken
    rows = [r for r in cases.documents(seed=8) if r[0] is not None]
    labels = [(i, int("idiot" in (t or "")), 1) for i, t, *_ in rows if i < 50]
    items = [(1, " ".join(rows[1][1].split()[2:20])), (2, "no such words anywhere at all in here my friend")]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = {i: y for i, y, _ in labels}
    sample = sorted(((i, t) for i, t, *_ in {r[0]: r for r in rows}.values() if i in known), key=lambda r: str(r[0]))
    model = toxicity.fit_bags([t for _, t in sample], [known[i] for i, _ in sample])
    kept = [(i, t) for i, t, *_ in rows if model.score(t) < 0.7]
    kept = cases.one_of_each_group(cases.without_repeated_lines(kept, linededup.chunks))
    kept = [r for r, h in zip(kept, cases.benchmark_hits(kept, items)) if not h[2]]
    ranks = corpus_pipeline.bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert 0 < len(want) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names, name
    empty = docs.filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
