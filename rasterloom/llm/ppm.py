"""Language-model scores by prediction by partial matching (PPM), learned and applied with Spark.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of the bytes that followed in the training
texts. The probability of a byte is its share in the longest context, of count plus number of different followers; a
byte not seen there takes the escape share (number of different followers) and is looked for in the context without its
first byte, among the bytes not seen in the longer one (symbol exclusion), down to a uniform share of the bytes never
seen. A text's score is the sum of log10 probabilities of its bytes and an end mark.

The followers of a context are a subset of those of its shortened context, because all orders count the same places.
So after an escape exactly the followers of the last context are excluded, and the denominator depends on that context
only: every order is two joins and an aggregate over distinct contexts, never over the text. Groups have at most 256
rows.

Texts are dealt into blocks of about ``block_bytes``. Each block lists its distinct byte runs and words with their
training counts; the counts are added up over the blocks, and each block gets back the values of just the runs and words
that it has. So what moves grows with the input and stays below it, no task holds the model, and nothing is broadcast.

Word counts for the base score (a smoothed unigram model) travel the same way.

Defined results: a null or empty text has one token (its end) and one symbol; repeated rows are scored alike and count
each time in training; a null doc_id is not held out by the query's rule; without training rows every byte has the
uniform share; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Bytes that no UTF-8 text holds: padding before a text, and its end.
PAD, END = 0xFE, 0xFF
#: Stands for the end of a text among the words; a word holds no blank.
END_WORD = b" "
PIECE = 1 << 20


def runs(texts: list[bytes], order: int) -> np.ndarray:
    """Codes of the runs of ``order`` + 1 bytes that end at each byte of the texts and at their end marks, in order."""
    pad, end = bytes([PAD]) * order, bytes([END])
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    code = np.zeros(len(flat) - order, np.int64)
    for k in range(order + 1):
        code = code << 8 | flat[k:k + len(code)]
    return code[flat[order:] != PAD]


def _pieces(texts: list[bytes]):
    """Slices of the list with about ``PIECE`` bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _lower(column: pa.ChunkedArray) -> list[bytes]:
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _count(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def _features(order: int):
    def run(block_docs: pa.Table) -> pa.Table:
        block, texts, train = block_docs["block"][0].as_py(), _lower(block_docs["text"]), block_docs["train"].to_pylist()
        words, codes, counts = Counter(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for use in (True, False):
            own = [t for t, x in zip(texts, train) if x == use]
            for a, b in _pieces(own):
                code, n = np.unique(runs(own[a:b], order), return_counts=True)
                codes.append(code)
                counts.append(n if use else np.zeros(len(n), np.int64))
                if len(codes) > 16:
                    code, n = _count(codes, counts)
                    codes, counts = [code], [n]
            for t in own:
                if use:
                    words.update(t.split())
                else:
                    words.update(dict.fromkeys(t.split(), 0))
        words[END_WORD] = sum(train)
        code, n = _count(codes, counts)
        none = lambda k, t: pa.nulls(k, t)
        size = len(code) + len(words)
        return pa.table({"block": pa.array(np.full(size, block), pa.int64()),
                         "code": pa.concat_arrays([pa.array(code), none(len(words), pa.int64())]),
                         "word": pa.concat_arrays([none(len(code), pa.binary()), pa.array(list(words), pa.binary())]),
                         "n": pa.concat_arrays([pa.array(n), pa.array(list(words.values()), pa.int64())])})
    return run


def _shortened(level: int) -> int:
    """Mask of a code without its first byte, at a level of ``level`` context bytes."""
    return (1 << (8 * level)) - 1


def run_values(counts: DataFrame, order: int) -> DataFrame:
    """(code, value): log10 probability of the last byte of each run, from (code, n) with the training counts of all runs."""
    levels = [counts.select("code", "n")]
    for k in range(order, 0, -1):
        levels.append(levels[-1].groupBy(F.col("code").bitwiseAND(F.lit(_shortened(k))).alias("code")).agg(F.sum("n").alias("n")))
    levels = [stored(x, f"order-{order - i}") if i else x for i, x in enumerate(levels)][::-1]
    # order 0: one context; after an escape from it a byte has a uniform share of those never seen
    n, q = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    below = levels[0].select("code", "n", F.lit(n).cast("bigint").alias("total"), F.lit(q).cast("bigint").alias("kinds"), F.lit(1.0 / max(1, 256 - q)).alias("after"))
    for k in range(1, order + 1):
        short = below.select(F.col("code").alias("short"), F.col("n").alias("n1"), F.col("total").alias("total1"), F.col("kinds").alias("kinds1"), F.col("after").alias("after1"))
        both = levels[k].withColumn("short", F.col("code").bitwiseAND(F.lit(_shortened(k)))).join(short, "short").withColumn("context", F.shiftright("code", 8))
        seen = both.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds"),
                                           F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n1"))), F.lit(0)).alias("hidden"))
        left = F.col("total1") - F.col("hidden") + F.col("kinds1") - F.col("kinds")
        after = (F.when(left == 0, F.col("after1")).when(F.col("n1") > 0, F.col("n1") / left)
                 .otherwise((F.col("kinds1") - F.col("kinds")) / left * F.col("after1")))
        below = stored(both.join(seen, "context").select("code", "n", "total", "kinds", after.alias("after")), f"shares-{k}")
    share = (F.when(F.col("n") > 0, F.col("n") / (F.col("total") + F.col("kinds"))).when(F.col("total") == 0, F.col("after"))
             .otherwise(F.col("kinds") / (F.col("total") + F.col("kinds")) * F.col("after")))
    return below.select("code", F.log10(share).alias("value"))


def _scores(order: int, total: int, kinds: int, id_type: pa.DataType):
    unseen = math.log10(0.5 / (total + 0.5 * (kinds + 1)))

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        texts = _lower(docs["text"])
        is_run = values["word"].is_null()
        byte_runs, own_words = values.filter(is_run), values.filter(pa.compute.invert(is_run))
        code, value = byte_runs["code"].to_numpy(), byte_runs["value"].to_numpy()
        by = np.argsort(code)
        code, value = code[by], value[by]
        n = own_words["value"].to_numpy()
        logs = np.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))
        known = dict(zip(own_words["word"].to_pylist(), logs.tolist()))
        n_tokens, n_known, base, score = [], [], [], []
        for a, b in _pieces(texts):
            got = value[np.searchsorted(code, runs(texts[a:b], order))]
            score += np.add.reduceat(got, np.cumsum([0, *[len(t) + 1 for t in texts[a:b - 1]]])).tolist()
            for t in texts[a:b]:
                words = t.split()
                words.append(END_WORD)
                own = np.fromiter(map(known.__getitem__, words), float, len(words))
                n_tokens.append(len(words))
                n_known.append(int((own > unseen + 1e-9).sum()))
                base.append(float(own.sum()))
        return pa.table([pa.array(docs["doc_id"].to_pylist(), id_type), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score)], names=names)
    return run


def ppm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 4, block_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score); ``train`` is an expression over doc_id that marks training rows.

    ``order`` is at most 6 (a run must fit a 64-bit code).
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be between 1 and 6")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    dealt = named.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"),
                         F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_blocks)).cast("bigint").alias("block"))
    features = stored(dealt.groupBy("block").applyInArrow(_features(order), "block bigint, code bigint, word binary, n bigint"), "features")
    run_rows, word_rows = features.filter("code IS NOT NULL"), features.filter("word IS NOT NULL")
    words = stored(word_rows.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    values = run_values(stored(run_rows.groupBy("code").agg(F.sum("n").alias("n")), "runs"), order)
    slices = (run_rows.select("block", "code").join(values, "code").select("block", "code", F.lit(None).cast("binary").alias("word"), "value")
              .union(word_rows.select("block", "word").join(words, "word").select("block", F.lit(None).cast("bigint"), "word", F.col("n").cast("double"))))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = dict(named.dtypes)["doc_id"]
    scored = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(
        _scores(order, total, kinds, to_arrow_type(named.schema["doc_id"].dataType)), f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
