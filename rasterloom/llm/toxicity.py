"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability p = sigmoid(b + sum of its features' weights), the bag
the noisy-or 1 - prod(1 - p). Only documents are labelled; the gradient of the bag's likelihood finds the sentences that
explain a label, so the fitted model also tells where the offending text is. Features of a sentence: its distinct words
and their beginnings (4 to 6 characters), hashed.

The model is fitted by numpy on a bounded sample of labelled rows: at most ``train_rows`` per label, chosen by a hash of
the doc_id among all labelled rows that qualify. Scoring runs over all documents in batches.

Defined results: a null or empty text has no sentence and score 0; several labels of one doc_id count as toxic if one is;
null labels are no labels; repeated rows are scored alike; without any labelled row, or with one label only, every
score is the share of toxic rows (0 without rows); other columns are not read.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, stored

SENTENCE = re.compile(r"[^.!?\n]+")
STRIP = ".,;:!?\"'()[]{}<>|#$%&*~`-_/\\=+"
CACHE_WORDS = 300_000


def features(token: str, bits: int) -> list[int]:
    """Hashed features of one token: the word and its beginnings."""
    word = token.lower().strip(STRIP)
    if not word:
        return []
    names = {f"w {word}"} | {f"b {word[:n]}" for n in (4, 5, 6) if len(word) >= n}
    return [xxhash.xxh64_intdigest(x) & ((1 << bits) - 1) for x in sorted(names)]


@dataclass
class BagModel:
    """Weights of the sentence model; ``constant`` is the score when nothing could be fitted."""
    bits: int = 18
    bias: float = 0.0
    weights: np.ndarray | None = None
    constant: float | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    def token_weight(self, token: str) -> float:
        got = self._cache.get(token)
        if got is None:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            got = self._cache[token] = float(sum(self.weights[f] for f in features(token, self.bits)))
        return got

    def sentence_logits(self, text: str) -> np.ndarray:
        weight, cache = self.token_weight, self._cache
        out = []
        for s in SENTENCE.findall(text):
            tokens = set(s.split())
            if tokens:
                total = self.bias
                for t in tokens:
                    w = cache.get(t)
                    total += weight(t) if w is None else w
                out.append(total)
        return np.array(out)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.sentence_logits(text or "")
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, in code points."""
        if self.constant is not None or not text:
            return []
        spans = [(m.start(), m.end()) for m in SENTENCE.finditer(text) if m.group().split()]
        return [(a, b, float(p)) for (a, b), p in zip(spans, 1 / (1 + np.exp(-self.sentence_logits(text))))]


def bag_features(text: str | None, bits: int, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all sentences, number of features of each sentence that has any)."""
    cols, sizes = array("i"), array("i")
    for s in SENTENCE.findall(text or ""):
        own = set()
        for t in set(s.split()):
            if t not in cache:
                cache[t] = features(t, bits)
            own.update(cache[t])
        if own:
            cols.extend(sorted(own))
            sizes.append(len(own))
    return np.array(cols, np.int32), np.array(sizes, np.int32)


def fit_bags(texts: list[str | None], labels: list[int], bits: int = 18, **options) -> BagModel:
    """``fit_features`` of texts in memory."""
    cache = {}
    bags = [(y, *bag_features(t, bits, cache)) for t, y in zip(texts, labels)]
    return fit_features(lambda: iter(bags), bits, **options)


def fit_features(bags: Callable[[], Iterator[tuple[int, np.ndarray, np.ndarray]]], bits: int = 18, rounds: int = 600, rate: float = 1.0, l1: float = 2e-5,
                 bias: float = -9.0) -> BagModel:
    """Maximum likelihood by Adagrad over the whole sample, weights kept at zero or above and sparse (soft threshold ``l1``).

    Evidence can only speak for toxicity, and the fixed ``bias`` keeps a sentence without evidence near zero, so a long
    clean document does not add up to a toxic one. ``bags()`` yields (label, features, sizes) of each text, and is read twice: the
    first time features are counted, the second time only those that may have a weight are held.
    """
    held, toxic, y, y_all = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), [], []          # bags with a feature
    for label, cols, sizes in bags():
        y_all.append(label)
        if len(sizes):
            y.append(label)
            at = np.unique(cols)
            held[at] += 1
            toxic[at] += label > 0
    y_all = np.array(y_all, float)
    if not len(y) or y_all.min() == y_all.max():
        return BagModel(bits, constant=float(y_all.mean()) if len(y_all) else 0.0)
    y = np.array(y, float)
    # features of three bags or more, with a larger share of the toxic bags than of the others
    able = (held >= 3) & (toxic / max(1, y.sum()) > 1.5 * (held - toxic) / max(1, (1 - y).sum()))
    ids, column, n_sent = np.flatnonzero(able), np.cumsum(able) - 1, 0
    sents, kept, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for _, cols, sizes in bags():
        if len(sizes):
            use = able[cols]
            sents.append(np.repeat(np.arange(n_sent, n_sent + len(sizes)), sizes)[use])
            kept.append(column[cols[use]])
            owner.append(len(sizes))
            n_sent += len(sizes)
    sent, cols, bag = np.concatenate(sents), np.concatenate(kept), np.repeat(np.arange(len(owner)), owner)
    w, b = np.full(len(ids), 0.5), bias
    gw = np.full(len(ids), 1e-8)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        z = b + np.bincount(sent, w[cols], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(bag, -np.logaddexp(0, z), len(y))
        none = np.exp(np.clip(log_none, -50, -1e-9))
        slope = np.where(y > 0, -none / (1 - none), 1.0) * weight / len(y)
        dz = slope[bag] * p
        dw = np.bincount(cols, dz[sent], len(ids))
        gw += dw * dw
        step = rate / np.sqrt(gw)
        w = np.maximum(w - step * (dw + l1), 0.0)
    full = np.zeros(1 << bits)
    full[ids] = w
    return BagModel(bits, float(b), full)


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", train_rows: int = 1500, bits: int = 18) -> BagModel:
    """Fit on at most ``train_rows`` rows of each label (those with the smallest hash of their doc_id, of the rows where ``use``).

    ``use`` is an expression over ``doc_id``. The executors make the features; the driver sees no text.
    """
    marked = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
                    .groupBy("doc_id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label")))
    marked = marked.filter(use) if use is not None else marked
    order = F.xxhash64("doc_id")
    chosen = [r[0] for y in (0, 1) for r in marked.filter(F.col("label") == y).orderBy(order, "doc_id").limit(train_rows).select("doc_id").collect()]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isin(chosen))
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text")).join(marked, "doc_id").select(F.col("doc_id").cast("string").alias("key"), "label", "text")

    def run(batches):
        cache = {}
        for b in batches:
            bags = [bag_features(t, bits, cache) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1)]],
                                             names=["key", "label", "cols", "sizes"])

    bags = stored(rows.mapInArrow(run, "key string, label int, cols binary, sizes binary").orderBy("key"), "bags")
    ints = lambda data: np.frombuffer(data, np.int32)
    return fit_features(lambda: ((r["label"], ints(r["cols"]), ints(r["sizes"])) for r in bags.orderBy("key").toLocalIterator()), bits)


def score_toxicity(docs: DataFrame, model: BagModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans holds (start, end, score) of the sentences with a probability of one half or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(ids, texts):
        own = shared.value
        plain = [None if t is None else t.decode() for t in texts]
        scores = [own.score(t) for t in plain]
        spans = [[{"start": a, "end": b, "score": p} for a, b, p in own.sentences(t) if p >= 0.5] if s >= 0.5 else [] for t, s in zip(plain, scores)]
        return {"doc_id": ids, "score": scores, "spans": spans}

    return arrow_map(named, run, f"doc_id {dict(named.dtypes)['doc_id']}, score double, spans array<struct<start:int,end:int,score:double>>", "doc_id", "text")


def drop_toxic(docs: DataFrame, model: BagModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score below ``threshold``; no shuffle, all columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
