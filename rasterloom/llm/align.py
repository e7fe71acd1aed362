"""Alignment of the tokens of two tokenizers, with link statistics of a whole corpus.

Both tokenizers cut the same bytes. Where a token of either ends at the same byte, the text has a shared cut; shared cuts
split it into groups of tokens. They are found by divide and conquer: an interval is cut at a shared end near its middle,
each end of the one tokenizer being looked up among the ends of the other by bisection, farther and farther from the middle;
both halves are intervals again, and an interval without a shared end inside is a leaf, that is a group. All
intervals of one depth are worked on together in numpy, so the depth of the recursion is the number of Python steps.

Inside a group each stretch between neighbouring ends of either tokenizer is one overlapping pair of tokens: a link.
How often an id pair is linked in the corpus is added up over blocks of texts (about ``block_bytes`` each). A block lists
its distinct pairs once and gets back the counts of just these, so what moves stays below the input, no task holds the
counts of the corpus, and nothing but one row for each id of the second vocabulary is broadcast.

Defined results: a null or empty text has no tokens, nor has one whose tokens do not give back its bytes; all its numbers
are 0 and its groups are the empty string. Repeated rows count each time; a null doc_id stays; an empty table gives an
empty result; other columns are not read. Texts are never cut, and strings of special tokens are plain text.
"""
from __future__ import annotations

import hashlib
import os
import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .repair import byte_letters

PIECE = 1 << 20
CACHE_PIECES = 300_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Pair:
    """Paths of a byte-level tokenizers file (A) and of a sentencepiece model with byte fallback (B)."""
    a: str
    b: str


class Loaded:
    """Both tokenizers with the bytes of every token. A gets a space before the text, as B puts one there by itself."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.first, self.second = Tokenizer.from_str(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.first.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size())]
        self.a = [bytes([byte_of[c] for c in n]) if all(c in byte_of for c in n) else n.encode() for n in names]
        self.b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = np.array([len(x) for x in self.a]), np.array([len(x) for x in self.b])
        # decimal ids with what follows them: inside and at the end of an A run, inside and at the end of a B run
        decimal = [[b"%d%s" % (i, mark) for i in range(n)] for n, marks in ((len(self.a), b",|"), (len(self.b), b",;")) for mark in (marks[:1], marks[1:])]
        self.decimal = np.array(list(chain(*decimal)), object)
        # a piece of B with a blank behind another character would join what the pieces keep apart: then a text is one piece
        joins = any("▁" in self.second.id_to_piece(i).lstrip("▁") for i in range(len(self.b)))
        self.blank = re.compile(r"(?!)" if joins else r"(?<=\S) (?=\S)")
        self.clear()

    def slots(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces in the cache; new ones are encoded."""
        if len(self.place) > CACHE_PIECES or len(self.store[0]) > 8 * CACHE_PIECES:
            self.clear()
        new = list(dict.fromkeys(p for p in pieces if p not in self.place))
        for at in range(0, len(new), 5000):
            own = new[at:at + 5000]
            whole = [" " + p for p in own]
            first = [e.ids for e in self.first.encode_batch(whole, add_special_tokens=False)]
            second = self.second.encode(own, num_threads=1)
            self.place.update(zip(own, range(len(self.good), len(self.good) + len(own))))
            self.good.extend(self.same("".join(whole), first, second) or [bool(self.same(w, [a], [b])) for w, a, b in zip(whole, first, second)])
            for store, size, ids in zip(self.store, self.size, (first, second)):
                store.extend(chain.from_iterable(ids))
                size.extend(map(len, ids))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def same(self, whole: str, first: list[list[int]], second: list[list[int]]) -> list[bool] | None:
        """True for each piece if the tokens of both give back the bytes of all."""
        data = whole.encode()
        ok = all(b"".join(map(table.__getitem__, chain.from_iterable(ids))) == data for table, ids in ((self.a, first), (self.b, second)))
        return [True] * len(first) if ok else None

    def clear(self) -> None:
        self.place, self.good = {}, array("b")
        self.store, self.size = (array("I"), array("I")), (array("I"), array("I"))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A of all texts, their number in each text, ids of B, their number); none where the tokens do not give back the bytes.

        Pieces between single blanks are encoded once: neither tokenizer joins what lies on both sides of a blank between two
        characters that are not white space."""
        pieces, n_pieces = [], []
        for t in texts:
            try:
                own = (t or b"").decode()
                own = self.blank.split(own) if own else []
            except UnicodeDecodeError:
                own = []
            pieces += own
            n_pieces.append(len(own))
        at, of = self.slots(pieces), np.repeat(np.arange(len(texts)), n_pieces)
        bad = np.unique(of[np.array(self.good, bool)[at] == 0])
        use = ~np.isin(of, bad)
        at, of, out = at[use], of[use], []
        for store, size in zip(self.store, self.size):
            flat, size = np.array(store, np.int64), np.array(size, np.int64)
            start, own = np.cumsum(size) - size, size[at]
            ends = np.cumsum(own)
            out += [flat[np.repeat(start[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)], np.bincount(of, own, len(texts)).astype(np.int64)]
        return tuple(out)


_LOADED: dict[str, Loaded] = {}


def loaded(spec: str, model: bytes) -> Loaded:
    """One pair of tokenizers per worker process and vocabularies."""
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Loaded(spec, model)
    return _LOADED[key]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_texts: np.ndarray) -> np.ndarray:
    """Positions in ``a_ends`` (ascending, like ``b_ends``) of the last A token of each group. ``a_texts`` has the position of
    the last token of each text; texts lie one behind the other, so the last ends of both tokenizers are shared."""
    high = a_texts.astype(np.int64)
    low = np.concatenate([[0], high[:-1] + 1]) if len(high) else high
    done = [high]
    while len(low):
        middle = (low + high - 1) // 2
        cut = np.full(len(low), -1, np.int64)
        open_, near, far = np.flatnonzero(high > low), 0, 1
        while len(open_):
            step = np.arange(near, far)
            places = np.stack([middle[open_, None] + step, middle[open_, None] - step], 2).reshape(len(open_), -1)
            inside = (places >= low[open_, None]) & (places < high[open_, None])
            value = a_ends[np.where(inside, places, high[open_, None])]
            at = np.searchsorted(b_ends, value)                    # bisection among the other tokenizer's ends
            hit = inside & (b_ends[np.minimum(at, len(b_ends) - 1)] == value)
            first = hit.argmax(1)                                  # nearest to the middle
            found = hit[np.arange(len(open_)), first]
            cut[open_[found]] = places[found, first[found]]
            open_ = open_[~found]
            near, far = far, 2 * far
            open_ = open_[(middle[open_] + near < high[open_]) | (middle[open_] - near >= low[open_])]
        split = cut >= 0                                           # the others are leaves
        done.append(cut[split])
        low, high = np.concatenate([low[split], cut[split] + 1]), np.concatenate([cut[split], high[split]])
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
    return np.sort(np.concatenate(done))


def align(encoded: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tokens: Loaded) -> dict:
    """Groups and links of some texts: counts per text, the groups as text, and (text, pair code, times) of distinct links."""
    a, n_a, b, n_b = encoded
    full = np.flatnonzero(n_a)
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(n_a), np.int64), "n_links": np.zeros(len(n_a), np.int64), "groups": [b""] * len(n_a)}
    if not len(full):
        return out | {"text": full, "code": full, "times": full}
    a_ends, b_ends = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b])
    a_last = shared_cuts(a_ends, b_ends, np.cumsum(n_a)[full] - 1)
    b_last = np.searchsorted(b_ends, a_ends[a_last])
    text_of = np.repeat(np.arange(len(n_a)), n_a)
    out["n_groups"] = np.bincount(text_of[a_last], minlength=len(n_a))
    # links: one for each stretch between neighbouring ends
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.diff(ends, append=ends[-1] + 1) > 0]
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    width = len(tokens.a) * len(tokens.b)
    key, times = np.unique(text_of[i] * width + a[i] * len(tokens.b) + b[j], return_counts=True)
    out["n_links"] = np.bincount(text_of[i], minlength=len(n_a))
    # groups as text: the tokens of a group, A before B, each with the mark that follows it
    a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in (a_last, b_last))
    b_before, a_before = np.concatenate([[0], b_last + 1]), a_last + 1
    order = np.empty(len(a) + len(b), np.int64)
    a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_mark[a_last], b_mark[b_last] = len(tokens.a), len(tokens.b)
    order[np.arange(len(a)) + b_before[a_group]] = a + a_mark
    order[np.arange(len(b)) + a_before[b_group]] = 2 * len(tokens.a) + b + b_mark
    words, at = tokens.decimal[order].tolist(), 0
    for k in full.tolist():
        end = at + int(n_a[k] + n_b[k])
        out["groups"][k] = b"".join(words[at:end])[:-1]
        at = end
    return out | {"text": key // width, "code": key % width, "times": times}


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.array([len(numbers)], "<u4").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:4], "<u4")[0])
    planes = pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _features(spec, model, id_type: pa.DataType, block_bytes: int, keep_groups: bool):
    def rows(block, ids, parts):
        """One row for each text, with its links as positions among the block's sorted codes, and one for each code."""
        base = np.cumsum([0, *[len(p["n_a"]) for p in parts]])
        text = np.concatenate([p["text"] + at for p, at in zip(parts, base)])
        code, times = (np.concatenate([p[k] for p in parts]) for k in ("code", "times"))
        codes, place = np.unique(code, return_inverse=True)
        total = np.bincount(place, times, len(codes)).astype(np.int64)
        bounds = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
        places = [pack(np.diff(place[s:e], prepend=0)) for s, e in zip(bounds, bounds[1:])]
        repeats = [pack(times[s:e]) for s, e in zip(bounds, bounds[1:])]
        own = {k: np.concatenate([p[k] for p in parts]) for k in COUNTS}
        groups = list(chain.from_iterable(p["groups"] for p in parts))
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        n, m = len(ids), len(codes)
        cols = {"block": pa.array(np.full(n + m, block), pa.int64()),
                "doc_id": pa.concat_arrays([pa.array(ids, id_type), pa.nulls(m, id_type)]),
                **{k: pa.concat_arrays([pa.array(own[k], pa.int64()), pa.nulls(m, pa.int64())]) for k in COUNTS},
                "groups_sha256": pa.concat_arrays([pa.array(digests, pa.string()), pa.nulls(m, pa.string())]),
                "groups": pa.concat_arrays([pa.array([g.decode() for g in groups] if keep_groups else [None] * n, pa.string()), pa.nulls(m, pa.string())]),
                "places": pa.concat_arrays([pa.array(places, pa.binary()), pa.nulls(m, pa.binary())]),
                "times": pa.concat_arrays([pa.array(repeats, pa.binary()), pa.nulls(m, pa.binary())]),
                "code": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(codes, pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(total, pa.int64())])}
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        tokens = loaded(spec.value, model.value)
        block, size, held, ids, parts, texts = TaskContext.get().partitionId() << 24, 0, 0, [], [], []

        def take():
            if texts:
                parts.append(align(tokens.encode(texts), tokens))
                texts.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = text.as_buffer().to_pybytes() if text.is_valid else None
                ids.append(key)
                texts.append(own)
                length = len(own or b"") + 64
                size, held = size + length, held + length
                if held >= PIECE:
                    take()
                    held = 0
                if size >= block_bytes:
                    take()
                    yield rows(block, ids, parts)
                    block, size, held, ids, parts = block + 1, 0, 0, [], []
        take()
        if ids:
            yield rows(block, ids, parts)
    return run


def _sums(id_type: pa.DataType, keep: list[str]):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        order = np.argsort(values["code"].to_numpy())
        count, best = values["count"].to_numpy()[order], values["best"].to_numpy()[order]
        n_best, total = [], []
        for places, repeats in zip(docs["places"].to_pylist(), docs["times"].to_pylist()):
            place, times = np.cumsum(unpack(places)), unpack(repeats)
            n_best.append(int(times[best[place]].sum()))
            total.append(int((times * count[place]).sum()))
        cols = [docs[c].combine_chunks() for c in keep]
        return pa.table([*cols, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*keep, "n_best", "count_sum"])
    return run


def aligned(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16_000_000,
            keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 [, groups]) of every text.

    ``count_sum`` adds up, over the links of a text, how often their id pair is linked in the corpus; ``n_best`` counts the links
    whose pair is the most frequent one of its B id (ties included). ``groups`` is ``a1,a2|b1;a3|b2,b3``.
    """
    spark = docs.sparkSession
    with open(pair.a, encoding="utf-8") as f:
        spec = f.read()
    with open(pair.b, "rb") as f:
        model = f.read()
    width = len(loaded(spec, model).b)
    spec, model = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(model)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    kind, id_type = dict(named.dtypes)["doc_id"], to_arrow_type(named.schema["doc_id"].dataType)
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    rows = stored(named.mapInArrow(_features(spec, model, id_type, block_bytes, keep_groups),
                                   f"block bigint, doc_id {kind}, {counts}, groups_sha256 string, groups string, places binary, times binary, code bigint, n bigint"), "aligned")
    pairs = rows.filter("code IS NOT NULL")
    linked = stored(pairs.groupBy("code").agg(F.sum("n").alias("count")), "linked")
    second = (F.col("code") % width).cast("int")
    most = linked.groupBy(second.alias("second")).agg(F.max("count").alias("most"))          # at most one row for each B id
    ranked = linked.withColumn("second", second).join(F.broadcast(most), "second").select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    values = pairs.select(F.col("block").alias("slice"), "code").join(ranked, "code").select("slice", "code", "count", "best")
    keep = ["doc_id", *COUNTS, "groups_sha256", *["groups"] * keep_groups]
    texts = rows.filter("code IS NULL").select("block", *keep, "places", "times")
    return texts.groupBy("block").cogroup(values.groupBy("slice")).applyInArrow(
        _sums(id_type, keep), f"doc_id {kind}, {counts}, groups_sha256 string, " + "groups string, " * keep_groups + "n_best bigint, count_sum bigint")
