"""Byte-level BPE encoding and decoding.

Encoding has two steps. First the distinct blank-separated words of all documents are counted; the most frequent
``dictionary_words`` of them (a documented bound) are cut by the split pattern and each distinct piece is encoded by Spark
higher-order functions: a piece is an array of byte ids, and a fold joins, piece length minus one times, the neighbouring
pair of lowest rank, leftmost first, looked up in a rank map (pairs hashed to slots of two arrays: a table of one row, broadcast
to blocks of pieces, as literals would stand in every copy and description of the plan that the driver makes).
Second, all texts are put together from that dictionary. Words outside it go through the same fold, written in Python,
in the task that meets them; so the dictionary only saves work, and results do not depend on its size. Texts are never
shuffled.

Cutting a text at single blanks between two other characters cannot cut a match of the pattern, because a match holds a
blank at its beginning only; a text with other white space around blanks is cut by the pattern as a whole.

Decoding concatenates the pieces' bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; an empty
table gives an empty result; columns other than the id are not read.
"""
from __future__ import annotations

import base64
import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, let, stored

SLOT_BITS = 15
BLOCK_PIECES = 256
CACHE_WORDS = 150_000       # of each of a worker's two caches, about 30 MB each when full


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 bytes and rank; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined bytes, for all ways to cut a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the neighbours of lowest rank, leftmost first, until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    joined = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    none = 1 << 60
    joined = [none if r is None else r for r in joined]
    while joined:
        low = min(joined)
        if low == none:
            break
        i = joined.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


# --- the fold as higher-order functions ---------------------------------------------------------------
def slotted(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts of each slot, codes ordered by slot and pair) of ``pair_ranks``, packed: the driver holds no objects of the pairs."""
    own = array("q")
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                own.append(left << 40 | right << 20 | rank)
    codes = np.sort(np.frombuffer(own, np.int64)) if own else np.empty(0, np.int64)
    slots = ((codes >> 40) * 40503 + (codes >> 20 & (1 << 20) - 1) * 10007) % (1 << SLOT_BITS)
    return np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << SLOT_BITS))]), codes[np.argsort(slots, kind="stable")]


@dataclass
class RankMap:
    """The pair ranks as columns: ``starts`` of each slot in ``codes``; a code is left, right and joined id in 20 bits each."""
    starts: Column
    codes: Column
    bytes_: Column

    @staticmethod
    def table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
        """(starts, codes, bytes): one row."""
        import pyarrow as pa
        starts, codes = slotted(ranks)
        row = {"starts": starts.astype(np.int32), "codes": codes, "bytes": np.array([ranks[bytes([i])] for i in range(256)], np.int64)}
        return spark.createDataFrame(pa.table({n: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for n, v in row.items()}))

    @staticmethod
    def of(table: DataFrame) -> RankMap:
        return RankMap(table["starts"], table["codes"], table["bytes"])

    def joined(self, a: Column, b: Column) -> Column:
        """Id of the pair's bytes, or null."""
        slot = F.pmod(a * 40503 + b * 10007, F.lit(1 << SLOT_BITS)).cast("int")
        key = F.shiftleft(a, 20).bitwiseOR(b)
        own = let(slot, lambda s: let(F.get(self.starts, s), lambda at: F.slice(self.codes, at + 1, F.get(self.starts, s + 1) - at)))
        return F.get(F.transform(F.filter(own, lambda c: F.shiftright(c, 20) == key), lambda c: c.bitwiseAND(F.lit((1 << 20) - 1))), F.lit(0))

    def ids(self, piece: Column) -> Column:
        """array<bigint>: the fold over the bytes of ``piece`` (binary, not empty)."""
        n = F.octet_length(piece)
        code = lambda i: F.conv(F.hex(F.substring(piece, i, F.lit(1))), 16, 10).cast("int")
        start = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(self.bytes_, code(i)))

        def step(state: Column, _: Column) -> Column:
            ranked = F.transform(state, lambda a, i: F.when(i + 1 < F.size(state), self.joined(a, F.get(state, i + 1))))
            return let(ranked, lambda r: let(F.array_min(r), lambda low: F.when(low.isNull(), state).otherwise(
                let(F.array_position(r, low).cast("int"), lambda p: F.concat(F.slice(state, F.lit(1), p - 1), F.array(low), F.slice(state, p + 2, F.size(state)))))))

        return F.when(n > 1, F.aggregate(F.sequence(F.lit(2), n), start, step)).otherwise(start)


def encode_pieces(pieces: DataFrame, ranks: dict[bytes, int], piece_col: str = "piece") -> DataFrame:
    """(piece, ids): the distinct pieces of a table encoded by the higher-order fold. Pieces that are tokens are not among them.

    Pieces meet the rank map in blocks of about ``BLOCK_PIECES``, so that the map is set beside a block and not beside every piece.
    """
    spark = pieces.sparkSession
    own = pieces.select(F.col(piece_col).alias("piece")).filter("piece <> ''")
    block = F.pmod(F.xxhash64("piece"), F.lit(own.count() // BLOCK_PIECES + 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))             # a number that is asked for is not lowered for small tables
    blocks = own.withColumn("block", block).repartition(parts, "block").groupBy("block").agg(F.collect_set("piece").alias("pieces"))
    table = RankMap.table(spark, ranks)
    ids = RankMap.of(table).ids
    coded = F.transform("pieces", lambda p: F.struct(p.alias("piece"), ids(F.encode(p, "UTF-8")).alias("ids")))
    return blocks.crossJoin(F.broadcast(table)).select(F.inline(coded))


# --- texts ------------------------------------------------------------------------------------------------
def _words(text: str) -> list[str] | None:
    """Parts of a text cut before each blank, or None where blanks touch other white space."""
    parts = text.split(" ")
    if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return None
    return parts


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = 100_000) -> DataFrame:
    """(word, n): the most frequent blank-separated words of all texts, at most ``limit``; counts are combined in each batch first.

    Words are taken by levels of their count (64 for each doubling), a level wholly or not at all, so only the sizes of the levels reach the driver.
    """
    def run(batches):
        import pyarrow as pa
        from collections import Counter
        for b in batches:
            seen = Counter()
            for t in b.column(0).to_pylist():
                seen.update((t or "").split(" "))
            seen.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    words = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    counted = stored(words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 64)), "word-counts")
    room, least = limit, None
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):          # at most 64 levels for each doubling
        if n > room:
            break
        room, least = room - n, level
    return counted.filter(F.col("level") >= least if least is not None else F.lit(False)).select("word", "n")


@dataclass
class Codec:
    """What a task needs: the vocabulary, the split pattern and the dictionary of encoded words (with their blank)."""
    ranks: dict[bytes, int]
    pattern: str
    words: dict[str, bytes]

    def __post_init__(self):
        self._cache, self._pieces, self._split = {}, {}, regex.compile(self.pattern)
        self._tokens = None

    def __getstate__(self):
        return self.ranks, self.pattern, self.words

    def __setstate__(self, state):
        self.ranks, self.pattern, self.words = state
        self.__post_init__()

    def cut(self, text: str) -> bytes:
        """Ids of a text, cut by the pattern."""
        out = []
        for p in self._split.findall(text):
            got = self._pieces.get(p)
            if got is None:
                if len(self._pieces) >= CACHE_WORDS:
                    self._pieces.clear()
                got = np.array(fold(p.encode(), self.ranks), "<u4").tobytes()
                if len(p) <= 64:
                    self._pieces[p] = got
            out.append(got)
        return b"".join(out)

    def word(self, word: str) -> bytes:
        got = self._cache.get(word)
        if got is None:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            got = self.cut(" " + word)
            if len(word) <= 64:
                self._cache[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = _words(text) if text else []
        if parts is None:
            return self.cut(text)
        if not parts:
            return b""
        known, word = self.words, self.word
        return self.cut(parts[0]) + b"".join([known.get(w) or word(w) for w in parts[1:]])

    def decode(self, ids: bytes) -> bytes:
        if self._tokens is None:
            self._tokens = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                self._tokens[rank] = token
        return b"".join(map(self._tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def build_codec(docs: DataFrame, path: str, pattern: str, text_col: str = "text", dictionary_words: int = 100_000) -> Codec:
    """A codec whose dictionary holds the most frequent words of ``docs``, encoded by the higher-order fold."""
    ranks = read_ranks(path)
    words = frequent_words(docs, text_col, dictionary_words).select("word").toArrow()["word"].to_pylist()
    spark, split = docs.sparkSession, regex.compile(pattern)
    words = [w for w in words if len(w) <= 64]
    distinct = sorted({p for w in words for p in split.findall(" " + w)})         # words are cut again below, cheaper than lists for each
    coded = {p: np.array([ranks[p.encode()]], "<u4").tobytes() for p in distinct if p.encode() in ranks}
    folded = [p for p in distinct if p not in coded]
    if folded:
        import pyarrow as pa
        table = spark.createDataFrame(pa.table({"piece": pa.array(folded, pa.string())}))
        coded |= {r["piece"]: np.array(r["ids"], "<u4").tobytes() for r in stored(encode_pieces(table, ranks), "pieces").toLocalIterator()}
    return Codec(ranks, pattern, {w: b"".join(coded[p] for p in split.findall(" " + w)) for w in words})


def encoded(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(ids, texts):
        own = [shared.value.encode((t or b"").decode()) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in own], "ids": own}

    return arrow_map(named, run, f"doc_id {dict(named.dtypes)['doc_id']}, n_tokens bigint, ids binary", "doc_id", "text")


def decoded(table: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the concatenated pieces of each ids value; null ids are none."""
    shared = table.sparkSession.sparkContext.broadcast(codec)
    kind = dict(table.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = [shared.value.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return table.select(F.col(id_col).alias("doc_id"), F.col(ids_col)).mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass that keeps neither."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(ids, texts):
        own = shared.value
        coded = [own.encode((t or b"").decode()) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": [sha(x) for x in coded],
                "decoded_sha256": [sha(own.decode(x)) for x in coded]}

    return arrow_map(named, run, f"doc_id {dict(named.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "doc_id", "text")
