"""Token ids as compressed shards with random access: Re-Pair grammars.

Texts are encoded in ascending doc_id order and cut into shards. Inside a shard frequent pairs of neighbouring ids are
replaced by new ids (nonterminals), again and again; no pair crosses the end of a document. A shard holds the rules
(left, right), the expansion length of each nonterminal, the replaced sequence and the number of symbols and ids of each
document, so any document can be found by adding up counts and expanded by itself.

A round counts pairs in a hash table of fixed size first; only pairs in slots that reach the threshold are counted exactly.
Rounds end when no pair is frequent. Shards are rows of a Parquet table in the folder that is passed: Spark's commit
protocol makes the write safe against lost executors, and every store that Spark reads will do.

Words repeat, so the tokenizer is asked once for each distinct chunk between white space of a worker's texts (the
vocabulary never joins text across white space, and its added tokens hold none); a text's ids are gathered by numpy.
An added token inside a text is its one id, as the tokenizers library has it by default.

Defined results: a null or empty text is its end id alone; rows with equal doc_id are ordered by text; null doc_ids come
first; an empty table gives an empty folder and an empty result; other columns are not read.
"""
from __future__ import annotations

import os
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

SLOT_BITS = 20
SLICE_BYTES = 8 << 20
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"          # ASCII marks; the apostrophe starts pieces of its own
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class ChunkEncoder:
    """Ids (little-endian unsigned 32-bit) of whole texts, through two generations of a bounded cache of chunks.

    A chunk of letters up to U+00FF, with or without a run of ASCII marks behind it, goes to the library's merge model
    directly: normalising changes nothing but its case, and the split pattern leaves the word and the run as they are. All other
    chunks are encoded as one text; offsets tell which ids belong to which chunk.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.new, self.old, self.words = {}, {}, {}
        # the short way is taken only if the vocabulary's own normaliser and pattern treat such words as described
        probe = ["Word", "word.", "ÉTÉ,", "straße", "Ñandú", "x", "ÀÿÖß.", "No!!", "été,###", f"a{MARKS}"]
        self.short = all(self.letter_chunk(c) == self.encode(c) for c in probe)
        self.words.clear()

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letter_chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk of letters, with or without marks behind it, or None if it is not one."""
        core = chunk if chunk.isalpha() else chunk.rstrip(MARKS)
        if not core.isalpha() or not core.isascii() and max(core) > "ÿ":
            return None
        low = core.lower()
        got = self.words.get(low)
        if got is None:
            got = self.word(low)
        return got if len(core) == len(chunk) else got + self.letter_mark(chunk[len(core):])

    def word(self, word: str) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        plain = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        got = self.words[word] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return got

    def letter_mark(self, mark: str) -> bytes:
        got = self.words.get(mark)
        if got is None:
            got = self.words[mark] = self.encode(mark)
        return got

    def chunks(self, chunks: list[str]) -> None:
        """Encode new chunks."""
        rest = []
        for c in chunks:
            own = self.letter_chunk(c) if self.short else None
            if own is None:
                rest.append(c)
            else:
                self.new[c] = own
        for at in range(0, len(rest), 20_000):
            own = rest[at:at + 20_000]
            e = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            starts = np.cumsum([0, *[len(c) + 1 for c in own]])
            cuts = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), starts).tolist()
            flat = array("I", e.ids).tobytes()
            self.new.update((c, flat[4 * a:4 * b]) for c, a, b in zip(own, cuts, cuts[1:]))

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        found = list(map(self.new.get, chunks))
        missing = [i for i, got in enumerate(found) if got is None]
        if self.old:
            for i in missing:
                got = self.old.get(chunks[i])
                if got is not None:
                    self.new[chunks[i]] = found[i] = got
            missing = [i for i in missing if found[i] is None]
        self.chunks([chunks[i] for i in missing])
        for i in missing:
            found[i] = self.new[chunks[i]]
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        return found

    def texts(self, column: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; number of ids of each text). Null is an empty text."""
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        coded, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        distinct = coded.dictionary.to_pylist()
        at = {c: i for i, c in enumerate(distinct) if not c}          # white space at the ends leaves empty chunks
        pieces = self.of([c for c in distinct if c])
        for i in at.values():
            pieces.insert(i, b"")
        pieces.append(np.array([end_id], "<u4").tobytes())
        # one entry for each chunk and one for the end of each text
        order = np.insert(coded.indices.to_numpy(), bounds[1:], len(distinct))
        flat, sizes = np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts, own = np.cumsum(sizes) - sizes, sizes[order]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        ids = flat[np.repeat((starts[order] - (ends - own)).astype(small), own) + np.arange(total, dtype=small)]
        last = ends[bounds[1:] + np.arange(len(column))] if len(column) else np.empty(0, np.int64)
        return ids, np.diff(np.concatenate([[0], last]))


_ENCODERS: dict[int, ChunkEncoder] = {}


def encoder(spec: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(spec)
    return _ENCODERS[key]


def numbers_of(code: np.ndarray, slot: np.ndarray, chosen: np.ndarray, chosen_slot: np.ndarray, slots: int) -> np.ndarray:
    """The place of each code in ``chosen`` (ascending), or -1, by hash slots; only codes in slots of several chosen ones are searched for."""
    table = np.full(slots, -1, np.int32)
    table[chosen_slot] = np.arange(len(chosen), dtype=np.int32)
    own = table[slot]
    own[chosen[own] != code] = -1                       # an empty slot meets the last one, which is not its code
    shared = chosen_slot[table[chosen_slot] != np.arange(len(chosen))]
    if len(shared):
        several = np.zeros(slots, bool)
        several[shared] = True
        again = np.flatnonzero(several[slot])
        found = np.minimum(np.searchsorted(chosen, code[again]), len(chosen) - 1)
        own[again] = np.where(chosen[found] == code[again], found, -1)
    return own


def replace_pairs(ids: np.ndarray, last: np.ndarray, first_new: int, least: int = 8):
    """(symbols, last flags, rules, rule lengths). ``last`` marks the last id of each document.

    Rounds go on until no pair of neighbours occurs ``least`` times. A round replaces every frequent pair wherever it stands, so
    the next one looks only at places beside the symbols it made.
    """
    seq, last = ids.astype(np.int64), last.copy()
    rules, lengths = [np.empty((0, 2), np.int64)], np.empty(0, np.int64)
    slots, made, since = 1 << SLOT_BITS, 0, 0
    spread = lambda code: (code ^ code >> 29) * 0x9E3779B97F4A7C1 >> 31 & (slots - 1)
    while len(seq) > 1:
        new = seq >= since
        at = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        code = seq[at] << 32 | seq[at + 1]
        slot = spread(code)
        full = (np.bincount(slot, minlength=slots) >= least)[slot]
        at, code = at[full], code[full]
        chosen, times = np.unique(code, return_counts=True)
        chosen = chosen[times >= least]
        if not len(chosen):
            break
        own = numbers_of(code, slot[full], chosen, spread(chosen), slots)
        fit = own >= 0
        at, own = at[fit], own[fit]
        # overlapping places: every other one of a run, from the left
        start = np.concatenate([[True], np.diff(at) > 1])
        run = at[start][np.cumsum(start) - 1]
        even = (at - run) % 2 == 0
        at, own = at[even], own[even]
        name = np.zeros(len(chosen), np.int64)
        name[own] = 1
        used = np.flatnonzero(name)
        name[used] = first_new + made + np.arange(len(used))
        pairs = np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1)
        known = np.concatenate([lengths, [0]])
        size = lambda s: np.where(s >= first_new, known[np.where(s >= first_new, s - first_new, len(lengths))], 1)
        lengths = np.concatenate([lengths, size(pairs[:, 0]) + size(pairs[:, 1])])
        rules.append(pairs)
        since = first_new + made
        made += len(used)
        seq[at] = name[own]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    return seq, last, np.concatenate(rules), lengths


def descend(symbols: np.ndarray, rules: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, place of the symbol that each id comes from), replacing symbols level by level."""
    seq, owner = symbols.astype(np.int64), np.arange(len(symbols))
    while True:
        rule = seq >= first_new
        if not rule.any():
            return seq, owner
        at = np.cumsum(np.concatenate([[0], 1 + rule[:-1]]))[rule]
        own = rules[seq[rule] - first_new]
        owner, seq = np.repeat(owner, 1 + rule), np.repeat(seq, 1 + rule)
        seq[at], seq[at + 1] = own[:, 0], own[:, 1]


def expand(symbols: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    """The ids of a sequence of symbols; works on any slice of a shard. In long ones rules are expanded once and looked up."""
    seq = symbols.astype(np.int64)
    if len(seq) < 4 * len(rules):
        return descend(seq, rules, first_new)[0]
    rule = seq >= first_new
    if not rule.any():
        return seq
    table, owner = descend(rules.ravel(), rules, first_new)
    sizes = np.bincount(owner // 2, minlength=len(rules))
    named = seq[rule] - first_new
    own, start = np.ones(len(seq), np.int64), np.arange(len(table), len(table) + len(seq))
    own[rule], start[rule] = sizes[named], (np.cumsum(sizes) - sizes)[named]
    flat = np.concatenate([table, np.where(rule, 0, seq)])
    ends = np.cumsum(own)
    return flat[np.repeat(start - (ends - own), own) + np.arange(ends[-1])]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 shard_ids: int = 2_000_000, first_new: int = 1 << 20, **grammar) -> None:
    """Encode all texts and write the shards to the folder ``path``. ``vocabulary`` is the path of a tokenizers file."""
    kind = dict(docs.dtypes)[id_col]
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def shard(part, block, before, ids, flat, counts):
        last = np.zeros(len(flat), bool)
        last[np.cumsum(counts) - 1] = True
        symbols, ends, rules, lengths = replace_pairs(flat, last, first_new, **grammar)
        own = np.diff(np.concatenate([[0], np.flatnonzero(ends) + 1]))
        cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.array([ids], pa.list_(id_type)), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([own.tolist()], pa.list_(pa.int32())),
                pa.array([rules.astype("<u4").tobytes()], pa.binary()), pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                pa.array([symbols.astype("<u4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["part", "block", "before", "n_ids", "docs", "counts", "symbol_counts", "rules", "rule_lengths", "symbols"])

    def run(batches):
        part, block, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, flat, counts = [], [], []
        enc = encoder(spec.value)
        for b in batches:
            done = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                # whole texts up to SLICE_BYTES, one at least
                end = max(at + 1, int(np.searchsorted(done, SLICE_BYTES + (done[at - 1] if at else 0), "right")))
                piece, at = b.slice(at, end - at), end
                own, n = enc.texts(piece.column(1), end_id)
                ids += piece.column(0).to_pylist()
                flat.append(own)
                counts.append(n)
                size += len(own)
                if size >= shard_ids:
                    yield shard(part, block, before, ids, np.concatenate(flat), np.concatenate(counts))
                    block, before, size, ids, flat, counts = block + 1, before + size, 0, [], [], []
        if ids:
            yield shard(part, block, before, ids, np.concatenate(flat), np.concatenate(counts))

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        run, f"part int, block int, before bigint, n_ids bigint, docs array<{kind}>, counts array<int>, symbol_counts array<int>, "
             "rules binary, rule_lengths binary, symbols binary").write.parquet(path)


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: ids of all shards before. One row per partition of the write goes through the driver."""
    shards = spark.read.parquet(path)
    parts = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = [0, *accumulate(n for _, n in parts)]
    table = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, bases)], "part int, base bigint")
    return shards.join(F.broadcast(table), "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_documents(spark: SparkSession, path: str, first_new: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) of all documents, from the files alone."""
    shards = with_starts(spark, path)
    id_type = shards.schema["docs"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(id_type)
    cols = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for b in batches:
            for docs, counts, start, rules, symbols in zip(*(b.column(k).to_pylist() for k in range(5))):
                flat = expand(np.frombuffer(symbols, "<u4"), np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64), first_new).astype("<u4").tobytes()
                ends = list(accumulate(counts))
                parts = [flat[4 * (e - n):4 * e] for e, n in zip(ends, counts)]
                data = [pa.array(docs, arrow_id), pa.array([start + e - n for e, n in zip(ends, counts)], pa.int64()), pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(data[:len(cols)], names=cols)

    schema = f"doc_id {id_type.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return shards.select("docs", "counts", "start", "rules", "symbols").mapInArrow(run, schema)


def document_ids(shard: dict, k: int, first_new: int = 1 << 20) -> np.ndarray:
    """Random access: ids of the k-th document of one shard row, expanding its own symbols only."""
    at = sum(shard["symbol_counts"][:k])
    own = np.frombuffer(shard["symbols"], "<u4")[at:at + shard["symbol_counts"][k]]
    return expand(own, np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64), first_new)
