"""Removal of line passages that occur elsewhere in the corpus, by content-defined chunks of lines.

Lines get 64-bit hashes. A rolling hash over the last ``roll`` line hashes ends a chunk where it is 0 modulo ``divisor``;
a line of ``long_words`` words or more always stands alone. Boundaries depend on the lines around them only, so they move
with inserted or deleted text (shift-resistant). A chunk may be removed if it has two lines or more, or is such a long line.

A shared passage that is shorter than a chunk, and its ends, lie in chunks that differ between documents. So every
position of the rolling hash is looked at as well: each run of ``roll`` lines is a small chunk of its own. Together
they cover every repeated passage of two lines and more, and every repeated long line, wherever it stands.

Chunks whose hash occurs more than once are compared as bytes (grouped by their text); the first occurrence, by doc_id
and place, stays, lines of all others are removed. Hashes are counted before any text moves: only chunks that occur again
are compared, and the counts are combined before the shuffle, so a passage that a third of all documents hold is no hot
group. Documents are joined back by doc_id and text hash.

A run of repeated lines is cut only if it is a passage: two lines or more with a letter or digit, or a line of ``long_words``. A
repeated heading with its blank line, or a short line between brackets, stays.

Defined results: lines without a word are never removed by themselves; a null text stays null and an empty one empty;
rows with equal doc_id and text are one document (all keep or lose the same lines; between equal rows nothing is removed);
a null doc_id sorts first; a document that loses all its lines stays with an empty text; an empty table gives an empty
result; other columns pass through, whatever their names.
"""
from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chunks(text: str | None, roll: int = 2, divisor: int = 4, long_words: int = 50) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of a text that may be removed: content-defined, then rolling ones."""
    lines = (text or "").split("\n")
    if not text:
        return []
    n_words = [len(WORD.findall(x)) for x in lines]
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    ends = []
    for i, n in enumerate(n_words):
        long_here = n >= long_words
        long_next = i + 1 < len(lines) and n_words[i + 1] >= long_words
        rolled = xxhash.xxh64_intdigest(repr(hashes[max(0, i - roll + 1):i + 1]))
        if long_here or long_next or rolled % divisor == 0 or i + 1 == len(lines):
            ends.append(i + 1)
    out, start = [], 0
    for end in ends:
        if end - start > 1 or n_words[start] >= long_words:
            out.append((start, end - start))
        start = end
    seen = set(out)
    out += [(i, roll) for i in range(len(lines) - roll + 1) if (i, roll) not in seen]
    return [(s, k) for s, k in out if any(n_words[s:s + k])]


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _spots(roll: int, divisor: int, long_words: int):
    """(doc, text hash, start, lines, code) of all chunks."""
    def run(batches):
        for b in batches:
            ids, hashes, texts = (b.column(k).to_pylist() for k in range(3))
            out = [[] for _ in range(5)]
            for doc, h, text in zip(ids, hashes, texts):
                lines = (text or "").split("\n")
                for s, k in chunks(text, roll, divisor, long_words):
                    for column, v in zip(out, (doc, h, s, k, _signed(xxhash.xxh64_intdigest("\n".join(lines[s:s + k]))))):
                        column.append(v)
            kinds = [b.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc", "text_hash", "start", "lines", "code"])
    return run


def _chunk_texts(batches):
    """The text of each listed spot of a document."""
    for b in batches:
        names = ["doc", "text_hash", "start", "lines", "code", "chunk"]
        out = [[] for _ in names]
        for doc, h, text, spots in zip(*(b.column(k).to_pylist() for k in range(4))):
            lines = text.split("\n")
            for x in spots:
                for column, v in zip(out, (doc, h, x["start"], x["lines"], x["code"], "\n".join(lines[x["start"]:x["start"] + x["lines"]]))):
                    column.append(v)
        kinds = [b.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)


def passages(lines: list[str], drop: set[int], long_words: int = 50) -> set[int]:
    """The listed lines whose unbroken run has two lines with a letter or digit, or a line of ``long_words`` words."""
    out, run = set(), []
    for i in sorted(drop):
        run = run + [i] if run and run[-1] == i - 1 else [i]
        if i + 1 not in drop:
            spoken = sum(any(map(str.isalnum, lines[k])) for k in run)
            if spoken > 1 or any(len(WORD.findall(lines[k])) >= long_words for k in run):
                out.update(run)
    return out


def _cut(long_words: int):
    def run(batches):
        for b in batches:
            row, texts, gone = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for text, spans in zip(texts, gone):
                if spans:
                    lines = text.split("\n")
                    drop = passages(lines, {i for s in spans for i in range(s["start"], s["start"] + s["lines"])}, long_words)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                out.append(text)
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.string())], names=["row", "text"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roll: int = 2, divisor: int = 4, long_words: int = 50) -> DataFrame:
    """(doc, text_hash, start, lines): occurrences of repeated chunks other than the first one."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    columns = f"doc {kind}, text_hash bigint, start int, lines int, code bigint"
    spots = stored(base.mapInArrow(_spots(roll, divisor, long_words), columns), "chunk-codes")
    codes = spots.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code")
    listed = (spots.join(codes, "code", "left_semi").groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "lines", "code")).alias("spots"))
                   .withColumnsRenamed({"doc": "doc1", "text_hash": "hash1"}))
    # equal rows are one document
    texts = base.join(listed, F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("text_hash") == F.col("hash1"))).select("doc", "text_hash", "text", "spots")
    again = stored(texts.mapInArrow(_chunk_texts, columns + ", chunk string"), "repeated-chunks")
    # the byte comparison: equal text, not only equal hash
    first = (again.groupBy("code", "chunk").agg(F.min(F.struct("doc", "text_hash", "start")).alias("first"), F.count("*").alias("n"))
                  .filter("n > 1").withColumn("same", F.sha2("chunk", 256)).select("code", "same", "first"))
    spots = again.select("doc", "text_hash", "start", "lines", "code", F.sha2("chunk", 256).alias("same"))
    here = F.struct("doc", "text_hash", "start")
    # overlapping runs of equal lines inside one document: the first occurrence is left alone, later ones go
    return spots.join(first, ["code", "same"]).filter(~here.eqNullSafe(F.col("first"))).select("doc", "text_hash", "start", "lines")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roll: int = 2, divisor: int = 4, long_words: int = 50) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text_col``; all rows and columns stay."""
    gone = repeated_spans(docs, id_col, text_col, roll, divisor, long_words)
    per_doc = gone.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "lines")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    other = [c for c in docs.columns if c != text_col]
    cut = joined.select(F.struct(*[F.col("row")[c].alias(c) for c in other]).alias("row"), "text", "gone").mapInArrow(
        _cut(long_words), T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in other])), T.StructField("text", T.StringType())]))
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
