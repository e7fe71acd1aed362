"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window is a run of ``window`` words of a benchmark item (a shorter item is one window). A window lies in a document
only if all its word shingles do, so one shingle decides whether a pair needs a look: the rarest one over all documents.
Its shingles are ordered by that count, the first is joined (the prefix a containment of 1 needs), the place of the
shingle in the window fixes where the window would have to begin (positional bound) and end (length bound), and the
words there are compared with the window's.

The benchmark side is broadcast in slices of at most ``slice_rows`` windows, counted beforehand; documents are never
shuffled: only the words' hits of a document and its number of words are.

Defined results: a null or empty text has no words and no hits; an item without words matches nothing; repeated items
count as one item_id, items with null id are left out of the id list and its count but hit words; repeated document rows
give a row each; empty tables give no rows or no hits; other columns are not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, stored

LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}
#: ASCII characters that are neither digits nor letters separate words.
SEPARATORS = [chr(c) for c in range(128) if not chr(c).isalnum()]


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and non-ASCII characters."""
    source = "".join([*LOWER, *SEPARATORS])
    target = "".join([*LOWER.values(), *[" "] * len(SEPARATORS)])
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), source, target), " "), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size),
                  lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows: w (words), size (of its shingles), item_ids."""
    words = items.select(F.col(item_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words")).filter("size(words) > 0")
    cut = words.select("item", "words", F.least(F.lit(window), F.size("words")).alias("m"))
    starts = cut.select("item", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    return (starts.groupBy(F.expr("slice(words, at, m)").alias("w")).agg(F.collect_set("item").alias("item_ids"))
                  .withColumn("size", F.least(F.lit(shingle), F.size("w"))))


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", window: int = 10, shingle: int = 3, slice_rows: int = 500_000, with_key: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, hits (array of distinct (start, m), words counted from 0), item_ids (sorted strings) and,
    if asked for, text_key (SHA-256 of the text)."""
    spark = docs.sparkSession
    windows = stored(_windows(items, item_col, item_text, window, shingle), "windows")
    sizes = [r[0] for r in windows.groupBy("size").count().orderBy("size").select("size").collect()]   # 1 to ``shingle``
    size_of = reduce(lambda rest, s: F.when(F.col("size") == s, shingles(F.col("w"), s)).otherwise(rest), sizes, F.array().cast("array<bigint>"))
    tokens = windows.select("*", F.posexplode(size_of).alias("off", "token"))
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) if with_key else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), item_words(F.col(text_col)).alias("words"))
    own = ["doc_id", *["text_key"] * with_key]
    # a sentinel at place 0 keeps documents without a hit
    all_shingles = lambda w: F.concat(F.array(F.lit(None).cast("bigint")), *[shingles(w, s) for s in sizes])
    n_slices = -(-windows.count() // slice_rows) or 1
    wanted = stored(tokens.select("token", F.pmod("token", F.lit(n_slices)).alias("slice")).distinct(), "tokens")

    def counts(k: int) -> DataFrame:
        """Occurrences in all documents of the tokens of one slice."""
        part = wanted.filter(F.col("slice") == k).select("token")
        seen = texts.select(F.explode(F.concat(*[shingles(F.col("words"), s) for s in sizes])).alias("token"))
        return seen.join(F.broadcast(part), "token").groupBy("token").agg(F.count("*").alias("n"))

    if not sizes:
        return texts.select(*own, F.size("words").cast("bigint").alias("n_words"),
                            F.array().cast("array<struct<start:int,m:int>>").alias("hits"), F.array().cast("array<string>").alias("item_ids"))
    seen = stored(reduce(DataFrame.union, [counts(k) for k in range(n_slices)]), "token-counts")
    # a window with a token that no document has cannot occur
    ranked = (tokens.join(seen, "token", "left").groupBy("w", "item_ids", "size")
                    .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "token")).alias("rarest")).filter("rarest.n > 0"))
    prefix = stored(ranked.select("rarest.token", "rarest.off", "w", "item_ids", F.col("size"),
                                  F.pmod(F.xxhash64("w"), F.lit(n_slices)).alias("slice")), "prefixes")
    keyed = texts.select(F.monotonically_increasing_id().alias("row"), *own, "words", F.size("words").alias("n"))
    base = sizes and {s: i for i, s in enumerate(sizes)}

    def hits(k: int) -> DataFrame:
        part = prefix.filter(F.col("slice") == k).drop("slice")
        flat = keyed.select("row", *own, "n", "words", F.posexplode(all_shingles(F.col("words"))).alias("place", "token"))
        # places of size s follow those of the smaller sizes
        before = {s: sum(([F.greatest(F.col("n") - t + 1, F.lit(0)) for t in sizes[:base[s]]]), F.lit(1)) for s in sizes}
        offset = reduce(lambda rest, s: F.when(F.col("size") == s, before[s]).otherwise(rest), sizes, F.lit(None).cast("int"))
        start = F.col("place") - offset - F.col("off")
        joined = flat.join(F.broadcast(part), "token", "left")
        hit = F.when((start >= 0) & (start + F.size("w") <= F.col("n")), F.expr("w") == F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("w")))
        return (joined.filter((F.col("place") == 0) | hit)
                      .select("row", *own, "n", F.when(F.col("place") > 0, F.struct(start.alias("start"), F.size("w").alias("m"))).alias("hit"), "item_ids"))

    found = reduce(DataFrame.union, [hits(k) for k in range(n_slices)])
    return (found.groupBy("row").agg(*[F.first(c).alias(c) for c in own], F.first("n").cast("bigint").alias("n_words"), F.collect_set("hit").alias("hits"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")).drop("row"))


def covered(hits: Column) -> Column:
    """Number of places in the union of (start, m) intervals."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["m"] - 1))))).cast("bigint")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without a benchmark window. Each text is judged by itself, also where ids are null or used twice."""
    found = benchmark_hits(docs, items, id_col, text_col, with_key=True, **options).filter("size(hits) > 0")
    bad = stored(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "hit-documents")
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.withColumn("__text", key).join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti").drop("__text")
