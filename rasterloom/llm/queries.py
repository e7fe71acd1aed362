"""The registered queries of the text operators and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import align, bytebpe, decontaminate, licences, linededup, lloyd, pii, ppm, quality, repair, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(k: int):
    """crc32(doc_id as text) mod k."""
    return F.crc32(F.col("doc_id").cast("string")) % k


def held_out(k: int):
    """A null id is not held out (nor used for training)."""
    return F.coalesce(remainder(k) == 1, F.lit(False)).alias("held_out")


# --- 7: toxicity ----------------------------------------------------------------------------------
@query("op7_toxicity")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels"), remainder(3) != 1)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(3), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                         F.size("spans").alias("n_offending"))


# --- 9: SimHash -----------------------------------------------------------------------------------
@query("op9_simhash")
def op9(spark, sf):
    found = simhash.simhash_components(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- 10: decontamination ---------------------------------------------------------------------------
OP10_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
place AS (SELECT r, doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) AS ms WHERE len(w) >= m),
hit AS (SELECT r, i, win.m, item_id FROM place JOIN win ON win.m = place.m AND win.x = list_slice(w, i, i + place.m - 1)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op10_decontamination", OP10_SQL)
def op10(spark, sf):
    found = decontaminate.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = decontaminate.covered(F.col("hits"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# --- 1: quality rules --------------------------------------------------------------------------------
OP1_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
place AS (SELECT r, i, list_slice(w, i, i + 4) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM place) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
line AS (SELECT r, length(x) AS c, length(x) - length(replace(x, ' ', '')) + 1 AS blanks, x FROM (SELECT r, unnest(lines) AS x FROM doc)),
judged AS (SELECT r, c, NOT regexp_matches(x, '{quality.END.replace("'", "''")}') OR (length(x) - length(replace(x, '|', ''))) * 4 > blanks
    OR (length(x) - length(replace(x, '!!', ''))) * 2 > blanks OR (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 2 > blanks
    OR regexp_matches(x, '{quality.BOILERPLATE}') AS bad FROM line),
loss AS (SELECT r, sum(c) AS c, coalesce(sum(c) FILTER (NOT bad), 0) AS ok, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad FROM judged GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_failed_lines,
    CASE WHEN c > 0 THEN 1 - CAST(ok AS DOUBLE) / c ELSE 0 END AS loss
    FROM doc LEFT JOIN rep USING (r) LEFT JOIN loss USING (r)),
judge AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, NOT base_failed AND loss <= 0.4 AS kept FROM judge
"""


@query("op1_quality", OP1_SQL)
def op1(spark, sf):
    return quality.quality(table(spark, sf, "documents")).drop("loss", "cleaned")


# --- 6: licences --------------------------------------------------------------------------------------
def _op6_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.SENTENCES.items())
    rules = ", ".join(f"({k}, '{name}', ',{','.join(seq)},')" for k, (name, seq) in enumerate(licences.RULES, 1))
    return rf"""
WITH known(s, id) AS (VALUES {known}), rules(rank, licence, seq) AS (VALUES {rules}),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?][\x20\x09-\x0D]+|\n') AS parts FROM documents),
part AS (SELECT r, k, trim(regexp_replace(lower(parts[k]), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS k FROM doc)),
ids AS (SELECT r, string_agg(id, ',' ORDER BY k) AS ids, count(*) AS n FROM part JOIN known USING (s) GROUP BY r),
hits AS (SELECT r, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks, arg_min(licence, rank) AS licence FROM ids, rules
    WHERE contains(',' || ids || ',', seq) GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentences, coalesce(ranks, '') AS rule_ranks, licence
FROM doc LEFT JOIN ids USING (r) LEFT JOIN hits USING (r)
"""


@query("op6_licences", _op6_sql())
def op6(spark, sf):
    found = licences.licences(table(spark, sf, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("sentence_ids").cast("bigint").alias("n_sentences"),
                        F.array_join(F.col("rule_ranks").cast("array<string>"), ",").alias("rule_ranks"), "licence")


# --- 2: personal data -----------------------------------------------------------------------------------
@query("op2_personal_data")
def op2(spark, sf):
    return pii.personal_data(table(spark, sf, "documents")).drop("base")


# --- 8: line dedup -----------------------------------------------------------------------------------------
@query("op8_line_dedup")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = linededup.drop_repeated_lines(docs)
    return cut.select("doc_id", F.length("text").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# --- 5: token files -------------------------------------------------------------------------------------------
@query("op5_token_files")
def op5(spark, sf):
    path = scratch_path(spark, "token-shards")
    repair.write_shards(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return repair.read_documents(spark, path)


# --- 3: byte-level BPE ------------------------------------------------------------------------------------------
@query("op3_byte_bpe")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    codec = bytebpe.build_codec(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.round_trip(docs, codec)


# --- 4: language-model scores --------------------------------------------------------------------------------------
@query("op4_ppm")
def op4(spark, sf):
    found = ppm.ppm_scores(table(spark, sf, "documents"), remainder(5) != 1)
    return found.select("doc_id", held_out(5), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 11: alignment of two tokenizers --------------------------------------------------------------------------------
@query("op11_alignment")
def op11(spark, sf):
    pair = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = align.aligned(table(spark, sf, "documents"), pair)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- 12: web archives -----------------------------------------------------------------------------------------------
OP12_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
kept AS (SELECT t, max(page_id) AS kept FROM page WHERE n >= 1000 GROUP BY t),
marked AS (SELECT page_id, n, page.t, kept, kept IS NOT NULL AND kept IS DISTINCT FROM page_id AS again FROM page LEFT JOIN kept ON page.t = kept.t AND n >= 1000)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN kept END AS refers_to FROM marked
"""


@query("op12_warc", OP12_SQL)
def op12(spark, sf):
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.with_revisits(table(spark, sf, "pages")), path)
    return warc.page_records(spark, path)


# --- 13: centroid clustering ----------------------------------------------------------------------------------------
def _op13_sql(rounds: int = 10) -> str:
    nearest = """a{i} AS MATERIALIZED (SELECT r, v, c, d FROM (SELECT kept.r, kept.v, c{i}.c,
    CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i})
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    update = """c{j} AS MATERIALIZED (SELECT c, list(f ORDER BY j) AS v FROM (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
    SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j)) GROUP BY c
    UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))"""
    steps = [x.format(i=i, j=i + 1) for i in range(rounds) for x in (nearest, update)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 8),
{", ".join([*steps, nearest.format(i=rounds)])},
each AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN each USING (c) JOIN c{rounds} USING (c)
"""


@query("op13_clusters", _op13_sql())
def op13(spark, sf):
    return lloyd.clusters(table(spark, sf, "embeddings"))[0]
