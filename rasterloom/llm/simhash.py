"""SimHash near-duplicates with a covering locality-sensitive hash.

Each document has a 64-bit fingerprint: the bitwise majority of the XXH64 values of its word shingles.
Two fingerprints link when at most ``radius`` bits differ.

Candidates come from structured bit masks (covering LSH): every bit position i gets a non-zero vector m(i) of
radius + 1 bits, and for each non-zero v one table keeps the bits with an odd <m(i), v>. The vectors of at most
``radius`` differing positions do not span the space, so some v is orthogonal to all of them: in that table the pair
has equal keys. No pair within the radius can be missed, and 2^(radius+1) - 1 tables are enough.

A bucket is never expanded into pairs: one task compares its members block by block and returns a link from each
member to the smallest member it is connected with. A bucket above ``bucket_rows`` goes through a further covering
family, which keeps the guarantee and adds about half of the free bits to the key, until it is small or so few bits
are free that the number of distinct fingerprints is bounded anyway. Exact copies share one fingerprint and count once.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows are rows of their
own in one component; a null doc_id stays in the result but names no component unless it stands alone (then null);
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..operators.joins import lookup_join
from ..operators.ordering import agg_join
from .common import arrow_map, stored

BITS = 64
FREE_BITS = 10
BLOCK = 65536


def simhash(text: bytes | None, shingle: int = 3, distinct: bool = False) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer. ``distinct``: the votes of the set of single words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if distinct:
        hashes = [digest(w, 42) for w in set(words)]
    elif len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    h, votes = np.array(hashes, np.uint64), np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        votes += np.unpackbits(h[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row."""
    kind = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(named, lambda ids, texts: {"doc_id": ids, "fp": [simhash(t, shingle) for t in texts]},
                     f"doc_id {kind}, fp bigint", "doc_id", "text")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """The bit masks of one family; each level deals the vectors to the positions anew."""
    vectors = (1 << (radius + 1)) - 1
    if level == 0:
        own = [1 + i % vectors for i in range(BITS)]
    else:
        own = [1 + xxhash.xxh64_intdigest(f"{level}:{i}") % vectors for i in range(BITS)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(1 << i for i in range(BITS) if bin(own[i] & v).count("1") % 2)) for v in range(1, vectors + 1)]


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the links (a, b)."""
    root = np.arange(n)
    while True:                                        # smallest label of both ends, then jump to the label's label
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values the smallest value it is connected with by links inside this bucket."""
    fps = np.sort(fps)
    u = fps.view(np.uint64)
    step = max(1, 4_000_000 // max(1, len(fps)))
    links = []
    for at in range(0, len(u), step):
        a, b = np.nonzero(np.bitwise_count(u[at:at + step, None] ^ u[None, :]) <= radius)
        links.append((a[b > a + at] + at, b[b > a + at]))
    a, b = (np.concatenate(x) for x in zip(*links))
    return fps[smallest_labels(len(fps), a, b)]


def _bucket_links(radius: int):
    def run(batches):
        """Rows come sorted by bucket; a bucket may cross batches."""
        rest_b, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(bucket, fp):
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
            out_a, out_b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                own = np.unique(fp[s:e])
                root = linked_roots(own, radius)
                out_a.append(own[root != own])
                out_b.append(root[root != own])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["src", "dst"])

        for batch in batches:
            bucket = np.concatenate([rest_b, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))
            rest_b, rest_f = bucket[last:], fp[last:]
            if last:
                yield from links(bucket[:last], fp[:last])
        if len(rest_b):
            yield from links(rest_b, rest_f)
    return run


def covering_links(fps: DataFrame, radius: int = 3, bucket_rows: int = 2000) -> DataFrame:
    """(src, dst): links that connect all distinct values of ``fp`` within ``radius`` bits; at most one per value and bucket."""
    # narrow rows are spread before the masks multiply them, or few tasks would hold all buckets
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("used")).repartition(parts, "fp")
    links, level = None, 0
    while True:
        masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(radius, level)])
        rows = (rows.select("fp", "bucket", "used", F.posexplode(masks).alias("table", "mask"))
                    .select("fp", F.xxhash64("bucket", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"),
                            F.col("used").bitwiseOR(F.col("mask")).alias("used")))
        counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.bit_count("used")).alias("bits"))
        hot = stored(counts.filter((F.col("n") > bucket_rows) & (F.col("bits") < BITS - FREE_BITS)).select("bucket"), "hot-buckets")
        any_hot = bool(hot.take(1))
        small = rows.join(hot, "bucket", "left_anti") if any_hot else rows
        sorted_rows = small.select("bucket", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket")
        found = sorted_rows.mapInArrow(_bucket_links(radius), "src bigint, dst bigint")
        links = found if links is None else links.union(found)
        if not any_hot:
            return links.distinct()
        rows, level = stored(rows.join(hot, "bucket", "left_semi"), "hot-rows"), level + 1


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 3, bucket_rows: int = 2000) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = stored(covering_links(classes, radius, bucket_rows), "links")
    roots = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.filter("root <> fp OR first IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root", "left").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_codes(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit codes of the word shingles of a text (a shorter text is one shingle), ascending."""
    words = text.lower().split()
    h, n = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), max(1, len(words) - shingle + 1)
    code = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(code ^ code >> np.uint64(29))


def shared_counts(sets: list[np.ndarray], dense: int = 32, columns: int = 4096) -> np.ndarray:
    """Numbers of common codes of all pairs of sets. Codes of many sets are multiplied as a matrix, the others listed by pairs."""
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    code, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times >= dense
    column = np.cumsum(often) - 1
    for at in range(0, int(often.sum()), columns):
        hit = often[place] & (column[place] >= at) & (column[place] < at + columns)
        m = np.zeros((n, min(columns, int(often.sum()) - at)), np.float32)
        m[owner[hit], column[place[hit]] - at] = 1
        both += m @ m.T
    few = np.flatnonzero(~often[place] & (times[place] > 1))
    few = few[np.argsort(place[few], kind="stable")]
    own, key = owner[few], place[few]
    for step in range(1, dense):
        a = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else np.empty(0, np.int64)
        if not len(a):
            break
        np.add.at(both, (own[a], own[a + step]), 1)
        np.add.at(both, (own[a + step], own[a]), 1)
    return both


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a < b) of sets with at least this Jaccard similarity."""
    both, size = shared_counts(sets), np.array([len(s) for s in sets], float)
    a, b = np.nonzero(np.triu(both >= similarity * (size[:, None] + size[None, :] - both), 1))
    return a, b


def prefix_codes(codes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The codes of which a set with at least ``similarity`` holds one: all but ceil(similarity x size) - 1, rare ones first.
    ``counts`` belong to the sorted ``common`` codes, others count as none; ties are ascending."""
    if len(common):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        codes = codes[np.argsort(np.where(common[at] == codes, counts[at], 0), kind="stable")]
    return codes[:len(codes) - int(np.ceil(similarity * len(codes) - 1e-9)) + 1]


def _candidate_links(similarity: float, bucket_rows: int):
    """Rows (key, code, node, size) come sorted by key; a key may cross batches. A key of up to ``bucket_rows`` nodes lists the
    pairs whose sizes allow the similarity, with both sizes and the number of such keys. A larger one, and each slice of a code
    dealt to several keys, links the nodes of neighbouring size classes with the smallest of them; for a dealt code these are rows (code, size
    class, node) of their own, to be linked across its slices."""
    widest = -1.001 * float(np.log(similarity))

    def unpaired(node, size):
        """(node, smallest node of a size class): sizes of similar sets lie in one class or in neighbouring ones."""
        level = np.floor(np.log(size) / widest).astype(np.int64)
        node, level = np.concatenate([node, node]), np.concatenate([level, level + 1])
        order = np.lexsort((node, level))
        node, level = node[order], level[order]
        first = np.flatnonzero(np.diff(level, prepend=-1))
        low = np.repeat(node[first], np.diff(first, append=len(level)))
        return node, low, node[first], level[first]

    def links(key, code, node, size, dealt):
        first = np.ones(len(key), bool)                              # a text comes from each task that has a copy
        first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, code, node, size, dealt = (x[first] for x in (key, code, node, size, dealt))
        cuts = np.flatnonzero(np.diff(key)) + 1
        bounds = np.concatenate([[0], cuts, [len(key)]])
        length = np.diff(bounds)
        each = np.repeat(length, length)
        star = (each > bucket_rows) | dealt
        pairs, stars, levels = [np.empty((0, 4), np.int64)], [np.empty((0, 2), np.int64)], [np.empty((0, 3), np.int64)]
        left = np.flatnonzero(~star & (each > 1))
        for step in range(1, bucket_rows):
            left = left[left + step < len(key)]
            left = left[key[left] == key[left + step]]
            if not len(left):
                break
            a, b = left, left + step
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            ok = small >= similarity * large - 1e-6
            pairs.append(np.stack([node[a[ok]], node[b[ok]], size[a[ok]], size[b[ok]]], 1))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if star.any() else ():
            if star[s]:
                a, b, low, level = unpaired(node[s:e], size[s:e])
                stars.append(np.stack([a[a != b], b[a != b]], 1))
                if dealt[s]:
                    levels.append(np.stack([np.full(len(low), code[s]), level, low], 1))
        pairs, stars, levels = (np.concatenate(x) for x in (pairs, stars, levels))
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[:, :2], axis=0) != 0).any(1)]) if len(pairs) else np.empty(0, bool))
        times = np.diff(new, append=len(pairs))
        pairs, stars = pairs[new], np.unique(stars, axis=0)
        n, m, k = len(pairs), len(stars), len(levels)
        none = lambda *sizes: pa.nulls(sum(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([pairs[:, 0], stars[:, 0], levels[:, 2]])), pa.concat_arrays([pa.array(np.concatenate([pairs[:, 1], stars[:, 1]])), none(k)]),
            pa.concat_arrays([pa.array(pairs[:, 2].copy()), none(m, k)]), pa.concat_arrays([pa.array(pairs[:, 3].copy()), none(m, k)]),
            pa.concat_arrays([pa.array(times.astype(np.int64)), none(m, k)]),
            pa.concat_arrays([none(n, m), pa.array(levels[:, 0].copy())]), pa.concat_arrays([none(n, m), pa.array(levels[:, 1].copy())])],
            names=["src", "dst", "src_size", "dst_size", "times", "code", "level"])

    def run(batches):
        rest = None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            rows = [np.concatenate([r, x]) for r, x in zip(rest, rows)] if rest else rows
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [r[last:] for r in rows]
            if len(rest[0]) > 8 * bucket_rows + 100_000:        # a very frequent code need not be held: the same node comes from each task once
                keep = np.unique(rest[2], return_index=True)[1]
                rest = [r[keep] for r in rest]
            if last:
                yield from links(*(r[:last] for r in rows))
        if rest and len(rest[0]):
            yield from links(*rest)
    return run


def prefix_links(named: DataFrame, similarity: float = 0.8, shingle: int = 5, bucket_rows: int = 32, sample: int = 8,
                 common_rows: int = 10, most_common: int = 1_000_000, deal_rows: int = 20_000) -> DataFrame:
    """(src, dst): links between nodes (``text_node``) that connect those of all pairs of texts whose sets of word shingles have a Jaccard
    similarity of at least ``similarity``. ``named`` has doc_id and text, which is not null.

    Two such sets have one of the first size - ceil(similarity x size) + 1 shingles in common, in any order all texts share. What
    they have in common lies in both prefixes or behind the one that ends first, so the common prefix shingles of a pair are
    counted, and a pair is dropped if even all that lies behind would be too little.
    Shingles of more than about ``common_rows`` texts (the ``most_common`` of them) come last, by their count on one text of
    ``sample``; those of more than about ``deal_rows`` texts are dealt to several keys. Order and dealing are matters of cost, not of the
    result. Rows are shuffled once, 24 bytes each, and a text's copies inside one task once.
    """
    spark = named.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def codes_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                texts = b.column(0).slice(at, 500).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_codes(t, shingle) for t in texts]).view(np.int64))], names=["code"])

    drawn = named.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counts = drawn.mapInArrow(codes_of, "code bigint").groupBy("code").count().filter(F.col("count") * sample > common_rows)
    found = counts.orderBy(F.desc("count"), "code").limit(most_common).toArrow()
    codes, rows = found["code"].to_numpy().astype(np.int64).view(np.uint64), found["count"].to_numpy()
    common = spark.sparkContext.broadcast((np.sort(codes), rows[np.argsort(codes)]))

    def prefixes(batches):
        seen = set()
        known, counts = common.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                texts = {text_node(t): t for t in b.column(0).slice(at, 500).cast(pa.binary()).to_pylist()}
                texts = {k: t for k, t in texts.items() if k not in seen}
                if not texts:
                    continue
                seen.update(texts)
                codes = [shingle_codes(t, shingle) for t in texts.values()]
                own = [prefix_codes(c, known, counts, similarity) for c in codes]
                each = np.array([len(c) for c in own])
                code, node = np.concatenate(own), np.repeat(np.array(list(texts), np.int64), each)
                size = np.repeat(np.array([len(c) for c in codes], np.int32), each)
                # slices of very frequent codes, by node
                deal = np.ones(len(code), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    deal = np.where(known[place] == code, 1 + counts[place] * sample // deal_rows, 1)
                slice_ = (node.view(np.uint64) % deal.astype(np.uint64)).astype(np.int64)
                key = code.view(np.int64) ^ (slice_ * 0x61C8864680B583EB & 0x7FFFFFFFFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(code.view(np.int64)), pa.array(node), pa.array(size), pa.array(deal > 1)],
                                                 names=["key", "code", "node", "size", "dealt"])

    rows = named.select("text").mapInArrow(prefixes, "key bigint, code bigint, node bigint, size int, dealt boolean")
    found = stored(rows.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(
        _candidate_links(similarity, bucket_rows), "src bigint, dst bigint, src_size bigint, dst_size bigint, times bigint, code bigint, level bigint"), "candidates")
    slices = found.filter("code IS NOT NULL")
    across = agg_join(slices, ["code", "level"], F.min("src").alias("low")).filter("src <> low").select("src", F.col("low").alias("dst"))
    stars = found.filter("code IS NULL AND times IS NULL").select("src", "dst")
    # a pair without a frequent code in common has ``times`` of its common codes in both prefixes, and no more than what lies behind the larger prefix outside
    pairs = found.filter("times IS NOT NULL").groupBy("src", "dst", "src_size", "dst_size").agg(F.sum("times").alias("times"))
    behind = F.ceil(F.lit(similarity) * F.greatest("src_size", "dst_size") - 1e-9) - 1
    needed = F.lit(similarity / (1 + similarity)) * (F.col("src_size") + F.col("dst_size")) - 1e-6
    return stars.union(across).union(pairs.filter(F.col("times") + behind >= needed).select("src", "dst")).distinct()


def text_node(text: bytes) -> int:
    """A signed 64-bit name of a text's words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 42)).view(np.int64))


def text_prints(named: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, fp) of each row: SHA-256 of the text, the name of its words, the SimHash of its shingles."""
    kind = dict(named.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(t).digest() for t in texts]), pa.array([text_node(t) for t in texts], pa.int64()),
                                              pa.array([simhash(t) for t in texts], pa.int64())], names=["doc_id", "text_key", "node", "fp"])

    return named.mapInArrow(run, f"doc_id {kind}, text_key binary, node bigint, fp bigint")


def _compare(similarity: float, shingle: int):
    def run(group: pa.Table) -> pa.Table:
        """Links inside one pair of blocks; texts already known to belong together (equal ``part``) are not compared."""
        keys, parts = group["text_key"].to_pylist(), group["part"].to_pylist()
        by = {}
        for k, p, t in zip(keys, parts, group["text"].cast(pa.binary()).to_pylist()):
            by.setdefault(k, (p, t))                                  # an anchor may be a member too
        keys = sorted(by)
        a, b = similar([shingle_codes(by[k][1], shingle) for k in keys], similarity)
        names = {p: i for i, p in enumerate(dict.fromkeys(by[k][0] for k in keys))}
        part = np.array([names[by[k][0]] for k in keys])
        apart = part[a] != part[b]
        root = smallest_labels(len(keys), a[apart], b[apart])
        moved = np.flatnonzero(root != np.arange(len(keys))).tolist()
        return pa.table({"src": pa.array([keys[i] for i in moved], pa.binary()), "dst": pa.array([keys[root[i]] for i in moved], pa.binary())})
    return run


def verified_links(members: DataFrame, similarity: float, shingle: int, block_docs: int, block_bytes: int, anchors: int = 8) -> DataFrame:
    """(src, dst): links that connect the texts (text_key) of each ``class`` that are connected by similar pairs.

    ``members`` has class, text_key, text. A class is cut into blocks. First each block is compared in itself, together with the same few
    ``anchors`` of the class, which joins the blocks of a group of near copies. Then only texts that are still apart are
    compared: those outside the class's largest part with each other and with it. A task holds two blocks at most.
    """
    schema = "src binary, dst binary"
    sizes = members.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    large = stored(sizes.select("class", blocks.alias("blocks")).filter("blocks > 1"), "large-classes")
    dealt = lookup_join(members, large, ["class"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("text_key"), "blocks").cast("int")), "members")
    many = dealt.filter("blocks > 1").select("class", "blocks", "text_key")
    chosen = many.groupBy("class").agg(F.first("blocks").alias("all"), F.slice(F.sort_array(F.collect_set(F.when(F.xxhash64("text_key") % F.greatest("blocks", F.lit(1)) == 0, F.col("text_key")))), 1, anchors).alias("keys"))
    anchor = chosen.select("class", "all", F.explode("keys").alias("text_key")).join(dealt.select("class", "text_key", "text"), ["class", "text_key"])
    anchor = anchor.select("class", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("block"), "text_key", "text")
    own = dealt.select("class", "block", "text_key", "text").union(anchor).withColumn("part", F.col("text_key"))
    first = stored(own.groupBy("class", "block").applyInArrow(_compare(similarity, shingle), schema).distinct(), "links-inside")
    if not many.take(1):
        return first
    parts = connected_components(first).select(F.col("node").alias("text_key"), F.col("component").alias("part"))
    known = stored(dealt.filter("blocks > 1").join(parts, "text_key", "left").withColumn("part", F.coalesce("part", "text_key")), "parts")
    most = known.groupBy("class", "part").count().groupBy("class").agg(F.max(F.struct("count", "part")).alias("m")).select("class", F.col("m.part").alias("largest"))
    known = lookup_join(known, most, ["class"], "inner").withColumn("inside", F.col("part") == F.col("largest"))
    rest = known.filter(~F.col("inside")).groupBy("class").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("rest"))
    apart = lookup_join(known, rest, ["class"], "inner")
    # outsiders: block j of ``rest``; they meet each other (kind 0) and every block of the largest part (kind 1)
    j = F.pmod(F.xxhash64("text_key"), "rest").cast("int")
    outside = apart.filter(~F.col("inside")).withColumn("j", j)
    among = outside.select("class", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("o"), "j", "text_key", "text", "part")
    among = among.select("class", "kind", F.least("o", "j").cast("int").alias("i"), F.greatest("o", "j").cast("int").alias("j"), "text_key", "text", "part")
    meet = outside.select("class", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "j", "text_key", "text", "part")
    inner = apart.filter("inside").select("class", F.lit(1).alias("kind"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("j"),
                                          "text_key", "text", "part")
    across = among.union(meet).union(inner).groupBy("class", "kind", "i", "j").applyInArrow(_compare(similarity, shingle), schema)
    return first.union(stored(across.distinct(), "links-across")).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5,
                          radius: int = 3, block_docs: int = 1000, block_bytes: int = 8_000_000, **prefix) -> DataFrame:
    """(doc_id, text_key, group, kept) for each different pair of id and text: group is the smallest doc_id connected by near copies, pairs
    with a Jaccard similarity of their sets of word shingles of at least ``similarity``; one pair of each group is kept, that with the
    smallest id (null last), then the smallest text_key (SHA-256).

    Candidates are the pairs within ``radius`` bits of the covering SimHash search, which joins most copies, and all pairs that
    ``prefix_links`` (which takes ``prefix``) cannot rule out, so none of the similarity is missed. Classes of texts connected by candidates are
    compared by their sets of 64-bit shingle codes (``verified_links``).
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = stored(text_prints(named), "text-prints")
    nodes = prints.select("node", "fp").distinct()
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    covering = covering_links(firsts.select("fp"), radius)
    ends = firsts.select(F.col("fp").alias("src"), F.col("first").alias("a")), firsts.select(F.col("fp").alias("dst"), F.col("first").alias("b"))
    near = covering.join(ends[0], "src").join(ends[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    same = nodes.join(firsts, "fp").filter("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    links = stored(near.union(same).union(prefix_links(named, similarity, shingle, **prefix)).distinct(), "text-links")
    classes = connected_components(links).select("node", F.col("component").alias("class"))
    texts = stored(prints.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("node").alias("node")).join(classes, "node", "left")
                   .select("text_key", "rep", F.coalesce("class", "node").alias("class")), "distinct-texts")
    several = texts.groupBy("class").count().filter("count > 1").select("class")
    chosen = stored(texts.join(several, "class").select("class", "text_key", "rep"), "candidate-texts")
    # the texts of classes of two or more, found by their ids; the key tells which of the rows of an id is meant
    keyed = chosen.select(F.xxhash64("rep").alias("place"), "rep", "text_key", "class")
    with_text = lookup_join(named.withColumn("place", F.xxhash64("doc_id")), keyed, ["place"], "inner")
    members = with_text.filter(F.col("doc_id").eqNullSafe(F.col("rep")) & (F.unhex(F.sha2("text", 256)) == F.col("text_key")))
    members = stored(members.select("class", "text_key", "text").dropDuplicates(["text_key"]), "candidate-members")
    verified = stored(verified_links(members, similarity, shingle, block_docs, block_bytes), "verified-links")
    groups = connected_components(verified).select(F.col("node").alias("text_key"), "component")
    placed = texts.join(groups, "text_key", "left").select("text_key", "rep", F.coalesce("component", "text_key").alias("component"))
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_key")).alias("best"))
    final = placed.join(best, "component").select("text_key", F.col("best.rep").alias("group"), F.col("best.text_key").alias("best_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("group")) & (F.col("text_key") == F.col("best_key"))
    return prints.select("doc_id", "text_key").distinct().join(final, "text_key").select("doc_id", "text_key", "group", kept.alias("kept"))


def near_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near copies (``kept`` above); of equal rows of id and text one stays. Null ids are no bond: their rows are
    judged by their texts."""
    gone = near_duplicate_groups(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    gone = stored(gone, "dropped")
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kept = docs.withColumn("__text", key).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti")
    again = stored(kept.groupBy(id_col, "__text").count().filter("count > 1").select(F.col(id_col).alias("__id"), F.col("__text").alias("__key")), "repeated")
    if again.take(1):
        equal = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
        kept = kept.join(again, equal, "left_anti").union(kept.join(again, equal, "left_semi").dropDuplicates([id_col, "__text"]))
    return kept.drop("__text")
