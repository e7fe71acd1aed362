"""Splits, class-balanced samples, temporal sampling and partner choice; all orders are exact and seeded."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .ordering import Order, hash_order, rank_rows, running

GROUP_LIMIT = 1000     # up to this k Spark limits each group before the shuffle


def _ordered(df: DataFrame, key: str, seed: int | None) -> tuple[DataFrame, list[str]]:
    """Order column(s): by key, or pseudo-random when a seed is given."""
    if seed is None:
        return df, [key]
    return df.withColumn("_h", hash_order(seed, key)), ["_h", key]


def sort_manifest(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def topk(df: DataFrame, by: Sequence[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group in a total order (names, or (name, "desc")); NULL first ascending, last descending, for every k.

    Up to the group limit Spark cuts each group on the map side; a larger k takes sliced ranks.
    """
    if k > GROUP_LIMIT:
        return rank_rows(df, order, by, name).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("int"))
    keys = [F.col(o) if isinstance(o, str) else (F.desc(o[0]) if o[1] == "desc" else F.asc(o[0])) for o in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(F.col(name) <= k)


def spot_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First, middle and last row in a total order."""
    ranked = running(df, order, totals={"_n": F.lit(1)})
    return ranked.filter(F.col("rn").isin(1) | (F.col("rn") == F.floor(F.col("_n") / 2) + 1) | (F.col("rn") == F.col("_n"))).drop("_n")


def split_sizes(n: int, ratios: Sequence[float]) -> list[int]:
    """Rounded sizes (half to even); the last split takes the remainder."""
    if sum(ratios) > 1.001:
        raise ValueError(f"ratios sum to {sum(ratios)}, more than 1")
    sizes = [round(n * r) for r in ratios]
    sizes[-1] += n - sum(sizes)
    return sizes


def split_iid(df: DataFrame, key: str, ratios: Mapping[str, float], seed: int | None = 42) -> DataFrame:
    """Exact random split by ratios (``seed=None``: in key order)."""
    base, order = _ordered(df, key, seed)
    sizes = split_sizes(df.count(), list(ratios.values()))
    ranked = rank_rows(base, order, name="_rn")
    end, rule = 0, None
    for name, size in zip(ratios, sizes):
        end += size
        cond = F.col("_rn") <= end
        rule = F.when(cond, name) if rule is None else rule.when(cond, name)
    return ranked.withColumn("split", rule).drop("_rn", "_h")


def resplit(df: DataFrame, key: str, splits: Sequence[str], ratios: Sequence[float], seed: int | None = 42) -> DataFrame:
    """Pool the chosen splits and split them again; other rows keep their split."""
    chosen = F.col("split").isin(list(splits))
    again = split_iid(df.filter(chosen).drop("split"), key, dict(zip(splits, ratios)), seed)
    return df.filter(~chosen).unionByName(again)


def train_val_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int | None = 0) -> DataFrame:
    """Validation size is rounded up, as usual for a hold-out fraction."""
    n = df.count()
    n_val = -int(-n * test_size // 1)
    base, order = _ordered(df, key, seed)
    ranked = rank_rows(base, order, name="_rn")
    return ranked.withColumn("split", F.when(F.col("_rn") <= n - n_val, "train").otherwise("val")).drop("_rn", "_h")


def first_n_split(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    ranked = rank_rows(df, order, name="_rn")
    return ranked.withColumn("split", F.when(F.col("_rn") <= n, "train").otherwise("val")).drop("_rn")


def split_by_ids(df: DataFrame, lists: DataFrame, key: str, default: str = "val") -> DataFrame:
    """Explicit (key, split) lists; unlisted rows take ``default``."""
    return df.join(lists.select(key, F.col("split").alias("_s")), key, "left").withColumn(
        "split", F.coalesce("_s", F.lit(default))).drop("_s")


def _class_ranked(df: DataFrame, label: str, key: str, seed: int | None, extra: Sequence[str] = ()) -> DataFrame:
    base = df if seed is None else df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in (*extra, key)]))
    order = [key] if seed is None else ["_h", key]
    by = [*extra, label]
    return running(base, order, by, rank="_rn", totals={"_n": F.lit(1)}).drop("_h")


def stratified_split(df: DataFrame, label: str, key: str, p: float = 0.1, seed: int | None = None) -> DataFrame:
    """Per class max(1, int(p*n)) validation rows, none for singletons."""
    n = F.col("_n")
    take = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * p))).otherwise(0)
    return (_class_ranked(df, label, key, seed)
            .withColumn("split", F.when(F.col("_rn") <= take, "val").otherwise("train")).drop("_rn", "_n"))


def few_shot(df: DataFrame, label: str, key: str, n_or_percent: float, tries: int = 1, seed: int | None = 0) -> DataFrame:
    """n rows per class, or max(1, int(p*n)) when below 1; one independent draw per try."""
    many = df.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    n = F.col("_n")
    take = F.greatest(F.floor(n * n_or_percent), F.lit(1)) if n_or_percent < 1 else F.lit(int(n_or_percent))
    return _class_ranked(many, label, key, seed, ["try"]).filter(F.col("_rn") <= take).drop("_rn", "_n")


def balanced_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int | None = 42, ignore: int = 255) -> DataFrame:
    """min(per_class, size) rows of each class without replacement, ordered by key."""
    valid = df.filter((F.col(label) != ignore) & (F.col(label) >= 0))
    base, order = _ordered(valid, key, seed)
    return topk(base, [label], order, per_class, "_rn").drop("_rn", "_h").orderBy(key)


def rebalance_multilabel(df: DataFrame, key: str, labels: str, percent: float, seed: int = 0) -> DataFrame:
    """Multi-label percent sample: draw per class, compare achieved with wanted labels, draw again scaled.

    Rows carry an array of positive class ids; the two label counts are the only values read back.
    """
    def draw(p):
        long = df.select(key, F.explode(labels).alias("class_id"))
        return few_shot(long, "class_id", key, min(p, 0.999999), 1, seed).select(key).distinct()

    total = F.sum(F.size(labels)).alias("c")
    wanted = int(df.agg(total).first()["c"] * percent)
    got = df.join(draw(percent), key, "left_semi").agg(total).first()["c"] or 0
    scaled = percent / (got / wanted) if wanted and got else percent
    return df.join(draw(scaled), key, "left_semi")


def fraction_partitions(df: DataFrame, key: str, fractions: Sequence[float], seed: int | None = 42) -> DataFrame:
    """Nested training fractions: every smaller partition is a prefix of the larger ones."""
    base, order = _ordered(df, key, seed)
    n = df.count()
    sizes = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(max(1, round(n * f))).cast("bigint").alias("size"))
                      for f in fractions])
    ranked = rank_rows(base, order, name="_rn").withColumn("_f", F.explode(sizes))
    return ranked.filter(F.col("_rn") <= F.col("_f.size")).select(key, F.col("_f.fraction").alias("fraction"))


def epoch_index(spark: SparkSession, size: int, sample_count: int, shuffle: bool = False, seed: int = 0,
                start: int = 0, step: int = 1) -> DataFrame:
    """Sample indices of one epoch (tiled to ``size``), then every ``step``-th from ``start``."""
    if shuffle:
        tiled = -(-size // sample_count) * sample_count
        pos = spark.range(tiled).withColumn("_h", F.xxhash64(F.lit(seed), F.col("id")))
        pos = rank_rows(pos, ["_h", "id"], name="_rn").filter(F.col("_rn") <= size).select(
            (F.col("_rn") - 1).alias("pos"), (F.col("id") % sample_count).alias("sample"))
    else:
        pos = spark.range(size).select(F.col("id").alias("pos"), (F.col("id") % sample_count).alias("sample"))
    return pos.filter((F.col("pos") >= start) & (F.pmod(F.col("pos") - start, F.lit(step)) == 0))


def shard(df: DataFrame, order: Sequence[str], world: int, rank: int | None = None) -> DataFrame:
    """Round-robin shard number by position; ``rank`` keeps one shard."""
    out = rank_rows(df, order, name="_rn").withColumn("shard", F.pmod(F.col("_rn") - 1, F.lit(world)).cast("int")).drop("_rn")
    return out if rank is None else out.filter(F.col("shard") == rank)


def temporal_dropout(df: DataFrame, sample: str, date: str, max_t: int, seed: int) -> DataFrame:
    """At most ``max_t`` pseudo-random dates per sample."""
    return topk(df.withColumn("_h", hash_order(seed, sample, date)), [sample], ["_h", date], max_t, "_rn").drop("_h", "_rn")


def foreground_voxel(df: DataFrame, sample: str, label: str, key: Sequence[str], seed: int, background: int = 0) -> DataFrame:
    """One pseudo-random voxel of one pseudo-random foreground class per sample, as two min-by-hash aggregates."""
    fg = df.filter(F.col(label) != background)
    pick = fg.select(sample, label).distinct().groupBy(sample).agg(F.min_by(label, hash_order(seed, sample, label)).alias(label))
    best = F.min_by(F.struct(*key), hash_order(seed + 1, sample, *key)).alias("__voxel")
    return fg.join(pick, [sample, label]).groupBy(sample, label).agg(best).select(sample, label, "__voxel.*")


def mix_partners(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k partner samples for every sample by seeded index (a sample may draw itself)."""
    n = df.count()
    indexed = rank_rows(df.select(key), [key], name="_i").withColumn("_i", F.col("_i") - 1)
    drawn = indexed.select(key, F.posexplode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot", "_s")).select(
        key, "slot", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("slot")), F.lit(n)).alias("_i"))
    return drawn.join(indexed.withColumnRenamed(key, "partner"), "_i").drop("_i")


def _date_ranks(df: DataFrame, sample: str, date: str) -> tuple[DataFrame, DataFrame]:
    d = df.select(sample, date).distinct()
    return rank_rows(d, [date], [sample], name="_i").withColumn("_i", F.col("_i") - 1), d.groupBy(sample).agg(F.count("*").alias("n"))


def sample_dates_chunks(df: DataFrame, sample: str, date: str, target: int) -> DataFrame:
    """Middle date of each of ``target`` nearly equal chunks; too few dates repeat by a rounded linspace."""
    ranked, counts = _date_ranks(df, sample, date)
    n, j = F.col("n"), F.col("slot")
    q, r = F.floor(n / target), n % target
    chunk = j * q + F.least(j.cast("bigint"), r) + F.floor((q + (j < r).cast("int")) / 2)
    spread = F.rint(j * (n - 1) / float(max(target - 1, 1))).cast("bigint")
    slots = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    return slots.withColumn("_i", F.when(n < target, spread).otherwise(chunk)).join(ranked, [sample, "_i"]).select(sample, "slot", date)


def sample_dates_linspace(df: DataFrame, sample: str, date: str, k: int) -> DataFrame:
    """Truncated linspace over the dates; too few dates repeat the last one."""
    ranked, counts = _date_ranks(df, sample, date)
    n, j = F.col("n"), F.col("slot")
    slots = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pos = F.when(n <= k, F.least(j.cast("bigint"), n - 1)).otherwise(F.floor(j * (n - 1) / float(max(k - 1, 1))))
    return slots.withColumn("_i", pos).join(ranked, [sample, "_i"]).select(sample, "slot", date)


def uncertain_points(df: DataFrame, sample: str, key: Sequence[str], score: str, n: int, oversample: float = 3.0,
                     importance: float = 0.75, seed: int | None = 42) -> DataFrame:
    """Oversampled candidates, the least certain of them by |score|, the rest at random from all points."""
    pool, m = df, int(importance * n)
    if seed is not None:
        pool = topk(df.withColumn("_h", hash_order(seed, sample, *key)), [sample], ["_h", *key], int(n * oversample), "_c").drop("_h", "_c")
    sure = topk(pool.withColumn("_a", F.abs(score)), [sample], ["_a", *key], m, "point").drop("_a").withColumn("kind", F.lit("uncertain"))
    if n == m or seed is None:
        return sure
    rest = topk(df.withColumn("_h", hash_order(seed + 1, sample, *key)), [sample], ["_h", *key], n - m, "point").drop("_h")
    return sure.unionByName(rest.withColumn("kind", F.lit("random")))


# --- set operations ---------------------------------------------------------------------------
def merge_exclude(a: DataFrame, b: DataFrame, exclude: DataFrame) -> DataFrame:
    """(a union b) minus exclude, as sets."""
    return a.union(b).distinct().subtract(exclude)


def extra_only(extra: DataFrame, *known: DataFrame) -> DataFrame:
    """Members of ``extra`` found in none of the known sets."""
    out = extra.distinct()
    for k in known:
        out = out.subtract(k)
    return out


def check_subset(new: DataFrame, old: DataFrame) -> DataFrame:
    """Names of ``new`` that ``old`` does not know; empty means subset."""
    return new.subtract(old)


def check_disjoint(partitions: DataFrame, partition: str, split: str, name: str) -> DataFrame:
    """Violations: a name in several splits of a partition, or twice in one split."""
    per = partitions.groupBy(partition, name, split).agg(F.count("*").alias("c"))
    per = per.groupBy(partition, name).agg(F.count("*").alias("splits"), F.max("c").alias("copies"))
    rule = F.when(F.col("splits") > 1, "in_several_splits").when(F.col("copies") > 1, "duplicate")
    return per.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(partition, name, "rule")


def diff_names(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Symmetric difference with its side."""
    return (found.subtract(expected).withColumn("side", F.lit("unexpected"))
            .union(expected.subtract(found).withColumn("side", F.lit("missing"))))


def concat_datasets(*dfs: DataFrame) -> DataFrame:
    """Concatenation by column name with a dataset index; missing columns become NULL."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("dataset_index", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def observed_labels(label: str, *dfs: DataFrame, ignore: int = 255) -> DataFrame:
    """Vocabulary of the labels seen in any split."""
    out = None
    for d in dfs:
        d = d.filter(F.col(label) != ignore).select(label).distinct()
        out = d if out is None else out.union(d)
    return out.distinct()
