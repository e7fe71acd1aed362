"""Band statistics and intensity transforms on long tables (sample, [y, x,] band, value)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip
from ..functions.vectors import is_finite
from .joins import lookup_join
from .ordering import agg_join, hash_order, percentiles, rank_rows

# Quantiles of a band profile.
PROFILE = {"p0_1": 0.001, "p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def band_stats(df: DataFrame, band: str = "band", value: str = "value", approx: bool = False, per_sample: int | None = None,
               sample: str = "sample_id", key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Min, max, mean, population deviation and profile quantiles of each band.

    ``per_sample`` profiles at most that many seeded values of each sample and band (``key`` identifies a value).
    """
    if per_sample is not None:
        df = sample_values(df, [sample, band], key, per_sample, seed)
    base = df.groupBy(band).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                                F.stddev_pop(value).alias("std"))
    if approx:
        q = df.groupBy(band).agg(F.percentile_approx(value, list(PROFILE.values()), 10000).alias("q"))
        q = q.select(band, *[F.col("q")[i].alias(n) for i, n in enumerate(PROFILE)])
    else:
        q = percentiles(df, [band], value, PROFILE)
    return base.join(q, band)


def sample_values(df: DataFrame, by: Sequence[str], key: Sequence[str], per_sample: int, seed: int = 42) -> DataFrame:
    """At most ``per_sample`` pseudo-random rows of each group."""
    ranked = rank_rows(df.withColumn("_h", hash_order(seed, *by, *key)), ["_h", *key], by, name="_rn")
    return ranked.filter(F.col("_rn") <= per_sample).drop("_h", "_rn")


def _scaled(method: str, v: Column) -> Column:
    mean, std = F.col("mean"), F.col("std")
    if method == "standardize":
        return F.try_divide(v - mean, std)
    if method in ("two_sigma", "one_sigma"):
        k = 2.0 if method == "two_sigma" else 1.0
        return F.try_divide(v - (mean - k * std), 2 * k * std)
    if method == "min_max":
        return F.try_divide(v - F.col("min"), F.col("max") - F.col("min"))
    raise ValueError(f"unknown scaling {method}")


def normalize(df: DataFrame, stats: DataFrame, method: str = "standardize", band: str = "band", value: str = "value") -> DataFrame:
    """Scale by band statistics: standardize, one_sigma, two_sigma (both unclipped) or min_max.

    A band without spread gives NULL; rows of a band without statistics pass unchanged.
    """
    cols = [c for c in stats.columns if c != band]
    joined = lookup_join(df, stats.withColumn("_known", F.lit(True)), [band])
    v = F.col(value).cast("double")
    return joined.withColumn(value, F.when(F.col("_known"), _scaled(method, v)).otherwise(v)).drop(*cols, "_known")


def normalize_modalities(df: DataFrame, stats: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Standardise with deviation floored at 1e-6; rows without statistics pass unchanged."""
    joined = lookup_join(df, stats.select(*on, "mean", "std"), on)
    scaled = (F.col(value) - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-6))
    return joined.withColumn(value, F.coalesce(scaled, F.col(value))).drop("mean", "std")


def scale_depth(df: DataFrame, factor: float, value: str = "depth") -> DataFrame:
    """Raw depth to metres (or any unit) by a constant factor; NULL stays NULL."""
    return df.withColumn(value, F.col(value).cast("double") * factor)


def fold_stats(stats: DataFrame, folds: Sequence[int], eps: float = 1e-6, band: str = "band") -> DataFrame:
    """Mean over folds of the fold means and deviations; the deviation is floored."""
    return (stats.filter(F.col("fold").isin(list(folds))).groupBy(band)
                 .agg(F.avg("mean").alias("mean"), F.greatest(F.avg("std"), F.lit(eps)).alias("std")))


def reflectance(c: Column, scale: float = 10000.0) -> Column:
    """Fallback scaling without statistics."""
    return clip(c.cast("double") / scale, 0.0, 1.0)


def rerange(df: DataFrame, sample: Sequence[str], lo: float, hi: float, value: str = "value") -> DataFrame:
    """Per-sample min-max to lo..hi; a constant sample gives NULL (report it as a violation)."""
    both = agg_join(df, sample, F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    scaled = F.try_divide(F.col(value) - F.col("_mn"), F.col("_mx") - F.col("_mn")) * (hi - lo) + lo
    return both.withColumn(value, scaled).drop("_mn", "_mx")


def select_bands(df: DataFrame, order: Sequence[str], imputes: Mapping[str, str], band: str = "band") -> DataFrame:
    """Reorder bands and fill a wanted band from its source band when it is absent from the whole sample.

    ``imputes`` maps target -> source. Adds ``band_index``; a band with neither is left out (audit it).
    A real band beats an imputed one; of repeated values of one position and band the largest counts.
    """
    keys = [c for c in df.columns if c not in (band, "value")]
    if not any(name in imputes for name in order):
        served: dict[str, list[tuple[int, str]]] = {}
        for i, name in enumerate(order):
            served.setdefault(name, []).append((i, name))
        rows = [F.when(F.col(band) == src, F.array(*[F.struct(F.lit(i).alias("band_index"), F.lit(n).alias("_b")) for i, n in targets])) for src, targets in served.items()]
        return df.withColumn("_t", F.coalesce(*rows)).select(*keys, "value", F.inline("_t")).select(*keys, "band_index", F.col("_b").alias(band), "value")   # nothing to choose between
    # one row per position moves, with the values of all bands that can serve
    sources = list(dict.fromkeys(s for name in order for s in (name, imputes.get(name)) if s is not None))
    at = {s: i for i, s in enumerate(sources)}
    mine = {s: F.col(band) == s for s in sources}
    wide = df.filter(F.col(band).isin(sources)).groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"_h{at[s]}") for s, c in mine.items()],
                                                                  *[F.max(F.when(c, F.col("value"))).alias(f"_v{at[s]}") for s, c in mine.items()])
    picks = []
    for i, name in enumerate(order):
        pick = lambda s: F.when(F.col(f"_h{at[s]}"), F.struct(F.lit(i).alias("band_index"), F.lit(name).alias(band), F.col(f"_v{at[s]}").alias("value")))  # noqa: B023, E731
        picks.append(F.coalesce(pick(name), pick(imputes[name])) if name in imputes else pick(name))
    return wide.select(*keys, F.inline(F.filter(F.array(*picks), lambda p: p.isNotNull())))


def impute_stats(stats: DataFrame, order: Sequence[str], imputes: Mapping[str, str], band: str = "band") -> DataFrame:
    """The same rule on a statistics table (one row per band)."""
    want = stats.sparkSession.createDataFrame([(i, b, imputes.get(b)) for i, b in enumerate(order)],
                                              "band_index int, want string, source string")
    have = stats.withColumnRenamed(band, "_band")
    own = want.join(have, F.col("want") == F.col("_band"), "left_anti")
    direct = want.join(have, F.col("want") == F.col("_band")).drop("_band", "source")
    via = own.join(have, F.col("source") == F.col("_band")).drop("_band", "source")
    return direct.unionByName(via).withColumnRenamed("want", band)


def rgb_to_bands(df: DataFrame, stats: DataFrame, rgb: Mapping[str, str], bands: Sequence[str], mode: str = "auto",
                 sample: str = "sample_id", k: float = 2.0) -> DataFrame:
    """RGB values -> normalised multi-band proxy; bands without a colour are 0 (the normalised fill).

    ``rgb`` maps colour -> band. ``auto`` reads a sample as 0..1 when its largest value is at most 1.5.
    """
    v = F.col("value").cast("double")
    if mode == "auto":
        df = agg_join(df, [sample], F.max("value").alias("_mx"))
        scaled = F.when(F.col("_mx") <= 1.5, v * 10000.0).otherwise(v * (10000.0 / 255.0))
    else:
        scaled = {"s2": v, "0_1": v * 10000.0, "0_255": v * (10000.0 / 255.0)}[mode]
    colour = F.create_map(*[F.lit(x) for kv in rgb.items() for x in kv])
    mapped = (df.withColumn("value", scaled).withColumn("band", F.element_at(colour, F.col("band"))).drop("_mx"))
    real = normalize(mapped.filter(F.col("band").isNotNull()), stats.select("band", "mean", "std"), "two_sigma" if k == 2.0 else "one_sigma")
    rest = [b for b in bands if b not in rgb.values()]
    if not rest:
        return real
    first = next(iter(rgb.values()))
    fill = (real.filter(F.col("band") == first).withColumn("band", F.explode(F.array(*[F.lit(b) for b in rest])))
                .withColumn("value", F.lit(0.0)))
    return real.unionByName(fill)


# Luma weights of red, green and blue.
LUMA = {"R": 0.299, "G": 0.587, "B": 0.114}


def to_gray(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float] | None = None,
            channels: Sequence[str] = ("gray",)) -> DataFrame:
    """Weighted channel sum (plain mean without weights), repeated over ``channels``."""
    if weights is None:
        grey = F.avg("value")
    else:
        grey = F.sum(sum((F.when(F.col("band") == b, F.col("value") * w).otherwise(0.0) for b, w in weights.items()), F.lit(0.0)))
    return (df.groupBy(*keys).agg(grey.alias("value"))
              .withColumn("band", F.explode(F.array(*[F.lit(c) for c in channels]))))


def gamma_stats(df: DataFrame, sample: Sequence[str], gamma: float, retain: bool = False, invert: bool = False,
                value: str = "value") -> DataFrame:
    """Gamma on each sample's own range, optionally on the negative, optionally keeping mean and deviation."""
    sign = -1.0 if invert else 1.0
    df = df.withColumn(value, F.col(value) * sign)
    v = F.col(value)
    st = agg_join(df, sample, F.min(v).alias("_mn"), (F.max(v) - F.min(v)).alias("_rg"), F.avg(v).alias("_mu"),
                  F.stddev_pop(v).alias("_sd"))
    out = F.pow((v - F.col("_mn")) / (F.col("_rg") + 1e-7), F.lit(float(gamma))) * F.col("_rg") + F.col("_mn")
    st = st.withColumn(value, out)
    if retain:
        st = agg_join(st, sample, F.avg(value).alias("_m2"), F.stddev_pop(value).alias("_s2"))
        st = st.withColumn(value, (F.col(value) - F.col("_m2")) / (F.col("_s2") + 1e-8) * F.col("_sd") + F.col("_mu"))
    return st.withColumn(value, F.col(value) * sign).drop("_mn", "_rg", "_mu", "_sd", "_m2", "_s2")


def add_noise(df: DataFrame, sample: str, key: Sequence[str], mean: float, std: float, seed: int, value: str = "value") -> DataFrame:
    """Gaussian noise whose deviation is drawn per sample from 0..std.

    Draws come from seeded hashes (Box-Muller), so a recomputed task repeats them.
    """
    def unit(*parts):
        return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2 ** 52)).cast("double") + 0.5) / float(2 ** 52)
    cols = [F.col(c) for c in key]
    sigma = unit(F.lit("sigma"), F.col(sample)) * std
    z = F.sqrt(-2 * F.log(unit(F.lit("u"), F.col(sample), *cols))) * F.cos(2 * F.pi() * unit(F.lit("v"), F.col(sample), *cols))
    return df.withColumn(value, F.col(value) + mean + sigma * z)


def stack_inputs(a: DataFrame, b: DataFrame, channel: str, n_channels: int) -> DataFrame:
    """Two images as one: channels of the second follow those of the first."""
    return a.unionByName(b.withColumn(channel, F.col(channel) + n_channels))


def clean_bands(df: DataFrame, keep: Sequence[str], scales: Mapping[str, float], band: str = "band", value: str = "value") -> DataFrame:
    """Chosen bands only, NaN as 0, each band multiplied by its factor."""
    table = F.create_map(*[F.lit(x) for b in keep for x in (b, float(scales.get(b, 1.0)))])
    fixed = F.nanvl(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.filter(F.col(band).isin(list(keep))).withColumn(value, fixed * F.element_at(table, F.col(band)))


def stretch(df: DataFrame, by: Sequence[str], lo: float = 2, hi: float = 98, value: str = "value") -> DataFrame:
    """Percentile stretch to 0..255 per group: falls back to min/max, constant or empty groups give 0.

    Non-finite values take no part in the limits. Scaled values are rounded to nine digits before they
    are truncated, so rounding noise of the limits cannot move an exact integer down.
    """
    finite = df.filter(is_finite(F.col(value)))
    lim = percentiles(finite, by, value, {"_lo": lo / 100, "_hi": hi / 100, "_mn": 0.0, "_mx": 1.0})
    lim = lim.select(*by, F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_mn")).alias("_a"),
                                         F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_mx")).alias("_b"))
    scaled = clip((F.col(value) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * 255.0, 0.0, 255.0)
    return (df.join(lim, list(by), "left")
              .withColumn(value, F.coalesce(F.floor(F.round(F.nanvl(scaled, F.lit(0.0)), 9)).cast("int"), F.lit(0))).drop("_a", "_b"))
