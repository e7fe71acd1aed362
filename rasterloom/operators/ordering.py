"""Exact ranks, running sums, fills and percentiles that never put a whole group into one task.

A plain window sorts each group in one task. These helpers cut every group into slices of the
order key, rank inside the slices and add the totals of the earlier slices. The slice bounds are
sampled key tuples, so a hot key value is cut as well (its tie-break column is part of the tuple);
the bounds only steer balance, results stay exact whatever was sampled. NULL is a group like any other.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

ROWS_PER_SLICE = 500_000
SLICES = 256            # more only when slices would exceed ROWS_PER_SLICE: each is a partition and a checkpoint file
Order = Sequence["str | tuple[str, str]"]


def hash_order(seed: int, *cols: str) -> Column:
    """Seeded pseudo-random order key: the one rule behind every random choice of the library."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def drawn(n: Column, *parts: Column | int | str) -> Column:
    """A pseudo-random whole number from 0 to n - 1, from the MD5 of the parts joined by colons; any engine can repeat it."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def _keys(order: Order) -> list[Column]:
    """Sort columns; NULL comes first in ascending and last in descending order, as in any Spark sort."""
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        out.append(F.asc(name) if direction == "asc" else F.desc(name))
    return out


def with_slice(df: DataFrame, order: Order, by: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame | None:
    """Add ``_slice``, a monotone function of the order key; None when no group exceeds one slice.

    A counting pass decides. Slices are the partitions of a range partitioning by the whole order key (Spark samples it, so
    any type, NULL and direction will do, and a hot leading value is cut by its tie-break columns); there are as many as
    the rows need, but smaller ``rows_per_slice`` than the default give no more than ``SLICES``. The result is checkpointed, because a second evaluation could sample other bounds.
    """
    facts = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if (facts["top"] or 0) <= rows_per_slice:
        return None
    slices = min(math.ceil(facts["all"] / rows_per_slice), max(SLICES, math.ceil(facts["all"] / ROWS_PER_SLICE)))
    return cut_lineage(df.repartitionByRange(slices, *_keys(order)).withColumn("_slice", F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of equal name where NULL equals NULL; the columns appear once."""
    if not on:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    named = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    both = left.join(named, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on], how)
    return both.drop(*[f"__on_{c}" for c in on])


def running(df: DataFrame, order: Order, by: Sequence[str] = (), rank: str | None = "rn",
            sums: Mapping[str, str | Column] | None = None, totals: Mapping[str, str | Column] | None = None,
            rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Row number and inclusive running sums of each group in ``order`` (which must be total).

    ``totals`` adds sums over the whole group at no extra shuffle.
    """
    sums = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (sums or {}).items()}
    totals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (totals or {}).items()}
    by = list(by)
    keys = _keys(order)
    sliced = with_slice(df, order, by, rows_per_slice)
    local = by if sliced is None else [*by, "_slice"]
    base = df if sliced is None else sliced
    w = Window.partitionBy(*local).orderBy(*keys)
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = [F.sum(c).over(Window.partitionBy(*by)).alias(k) for k, c in totals.items()] if sliced is None else []
    out = base.select("*", *([F.row_number().over(w).cast("bigint").alias(rank)] if rank else []),
                      *[F.sum(c).over(cum).alias(k) for k, c in sums.items()], *whole)
    if sliced is None:
        return out
    parts = sliced.groupBy(*local).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()],
                                       *[F.sum(c).alias(f"_t_{k}") for k, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*local, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                           *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s0_{k}") for k in sums],
                           *[F.sum(f"_t_{k}").over(Window.partitionBy(*by)).alias(k) for k in totals])
    out = same_keys(out, offsets, local)
    if rank:
        out = out.withColumn(rank, F.col(rank) + F.col("_n0"))
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"_s0_{k}"))
    return out.drop("_n0", "_slice", *[f"_s0_{k}" for k in sums])


def rank_rows(df: DataFrame, order: Order, by: Sequence[str] = (), name: str = "rn",
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    return running(df, order, by, rank=name, rows_per_slice=rows_per_slice)


def with_one(df: DataFrame, *ones: DataFrame) -> DataFrame:
    """Add the columns of one-row tables as scalar subqueries (no join, nothing to broadcast but one row)."""
    for i, one in enumerate(ones):
        name = f"__one{i}"
        df = df.withColumn(name, one.select(F.struct(*one.columns).alias("s")).scalar()).select("*", f"{name}.*").drop(name)
    return df


def agg_join(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates by aggregate-then-join.

    Unlike a window without ordering this pre-aggregates before the shuffle, and the join leaves
    AQE free to broadcast the aggregate or split a hot group.
    """
    if not by:
        return with_one(df, df.agg(*aggs))
    return same_keys(df, df.groupBy(*by).agg(*aggs), by)


def carry_forward(df: DataFrame, value: str, by: Sequence[str], pos: str, name: str,
                  default=None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Last non-null ``value`` at or before each row; ``pos`` is a dense integer position in the group."""
    by = list(by)
    sliced = df.withColumn("_slice", F.floor(F.col(pos) / rows_per_slice))
    w = Window.partitionBy(*by, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_last", F.last(value, ignorenulls=True).over(w))
    marks = sliced.groupBy(*by, "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_end"))
    # carry of a slice = end value of the nearest earlier slice that has one
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    filled = F.coalesce(F.col("_last"), F.col("_carry"), *([] if default is None else [F.lit(default)]))
    return same_keys(local, carry, [*by, "_slice"]).withColumn(name, filled).drop("_slice", "_last", "_carry")


HISTOGRAM_BUCKETS = 2048
BROADCAST_GROUPS, BROADCAST_KEY_BYTES = 50_000, 16_000_000      # of a table with a row per large group


def percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Mapping[str, float],
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group, one column per entry of ``ps``; NULLs take no part, NaN is largest.

    A selection, not a sort. One pass counts the groups. Where none exceeds ``rows_per_slice`` each is one sorted array. Otherwise
    histograms narrow the wanted ranks down: a pass counts equal-width buckets of every interval that holds one (only bucket counts
    are shuffled), and the buckets that hold ranks are the next intervals, until each holds one value or at most ``rows_per_slice``
    rows, which are sorted. The input is read again in every pass and never written.
    """
    by = list(by)
    vals = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    facts = cut_lineage(vals.groupBy(*by).agg(F.count("*").alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    if (facts.agg(F.max("_n")).first()[0] or 0) <= rows_per_slice:
        listed = vals.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_a"))
        return listed.withColumn("_n", F.size("_a")).select(*by, *_interpolated(ps, lambda k: F.get("_a", k.cast("int"))))
    found = _select_ranks(vals, facts, by, list(ps.values()), rows_per_slice)
    packed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))
    both = same_keys(facts, packed, by) if by else with_one(facts, packed)
    return both.select(*by, *_interpolated(ps, lambda k: F.try_element_at("_m", k)))


def _interpolated(ps: Mapping[str, float], nth) -> list[Column]:
    """Percentile columns from ``nth(k)``, the k-th smallest of ``_n`` values."""
    out = []
    for name, p in ps.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = nth(F.floor(at)), nth(F.ceil(at))
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out


def _with_groups(vals: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group; the group table is broadcast only if it is counted to be short."""
    if not by:
        return with_one(vals, groups)
    size = groups.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*by)))).alias("bytes")).first()
    small = size["n"] <= BROADCAST_GROUPS and (size["bytes"] or 0) <= BROADCAST_KEY_BYTES
    return same_keys(vals, F.broadcast(groups) if small else groups, by)


def _select_ranks(vals: DataFrame, facts: DataFrame, by: list[str], ps: Sequence[float], limit: int) -> DataFrame:
    """(by, _k, _x): the 0-based ranks next to every percentile and the values there."""
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in ps]
    wanted = facts.select(*by, F.array_distinct(F.array(*[f(a) for a in at for f in (F.floor, F.ceil)])).alias("_ks"))
    # an interval: its finite bounds (whole = every value of the group), the rows below it and the rows in it
    spans = facts.select(*by, F.lit(True).alias("whole"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("bigint").alias("base"), F.col("_n").alias("n"))
    span = F.struct("whole", "lo", "hi", "base", "n")
    ready, solved = [spans.filter(F.col("n") <= limit)], []
    spans, first = spans.filter(F.col("n") > limit), True

    def inside(table, first=False):
        if first:
            return _with_groups(vals, table.select(*by, span.alias("s")), by)
        packed = table.groupBy(*by).agg(F.collect_list(span).alias("_spans"))
        # a generator is evaluated once a row, and rows outside all intervals end here
        hit = F.filter("_spans", lambda s: s["whole"] | F.col("_v").between(s["lo"], s["hi"]))
        return _with_groups(vals, packed, by).select(*by, "_v", F.explode(hit).alias("s"))

    while True:
        lo, hi, top = F.col("s.lo"), F.col("s.hi"), HISTOGRAM_BUCKETS - 1
        step = F.floor(F.coalesce(F.try_divide(F.col("_v") / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0)) * HISTOGRAM_BUCKETS)
        slot = (F.when(F.isnan("_v"), top + 2).when(F.col("_v") == float("inf"), top + 1).when(F.col("_v") == float("-inf"), -1)
                 .otherwise(F.least(F.greatest(step, F.lit(0)), F.lit(top))))
        counted = inside(spans, first).groupBy(*by, "s", slot.cast("int").alias("slot")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        earlier = Window.partitionBy(*by, "s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("base", F.col("s.base") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        counted = same_keys(counted, wanted, by) if by else with_one(counted, wanted)
        held = F.filter("_ks", lambda k: (k >= F.col("base")) & (k < F.col("base") + F.col("n")))
        counted = cut_lineage(counted.withColumn("_ks", held).filter(F.size("_ks") > 0))
        one = F.col("lo") == F.col("hi")
        solved.append(counted.filter(one).select(*by, F.explode("_ks").alias("_k"), F.col("lo").alias("_x")))
        # bounds that rounding cannot part any more are sorted as well
        stuck = (F.col("n") <= limit) | (F.col("n") == F.col("s.n")) & (F.col("lo") == lo) & (F.col("hi") == hi)
        nxt = counted.filter(~one).select(*by, F.lit(False).alias("whole"), "lo", "hi", "base", "n", stuck.alias("stuck"))
        ready.append(nxt.filter("stuck").drop("stuck"))
        spans, first = nxt.filter("NOT stuck").drop("stuck"), False
        if not spans.take(1):
            break
    rest = ready[0]
    for part in ready[1:]:
        rest = rest.unionByName(part)
    if rest.take(1):
        listed = inside(rest).groupBy(*by, "s").agg(F.sort_array(F.collect_list("_v")).alias("_a"))
        listed = same_keys(listed, wanted, by) if by else with_one(listed, wanted)
        held = F.filter("_ks", lambda k: (k >= F.col("s.base")) & (k < F.col("s.base") + F.size("_a")))
        solved.append(listed.select(*by, "s", "_a", F.explode(held).alias("_k")).select(*by, "_k", F.get("_a", (F.col("_k") - F.col("s.base")).cast("int")).alias("_x")))
    out = solved[0]
    for part in solved[1:]:
        out = out.unionByName(part)
    return out


def nth_smallest(df: DataFrame, value: str, tie: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """Value at 0-based position ``min(n, size-1)`` of each group, as one row per group (``nth``)."""
    sized = running(df, [value, *tie], by, totals={"_n": F.lit(1)})
    hit = sized.filter(F.col("rn") == F.least(F.lit(n + 1), F.col("_n")))
    return hit.select(*by, F.col(value).alias("nth"))
