"""Exact cosine neighbours by blocks.

Queries and gallery are cut into blocks of bounded size; a block pair is multiplied piece by piece
inside one task, which returns at most k rows per query (or one count), never the pairs. No side needs
to fit into one executor. A very large gallery is cut into balls around pivots: a query meets its own
ball first, then only the balls whose bound q.p + |q| radius reaches its k-th similarity so far.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import l2_normalize
from ..session import cut_lineage

ROWS_PER_BLOCK = 4096
WIDE = 4                # gallery blocks per query block in the chunked top-k product
SHIP_BYTES = 32_000_000  # of vectors in a shuffled block; a task holds one of each side
PAIRS_PER_CORE = 4      # pairs of shuffled blocks
BALLS_FROM = 1_000_000  # gallery rows from which balls are worth their own shuffles
PIVOTS = 1024           # balls at most; larger balls are cut into parts, so only this many vectors reach the driver
BOUND_SLACK = 1e-7      # above the rounding of similarities and of the bounds
SIM_DIGITS = 9          # similarities are rounded before ranking, so copies tie exactly


def shipped_blocks(df: DataFrame, n: int, rows_per_block: int) -> int:
    """Blocks one side is cut into for the shuffle: as few as give each core a few pairs, none above ``SHIP_BYTES`` of array entries."""
    most = max(1, math.ceil(n / rows_per_block))
    few = math.ceil(math.sqrt(PAIRS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))
    if most <= few:
        return most
    arrays = [F.coalesce(F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    width = (df.agg(F.max(sum(arrays, F.lit(1)))).first()[0] or 1) * 8
    return max(few, min(most, math.ceil(n * width / SHIP_BYTES)))


def cut_up(fn: Callable, rows_a: int, rows_b: int, merge: Callable | None = None) -> Callable:
    """``fn`` on pieces of two large blocks, so that no product exceeds ``rows_a`` x ``rows_b``; ``merge`` condenses the results of each piece of the first."""
    def run(a, b):
        import pandas as pd
        out = []
        for i in range(0, max(len(a), 1), rows_a):
            parts = [fn(a.iloc[i:i + rows_a], b.iloc[j:j + rows_b]) for j in range(0, max(len(b), 1), rows_b)]
            full = [p for p in parts if len(p)] or parts[:1]
            part = full[0] if len(full) == 1 else pd.concat(full, ignore_index=True)
            out.append(merge(part) if merge and len(full) > 1 else part)
        full = [p for p in out if len(p)] or out[:1]
        return full[0] if len(full) == 1 else pd.concat(full, ignore_index=True)
    return run


def block_pairs(q: DataFrame, g: DataFrame, key: str, fn: Callable, schema: str,
                rows_per_block: int = ROWS_PER_BLOCK, n_q: int | None = None, n_g: int | None = None, wide: int = 1, merge: Callable | None = None, mirrored: bool = False) -> DataFrame:
    """Run ``fn(query frame, gallery frame) -> frame`` on every pair of blocks of at most ``rows_per_block`` (gallery: times ``wide``) rows.

    Rows are copied once for every block of the other side, so the blocks that are shuffled are large (``shipped_blocks``) and cut up in the task.
    ``mirrored``: both sides are one table and pairs have no direction, so of two mirrored pairs of blocks one is left out; ``fn`` gets whole blocks.
    """
    bq = shipped_blocks(q, n_q if n_q is not None else q.count(), rows_per_block)
    bg = shipped_blocks(g, n_g if n_g is not None else g.count(), rows_per_block * wide)

    def block(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")

    g = g.toDF(*g.columns)          # fresh attributes, so both sides may be the same table
    if mirrored:
        left = q.withColumn("_qb", block(1, bq)).withColumn("_gb", F.explode(F.sequence(F.col("_qb"), F.lit(bq - 1))))
        right = g.withColumn("_gb", block(1, bq)).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_gb"))))
        return left.groupBy("_qb", "_gb").cogroup(right.groupBy("_qb", "_gb")).applyInPandas(fn, schema)
    left = q.withColumn("_qb", block(1, bq)).withColumn("_gb", F.explode(F.sequence(F.lit(0), F.lit(bg - 1))))
    right = g.withColumn("_gb", block(2, bg)).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    return left.groupBy("_qb", "_gb").cogroup(right.groupBy("_qb", "_gb")).applyInPandas(cut_up(fn, rows_per_block, rows_per_block * wide, merge), schema)


def _side(df: DataFrame, key: str, vec: str, label: str | None, normalize: bool, extra: Sequence[str] = ()) -> DataFrame:
    v = l2_normalize(F.col(vec)) if normalize else F.col(vec).cast("array<double>")
    lab = F.lit(None).cast("int") if label is None else F.col(label).cast("int")
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v"), lab.alias("label"), *extra)


def nearest(q: DataFrame, g: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", label: str | None = "label",
            exclude_self: bool = False, normalize: bool = True, rows_per_block: int = ROWS_PER_BLOCK, balls_from: int = BALLS_FROM) -> DataFrame:
    """Top k gallery rows per query: (q_id, q_label, g_id, g_label, sim, rank), ties by gallery id. Galleries of more than ``balls_from`` rows are pruned by balls."""
    digits = SIM_DIGITS

    def fn(a, b):
        import numpy as np
        import pandas as pd
        cols = ["q_id", "q_label", "g_id", "g_label", "sim"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in cols})
        b = b.sort_values("id")
        gv, gid = np.stack(b["v"].to_numpy()), b["id"].to_numpy()
        parts = []
        for s in range(0, len(a), 512):
            part = a.iloc[s:s + 512]
            qid = part["id"].to_numpy()
            sim = np.round(np.stack(part["v"].to_numpy()) @ gv.T, digits)
            sim[~np.isfinite(sim)] = -np.inf
            if exclude_self:
                sim[qid[:, None] == gid[None, :]] = -np.inf
            kk = min(k, sim.shape[1])
            edge = np.partition(sim, sim.shape[1] - kk, axis=1)[:, sim.shape[1] - kk]
            above, tied = sim > edge[:, None], sim == edge[:, None]
            room = kk - above.sum(axis=1)           # copies tie: the first ones by id fill up to k
            tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= room[:, None]
            r, c = np.nonzero((above | tied) & np.isfinite(sim))
            order = np.lexsort((c, -sim[r, c], r))
            r, c = r[order], c[order]
            parts.append(pd.DataFrame({"q_id": qid[r], "q_label": part["label"].to_numpy()[r], "g_id": gid[c],
                                       "g_label": b["label"].to_numpy()[c], "sim": sim[r, c]}))
        return pd.concat(parts)

    def top(found):
        found = found.sort_values(["q_id", "sim", "g_id"], ascending=[True, False, True])
        return found[found.groupby("q_id").cumcount().to_numpy() < k]

    schema = "q_id bigint, q_label int, g_id bigint, g_label int, sim double"
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "g_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    qs, gs = _side(q, key, vec, label, normalize), _side(g, key, vec, label, normalize)
    n_g = gs.count()
    n_balls = min(PIVOTS, math.ceil(n_g / (rows_per_block * WIDE))) if n_g > balls_from else 1
    if n_balls < 2:
        return best(block_pairs(qs, gs, "id", fn, schema, rows_per_block, n_g=n_g, wide=WIDE, merge=top))
    balls = Balls(qs, gs, n_balls, rows_per_block)
    first = cut_lineage(best(balls.products(balls.own(), fn, schema)).drop("rank"))
    edges = first.groupBy(F.col("q_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("edge"))
    return best(first.unionByName(balls.products(balls.open(edges), fn, schema)))


class Balls:
    """Queries and gallery by nearest pivot, cut into parts of bounded size.

    Pivots are gallery rows in hash order. A ball of many copies has several parts; every part is a block of its own.
    """

    def __init__(self, queries: DataFrame, gallery: DataFrame, n: int, rows_per_block: int):
        import numpy as np
        spark = gallery.sparkSession
        rows = gallery.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
        self.pivots = pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in rows], float))

        def place(batches):
            for b in batches:
                v = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, pivots.value.shape[1]))
                p = pivots.value
                far = (p * p).sum(axis=1)[None, :] - 2 * (v @ p.T)
                ball = far.argmin(axis=1)
                yield b.assign(ball=ball.astype("int32"), gap=np.linalg.norm(v - p[ball], axis=1))

        schema = "id bigint, v array<double>, label int, ball int, gap double"
        g = cut_lineage(gallery.mapInPandas(place, schema))
        q = cut_lineage(queries.mapInPandas(place, schema))
        facts = g.groupBy("ball").agg(F.ceil(F.count("*") / (rows_per_block * WIDE)).cast("int").alias("g_parts"),
                                      F.max(F.when(~F.isnan("gap"), F.col("gap"))).alias("radius")).collect()       # one row a ball
        self.radii = {r["ball"]: r["radius"] or 0.0 for r in facts}
        self.parts = spark.createDataFrame([(r["ball"], r["g_parts"]) for r in facts], "g_ball int, g_parts int")
        q_parts = q.groupBy("ball").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("q_parts")).collect()
        q_parts = spark.createDataFrame([(r["ball"], r["q_parts"]) for r in q_parts], "ball int, q_parts int")
        part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        # at most PIVOTS rows each
        self.queries = (q.join(F.broadcast(q_parts), "ball")
                        .select("id", "v", "label", F.col("ball").alias("q_ball"), part(1, "q_parts").alias("q_part")))
        self.gallery = (g.withColumnRenamed("ball", "g_ball").join(F.broadcast(self.parts), "g_ball")
                        .select("id", "v", "label", "g_ball", part(2, "g_parts").alias("g_part")))

    def own(self) -> DataFrame:
        """(id, q_ball, q_part, g_ball): each query with its own ball."""
        return self.queries.select("id", "q_ball", "q_part", F.col("q_ball").alias("g_ball"))

    def open(self, edges: DataFrame) -> DataFrame:
        """The other balls that can hold a row as similar as ``edge`` (null: all)."""
        pivots, radii = self.pivots, self.radii

        def reach(batches):
            import numpy as np
            import pandas as pd
            ball = np.array(sorted(radii), "int32")
            radius = np.array([radii[x] for x in ball])
            for b in batches:
                if not len(b):
                    continue
                v = np.stack(b["v"].to_numpy())
                bound = v @ pivots.value[ball].T + np.linalg.norm(v, axis=1)[:, None] * radius[None, :] + BOUND_SLACK
                edge = b["edge"].fillna(-np.inf).to_numpy(float)
                r, c = np.nonzero((bound >= edge[:, None]) & (ball[None, :] != b["q_ball"].to_numpy()[:, None]))
                yield pd.DataFrame({"id": b["id"].to_numpy()[r], "q_ball": b["q_ball"].to_numpy()[r], "q_part": b["q_part"].to_numpy()[r], "g_ball": ball[c]})

        known = self.queries.join(edges, "id", "left").select("id", "v", "q_ball", "q_part", "edge")
        return cut_lineage(known.mapInPandas(reach, "id bigint, q_ball int, q_part int, g_ball int"))

    def block_pairs(self, links: DataFrame) -> DataFrame:
        """Distinct (q_ball, q_part, g_ball, g_part) that must be multiplied."""
        return (links.select("q_ball", "q_part", "g_ball").distinct().join(F.broadcast(self.parts), "g_ball")
                .select("q_ball", "q_part", "g_ball", F.explode(F.sequence(F.lit(0), F.col("g_parts") - 1)).alias("g_part")))

    def products(self, links: DataFrame, fn: Callable, schema: str) -> DataFrame:
        key = ["q_ball", "q_part", "g_ball", "g_part"]
        left = (links.distinct().join(self.queries, ["id", "q_ball", "q_part"]).join(F.broadcast(self.parts), "g_ball")
                .withColumn("g_part", F.explode(F.sequence(F.lit(0), F.col("g_parts") - 1))).select("id", "v", "label", *key))
        right = self.gallery.join(self.block_pairs(links), ["g_ball", "g_part"]).select("id", "v", "label", *key).toDF("id", "v", "label", *key)  # fresh attributes
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(fn, schema)


def knn_vote(top: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Label with the largest sum of exp(sim/T) over the neighbours; ties go to the lowest label."""
    votes = top.groupBy("q_id", "q_label", "g_label").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("w"))
    return votes.groupBy("q_id", "q_label").agg(F.max_by("g_label", F.struct("w", -F.col("g_label"))).alias("pred"))


def positive_facts(q: DataFrame, g: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label",
                   exclude_self: bool = False, normalize: bool = True, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per query: relevant gallery rows and 1 + number of rows strictly more similar than the best relevant one."""
    digits = SIM_DIGITS
    n_q, n_g = q.count(), g.count()

    def sims(a, b):
        import numpy as np
        s = np.round(np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T, digits)
        same = a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]
        if not exclude_self:
            same[:] = False
        return s, same

    def best(a, b):
        import numpy as np
        import pandas as pd
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "best": [], "n": []})
        s, same = sims(a, b)
        pos = (a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]) & ~same
        n = pos.sum(axis=1)
        top = np.where(pos, s, -np.inf).max(axis=1)
        return pd.DataFrame({"id": a["id"], "best": np.where(n > 0, top, -9.0), "n": n})

    def ahead(a, b):
        import pandas as pd
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": []})
        s, same = sims(a, b)
        return pd.DataFrame({"id": a["id"], "n": ((s > a["best"].to_numpy()[:, None]) & ~same).sum(axis=1)})

    qs, gs = _side(q, key, vec, label, normalize), _side(g, key, vec, label, normalize)
    size = dict(rows_per_block=rows_per_block, n_q=n_q, n_g=n_g)
    top = cut_lineage(block_pairs(qs, gs, "id", best, "id bigint, best double, n bigint", **size)
                      .groupBy("id").agg(F.max("best").alias("best"), F.sum("n").alias("relevant")))
    known = qs.join(top.filter("relevant > 0").select("id", "best"), "id")
    rank = (block_pairs(known, gs, "id", ahead, "id bigint, n bigint", **size)
            .groupBy("id").agg((F.sum("n") + 1).alias("first_rank")))
    return top.join(rank, "id", "left").select(F.col("id").alias("q_id"), "relevant", "first_rank")


def retrieval_details(top: DataFrame, facts: DataFrame, capacity: int, k_values: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Hit, precision, recall and average precision at each k for every query."""
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = top.withColumn("rel", (F.col("q_label") == F.col("g_label")).cast("int")).withColumn("cum", F.sum("rel").over(w))
    aggs = []
    for k in k_values:
        e = min(k, capacity)
        inside = (F.col("rank") <= e) & (F.col("rel") == 1)
        aggs += [F.count_if(inside).alias(f"_h{k}"),
                 F.sum(F.when(inside, F.col("cum") / F.col("rank")).otherwise(0.0)).alias(f"_a{k}")]
    per = ranked.groupBy("q_id", "q_label").agg(*aggs).join(facts, "q_id")
    cols = []
    for k in k_values:
        e, h, rel = min(k, capacity), F.col(f"_h{k}"), F.col("relevant")
        cols += [(h > 0).cast("double").alias(f"hit_at_{k}"), (h / e).alias(f"precision_at_{k}"),
                 F.try_divide(h.cast("double"), rel.cast("double")).alias(f"recall_at_{k}"),
                 F.try_divide(F.col(f"_a{k}"), F.least(rel, F.lit(e)).cast("double")).alias(f"ap_at_{k}")]
    return per.select("q_id", "q_label", "relevant", "first_rank", *cols)


def top_lists(top: DataFrame) -> DataFrame:
    """Ranked ids, labels and similarities of each query as arrays (k entries each)."""
    packed = top.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "g_id", "g_label", "sim"))).alias("_l"))
    return packed.select("q_id", F.col("_l.g_id").alias("top_ids"), F.col("_l.g_label").alias("top_labels"),
                         F.col("_l.sim").alias("top_similarities"))


def retrieval_summary(details: DataFrame, k_values: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    names = {"hit_rate_at": "hit_at", "precision_at": "precision_at", "recall_at": "recall_at", "map_at": "ap_at"}
    return details.agg(F.count("*").alias("queries"), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
                       *[F.avg(f"{src}_{k}").alias(f"{out}_{k}") for k in k_values for out, src in names.items()])
