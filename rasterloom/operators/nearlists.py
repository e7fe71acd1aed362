"""The k most similar rows of every row of one table.

Rows are packed as bytes and dealt to blocks; a task multiplies two blocks and keeps the best columns of both sides, so each
pair is multiplied once. Every block meets itself first: the k-th similarity found there is a floor below which nothing has to
be looked at in the other products. Products are in single precision and only tell which pairs can count; those are computed
again in double precision, so lists are the exact ones.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, dealt
from .neighbors import ROWS_PER_BLOCK, SHIP_BYTES, SIM_DIGITS, _side

PIECE = 1024              # rows of each side in one product
FIRST = 8 * PIECE         # rows of a block that give all its rows a first floor
WAITING = 1 << 20         # candidates of a task that wait for their exact similarity
PRODUCTS_PER_CORE = 8     # pairs of blocks


def slack_of(dim: int) -> float:
    """More than two errors of a product of unit vectors in single precision, and the rounding of similarities."""
    return (dim + 8) * 2.0 ** -23


def exact(va, vb, r, c):
    """Rounded similarities of the pairs (va[r[i]], vb[c[i]])."""
    import numpy as np
    out = np.empty(len(r))
    for i in range(0, len(r), 65536):
        out[i:i + 65536] = np.einsum("ij,ij->i", va[r[i:i + 65536]], vb[c[i:i + 65536]])
    return np.round(out, SIM_DIGITS)


def best_first(r, c, sim, k: int):
    """The first k entries of each row by similarity, of equal ones by ``c``."""
    import numpy as np
    order = np.lexsort((c, -sim, r))
    r, c, sim = r[order], c[order], sim[order]
    start = np.flatnonzero(np.diff(r, prepend=-1))
    kept = np.arange(len(r)) - np.repeat(start, np.diff(start, append=len(r))) < k
    return r[kept], c[kept], sim[kept]


class Best:
    """Best columns of each row. Columns are numbered in the order of their ids and come in this order."""

    def __init__(self, rows, columns, k: int, floor=None):
        import numpy as np
        self.rows, self.columns, self.k, self.slack = rows, columns, k, slack_of(rows.shape[1])
        self.floor = np.full(len(rows), -np.inf) if floor is None else floor
        self.least = (self.floor - self.slack).astype(np.float32)
        self.done = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.waiting, self.n_waiting = [], 0

    def start(self, at: int, sim) -> None:
        """A first floor for rows from ``at`` on, from their products with some columns."""
        import numpy as np
        cut = sim.shape[1] - self.k
        if cut >= 0:
            self.least[at:at + len(sim)] = np.partition(sim, cut, axis=1)[:, cut] - np.float32(self.slack)

    def add(self, r, c, sim) -> None:
        use = sim >= self.least[r]
        self.waiting.append((r[use], c[use], sim[use]))
        self.n_waiting += len(self.waiting[-1][0])
        if self.n_waiting > WAITING:
            self.settle()

    def settle(self):
        import numpy as np
        if self.n_waiting:
            r, c, sim = (np.concatenate(x) for x in zip(*self.waiting))
            order = np.lexsort((-sim, r))
            r, c, sim = r[order], c[order], sim[order]
            start = np.flatnonzero(np.diff(r, prepend=-1))
            size = np.diff(start, append=len(r))
            kth = np.where(size >= self.k, sim[np.minimum(start + self.k - 1, len(r) - 1)], np.float32(-np.inf))
            use = sim >= np.repeat(kth, size) - np.float32(self.slack)
            r, c = r[use], c[use]
            sim = exact(self.rows, self.columns, r, c)
            use = sim >= self.floor[r]
            self.done = best_first(*(np.concatenate(x) for x in zip(self.done, (r[use], c[use], sim[use]))), self.k)
            r, _, sim = self.done
            last = np.flatnonzero(np.bincount(r, minlength=len(self.rows)) == self.k)
            kth = sim[np.searchsorted(r, last, "right") - 1]
            # a row with k copies of itself is done: later columns lose every tie
            self.least[last] = np.maximum(self.least[last], np.where(kth >= 1.0, np.inf, kth - self.slack))
            self.waiting, self.n_waiting = [], 0
        return self.done


def product(va, vb, k: int, floor_a=None, floor_b=None):
    """Best columns of each row of ``va`` and of each row of ``vb``; ``vb`` None: of the rows of ``va`` among themselves."""
    import numpy as np
    same = vb is None
    vb = va if same else vb
    a32, b32 = va.astype(np.float32), vb.astype(np.float32)
    left = Best(va, vb, k, floor_a)
    right = left if same else Best(vb, va, k, floor_b)
    for i in range(0, len(va) if same else 0, PIECE):
        left.start(i, a32[i:i + PIECE] @ a32[:FIRST].T)
    for i in range(0, len(va), PIECE):
        for j in range(i if same else 0, len(vb), PIECE):
            once = same and i == j
            sim = a32[i:i + PIECE] @ b32[j:j + PIECE].T
            least = min(left.least[i:i + PIECE].min(), right.least[j:j + PIECE].min())
            flat = np.flatnonzero(sim.ravel() >= least)
            if len(flat):
                (r, c), near = np.divmod(flat, sim.shape[1]), sim.ravel()[flat]
                left.add(r + i, c + j, near)
                if not once:
                    right.add(c + j, r + i, near)
    return left.settle(), right.settle()


def _unpacked(frame):
    """(ids, vectors, pack, floor) of a block of packs, in the order of ids."""
    import numpy as np
    ids = [np.frombuffer(x, np.int64) for x in frame["ids"]]
    v = np.concatenate([np.frombuffer(x, float).reshape(-1, d) for x, d in zip(frame["v"], frame["dim"])])
    pack = np.repeat(frame["pack"].to_numpy(), [len(x) for x in ids])
    floor = np.concatenate([np.frombuffer(x, float) for x in frame["floor"]]) if "floor" in frame else np.full(len(v), -np.inf)
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order], pack[order], floor[order]


def _repacked(pack, ids, found):
    """(pack, n, near, sims) of each pack: number of entries of its rows, and these one row after the other."""
    import numpy as np
    import pandas as pd
    r, c, sim = found
    n, of = np.bincount(r, minlength=len(pack)).astype(np.int32), pack[r]
    return pd.DataFrame([(p, n[pack == p].tobytes(), ids[c[of == p]].tobytes(), sim[of == p].tobytes()) for p in np.unique(pack)], columns=["pack", "n", "near", "sims"])


def neighbour_lists(df: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, near, sims): ids and similarities of the k most similar rows, the row itself counted, ties by id. Rows without a finite direction are left out."""
    n, width = df.agg(F.count("*"), F.max(F.size(vec))).first()
    n_packs = max(1, math.ceil(n / rows_per_block))
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = min(n_packs, max(math.ceil(math.sqrt(2 * PRODUCTS_PER_CORE * cores)), math.ceil(n * (width or 1) * 8 / SHIP_BYTES)))

    def packed(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        group = group.filter(pc.is_valid(group["v"])).sort_by("id")
        lists, ids = group["v"].combine_chunks(), group["id"].to_numpy()
        v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
        fit = np.isfinite(v).all(axis=1)
        rows = [(group["pack"][0].as_py(), v.shape[1], ids[fit].tobytes(), v[fit].tobytes())] if fit.any() else []
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("pack", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())))})

    def among(frame):
        import numpy as np
        ids, v, pack, _ = _unpacked(frame)
        r, c, sim = found = product(v, None, k)[0]
        full = np.flatnonzero(np.bincount(r, minlength=len(v)) == k)
        floor = np.full(len(v), -np.inf)
        floor[full] = sim[np.searchsorted(r, full, "right") - 1]
        out = frame[["pack", "block", "dim", "ids", "v"]].merge(_repacked(pack, ids, found), on="pack")
        return out.assign(floor=[floor[pack == p].tobytes() for p in out["pack"]])

    def between(a, b):
        import pandas as pd
        if not len(a) or not len(b):
            return pd.DataFrame({"pack": [], "n": [], "near": [], "sims": []})
        (ia, va, pa, fa), (ib, vb, pb, fb) = _unpacked(a), _unpacked(b)
        left, right = product(va, vb, k, fa, fb)
        return pd.concat([_repacked(pa, ib, left), _repacked(pb, ia, right)])

    def joined(parts):
        import numpy as np
        import pyarrow as pa
        read = lambda c, t: [np.frombuffer(x, t) for x in parts[c].drop_null().to_pylist()]
        ids = read("ids", np.int64)[0]
        r = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in read("n", np.int32)])
        r, near, sims = best_first(r, np.concatenate(read("near", np.int64)), np.concatenate(read("sims", float)), k)
        ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(ids)))]).astype(np.int32)
        return pa.table({"id": ids, "near": pa.ListArray.from_arrays(ends, near), "sims": pa.ListArray.from_arrays(ends, sims)})

    rows = _side(df, key, vec, None, True).select("id", "v")
    packs = rows.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(n_packs)).cast("int")).groupBy("pack").applyInArrow(packed, "pack int, dim int, ids binary, v binary")
    packs = dealt(packs.withColumn("block", F.col("pack") % blocks), "block", wanted=8 * blocks)
    known = cut_lineage(packs.groupBy("block").applyInPandas(among, "pack int, block int, dim int, ids binary, v binary, n binary, near binary, sims binary, floor binary"))
    lists = known.select("pack", "ids", "n", "near", "sims")
    if blocks > 1:
        shipped = known.select("pack", "block", "dim", "ids", "v", "floor")
        left = shipped.filter(F.col("block") < blocks - 1).withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence(F.col("block") + 1, F.lit(blocks - 1))))
        right = shipped.toDF(*shipped.columns).filter("block > 0").withColumn("b", F.col("block")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
        left, right = (dealt(d, "a", "b", wanted=2 * blocks * (blocks - 1)) for d in (left, right))
        more = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(between, "pack int, n binary, near binary, sims binary")
        lists = lists.unionByName(more.withColumn("ids", F.lit(None).cast("binary")))
    return lists.groupBy("pack").applyInArrow(joined, "id bigint, near array<bigint>, sims array<double>")
