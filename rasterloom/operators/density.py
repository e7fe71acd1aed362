"""DBSCAN at many settings from one pass over neighbours.

With the similarity to the m-th nearest row as a row's core similarity, two rows are joined at a threshold exactly if their mutual
reachability, the least of their similarity and both core similarities, reaches it. Only the lists of nearest rows
(``nearlists``) need all pairs:

* A row that is no core row at a threshold has all rows that near in its list, so border rows are read from the lists.
* A pair that is in neither list lies between two rows whose lists are full at the threshold (open rows). The lists alone join most
  rows, so only open rows outside the largest component of a setting meet the open rows again.

A maximum spanning forest holds the clusters of every threshold, and a union of forests of parts contains a forest of the whole, so tasks
return forests.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import l2_normalize
from ..session import cut_lineage, dealt
from .clustering import ari, contingency, estimate_knee, folded_silhouettes, hungarian_accuracy, nmi, purity, silhouette
from .embeddings import FOLD_ROWS, vector_mean
from .graph import connected_components
from .nearlists import exact, neighbour_lists, slack_of
from .neighbors import ROWS_PER_BLOCK, SHIP_BYTES, _side, block_pairs
from .ordering import rank_rows, with_one

SLACK = 1e-12
NONE = (1 << 63) - 1      # no component
FOREST_EDGES = 1 << 21    # edges of a task that merges forests
SLAB = 256                # rows of one side whose components are compared before they are multiplied


def core_similarities(df: DataFrame, ms: Sequence[int], key: str = "vec_id", vec: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, cores, distances, near, sims): for each of ``ms`` the similarity to the m-th nearest row, the row itself counted (null with fewer
    rows), and the distance to that row or the last one there is; the ``max(ms)`` nearest rows with their similarities."""
    reach = [F.get("sims", F.lit(m - 1)) for m in ms]
    distances = [1 - F.coalesce(r, F.element_at("sims", -1)) for r in reach]
    lists = neighbour_lists(df, max(ms), key, vec, rows_per_block)
    return cut_lineage(lists.select("id", F.array(*reach).alias("cores"), F.array(*distances).alias("distances"), "near", "sims"))


def block_forest(weight, a_node, b_node):
    """Edge numbers of a maximum spanning forest of the graph with edges (a_node[i], b_node[i]) of these weights, nodes numbered from 0.
    Rounds of Borůvka: every component takes its best edge, of equal ones the first."""
    import numpy as np
    order = np.argsort(-weight, kind="stable")
    n, out = int(max(a_node.max(initial=-1), b_node.max(initial=-1))) + 1, []
    label_a, label_b = a_node[order], b_node[order]
    while True:
        open_ = np.flatnonzero(label_a != label_b)
        if not len(open_):
            return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)
        order, label_a, label_b = order[open_], label_a[open_], label_b[open_]
        best = np.full(n, len(order))
        for label in (label_a, label_b):                        # written from the last to the first, so the best one stays
            own = np.full(n, len(order))
            own[label[::-1]] = np.arange(len(order))[::-1]
            best = np.minimum(best, own)
        first = np.unique(best[best < len(order)])
        out.append(order[first])
        root = np.arange(n)
        while True:                                             # join the components at both ends
            low = np.minimum(root[label_a[first]], root[label_b[first]])
            new = root.copy()
            np.minimum.at(new, label_a[first], low)
            np.minimum.at(new, label_b[first], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        label_a, label_b = root[label_a], root[label_b]


def spanning(edges):
    """Maximum spanning forest of the edges (m, src, dst, sim) of each m."""
    import numpy as np
    import pandas as pd
    parts = [edges.iloc[:0]]
    for _, own in edges.groupby("m"):
        node = np.unique(np.concatenate([own["src"], own["dst"]]), return_inverse=True)[1]
        parts.append(own.iloc[block_forest(own["sim"].to_numpy(), node[:len(own)], node[len(own):])])
    return pd.concat(parts)


EDGES = "m int, src bigint, dst bigint, sim double"


def list_forests(cores: DataFrame, floors: Sequence[float]) -> DataFrame:
    """(m, src, dst, sim): forests of the pairs in the lists, of those whose mutual reachability is ``floors[m]`` or more."""
    ms = range(len(floors))
    reached = lambda w, m: F.when(w >= floors[m] - SLACK, w)
    pairs = cores.select(F.col("id").alias("src"), "cores", F.explode(F.arrays_zip("near", "sims")).alias("p"))
    own = [reached(F.when(F.get("cores", F.lit(m)).isNotNull(), F.least("p.sims", F.get("cores", F.lit(m)))), m).alias(f"w{m}") for m in ms]
    pairs = pairs.select("src", F.col("p.near").alias("dst"), *own).filter(F.coalesce(*[F.col(f"w{m}") for m in ms]).isNotNull() & (F.col("src") != F.col("dst")))
    other = cores.select(F.col("id").alias("dst"), *[F.get("cores", F.lit(m)).alias(f"d{m}") for m in ms])
    both = [reached(F.when(F.col(f"w{m}").isNotNull() & F.col(f"d{m}").isNotNull(), F.least(f"w{m}", f"d{m}")), m).alias(f"w{m}") for m in ms]

    def forests(batches):
        import pandas as pd
        kept, n = [], 0
        for rows in batches:
            for m in ms:
                fit = rows[rows[f"w{m}"].notna()]
                kept.append(pd.DataFrame({"m": m, "src": fit["src"], "dst": fit["dst"], "sim": fit[f"w{m}"]}))
                n += len(fit)
            if n > 2 * FOREST_EDGES:
                kept = [spanning(pd.concat(kept))]
                n = len(kept[0])
        if n:
            yield spanning(pd.concat(kept))

    return cut_lineage(dealt(pairs, "dst").join(other, "dst").select("src", "dst", *both).mapInPandas(forests, EDGES))


def merged_forests(edges: DataFrame, most: int = FOREST_EDGES) -> tuple[DataFrame, bool]:
    """Forests merged in tasks of about ``most`` edges, and whether those of each m fit one task."""
    facts = edges.groupBy("m").count()
    while True:
        n = facts.agg(F.max("count")).first()[0] or 0
        parts = math.ceil(n / most)
        if parts < 2:
            return edges, True
        edges = cut_lineage(edges.withColumn("_p", F.pmod(F.xxhash64("src"), F.lit(parts))).groupBy("m", "_p").applyInPandas(lambda own: spanning(own.drop(columns="_p")), EDGES))
        facts = edges.groupBy("m").count()
        if (facts.agg(F.max("count")).first()[0] or 0) > 0.75 * n:
            return edges, False                                 # more rows than a task should hold


def components_at(edges: DataFrame, limits: Sequence[tuple[int, float]], most: int = FOREST_EDGES) -> DataFrame:
    """(setting, id, component) of every node that an edge reaches at the setting's (m, threshold); the smallest id of its component."""
    edges, small = merged_forests(edges, most)
    if not small:
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(m).alias("of"), F.lit(t).alias("limit")) for s, (m, t) in enumerate(limits)]))
        named = lambda c: F.concat_ws(":", F.col("s.setting").cast("string"), F.col(c).cast("string"))
        links = edges.select("*", each.alias("s")).filter((F.col("m") == F.col("s.of")) & (F.col("sim") >= F.col("s.limit") - SLACK))
        found = connected_components(links.select(named("src").alias("src"), named("dst").alias("dst")))
        part = F.split("node", ":")
        found = found.select(part[0].cast("int").alias("setting"), part[1].cast("bigint").alias("id"), F.col("component").alias("root"))
        return found.join(found.groupBy("root").agg(F.min("id").alias("component")), "root").select("setting", "id", "component")

    def at(own):
        import numpy as np
        import pandas as pd
        m, w = own["m"].iloc[0], own["sim"].to_numpy()
        ids, node = np.unique(np.concatenate([own["src"], own["dst"]]), return_inverse=True)
        a, b, root = node[:len(own)], node[len(own):], np.arange(len(ids))
        parts = []
        for s, (_, t) in sorted(((s, x) for s, x in enumerate(limits) if x[0] == m), key=lambda s: -s[1][1]):
            use = w >= t - SLACK                                # thresholds descend, so components only grow
            root = joined(root, a[use], b[use])
            held = np.unique(np.concatenate([a[use], b[use]]))
            parts.append(pd.DataFrame({"setting": s, "id": ids[held], "component": ids[root[held]]}))
        return pd.concat(parts)

    return edges.groupBy("m").applyInPandas(at, "setting int, id bigint, component bigint")


def joined(root, a, b):
    """Smallest node of every node's component once the edges (a[i], b[i]) are added to components with these smallest nodes."""
    import numpy as np
    while True:
        ra, rb = root[a], root[b]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        root = root.copy()
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            new = root[root]
            if np.array_equal(new, root):
                break
            root = new


def open_forests(q: DataFrame, g: DataFrame, limits: Sequence[tuple[int, float]], largest: dict[int, int], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(m, src, dst, sim): forests of the pairs of two components of a setting that are near enough. Rows are (id, v, cores, open): ``open`` is the
    component at each setting, ``NONE`` where the row is not open; ``q`` are rows outside the ``largest`` component of a setting."""
    asked = sorted(largest)

    def links(a, b):
        import numpy as np
        import pandas as pd
        if not len(a) or not len(b):
            return pd.DataFrame({"m": [], "src": [], "dst": [], "sim": []})
        sides = []
        for rows in (a, b):
            comps = np.stack(rows["open"].to_numpy()).astype(np.int64)[:, asked]
            order = np.lexsort(comps.T)
            v = np.stack(rows["v"].to_numpy())[order]
            sides.append((rows["id"].to_numpy(np.int64)[order], v, v.astype(np.float32), np.array(rows["cores"].tolist(), float)[order], comps[order]))
        (ia, va, a32, ca, oa), (ib, vb, b32, cb, ob) = sides
        limit = np.array([limits[s][1] for s in asked])
        active = (oa != NONE) & (oa != np.array([largest[s] for s in asked]))
        least = np.where(active, limit, np.inf).min(axis=1)
        kept, n = [pd.DataFrame({"m": [], "src": [], "dst": [], "sim": []})], 0
        for i in range(0, len(va), SLAB):
            floor = (least[i:i + SLAB] - slack_of(va.shape[1])).astype(np.float32)
            for j in range(0, len(vb), SLAB):
                x, y = oa[i:i + SLAB], ob[j:j + SLAB]
                if (x == x[:1]).all() and (y == x[:1]).all():    # one component on both sides
                    continue
                r, c = np.nonzero(a32[i:i + SLAB] @ b32[j:j + SLAB].T >= floor[:, None])
                apart = ((x[r] != y[c]) & (x[r] != NONE) & (y[c] != NONE)).any(axis=1)
                r, c = r[apart] + i, c[apart] + j
                if not len(r):
                    continue
                sim = exact(va, vb, r, c)
                for m in {limits[s][0] for s in asked}:
                    w = np.minimum(sim, np.minimum(ca[r, m], cb[c, m]))
                    hit = np.zeros(len(r), bool)
                    for e, s in enumerate(asked):
                        if limits[s][0] == m:
                            hit |= (w >= limits[s][1] - SLACK) & (oa[r, e] != ob[c, e]) & (oa[r, e] != NONE) & (ob[c, e] != NONE)
                    kept.append(pd.DataFrame({"m": m, "src": ia[r[hit]], "dst": ib[c[hit]], "sim": w[hit]}))
                    n += int(hit.sum())
                if n > FOREST_EDGES:
                    kept = [spanning(pd.concat(kept))]
                    n = len(kept[0])
        return spanning(pd.concat(kept))

    return cut_lineage(block_pairs(q, g, "id", links, EDGES, rows_per_block, merge=spanning))


def components_by_setting(df: DataFrame, settings: Sequence[tuple[int, float]], cores: DataFrame, ms: Sequence[int], key: str = "vec_id", vec: str = "embedding",
                          rows_per_block: int = ROWS_PER_BLOCK, most: int = FOREST_EDGES) -> DataFrame:
    """(id, comps): an entry for every setting, as ``dbscan_settings`` has it. ``cores`` are the ``core_similarities`` of ``ms``."""
    limits, k = [(ms.index(m), 1.0 - eps) for m, eps in settings], max(ms)
    is_core = [F.coalesce(F.get("cores", F.lit(m)) >= t - SLACK, F.lit(False)) for m, t in limits]
    is_open = [c & (F.size("near") >= k) & (F.element_at("sims", -1) >= t - SLACK) for c, (_, t) in zip(is_core, limits)]
    edges = list_forests(cores, [min([t for i, t in limits if i == m], default=2.0) for m in range(len(ms))])

    def placed(edges: DataFrame) -> DataFrame:
        found = components_at(edges, limits, most).groupBy("id").agg(*[F.max(F.when(F.col("setting") == s, F.col("component"))).alias(f"l{s}") for s in range(len(limits))])
        comps = [F.when(c, F.coalesce(f"l{s}", "id")) for s, c in enumerate(is_core)]
        opens = [F.when(o, c) for o, c in zip(is_open, comps)]
        return cut_lineage(cores.join(found, "id", "left").select("id", F.array(*comps).alias("comps"), F.array(*[F.coalesce(o, F.lit(NONE)) for o in opens]).alias("open")))

    core = placed(edges)
    sizes = core.select(F.posexplode("open").alias("setting", "c")).filter(F.col("c") != NONE).groupBy("setting", "c").count()
    sizes = sizes.groupBy("setting").agg(F.sum("count").alias("n"), F.max(F.struct("count", "c")).alias("big")).collect()       # one row a setting
    largest = {r["setting"]: r["big"]["c"] for r in sizes if r["n"] > r["big"]["count"]}
    if largest:
        def some(test) -> Column:
            at = [test(F.get("open", F.lit(s)), c) for s, c in largest.items()]
            return F.array_contains(F.array(*at), F.lit(True))
        rows = core.filter(some(lambda o, _: o != NONE)).join(_side(df, key, vec, None, True).select("id", "v"), "id").join(cores.select("id", "cores"), "id")
        rows = cut_lineage(rows.select("id", "v", "cores", "open"))
        outside = rows.filter(some(lambda o, c: (o != NONE) & (o != c)))
        more = open_forests(outside, rows, limits, largest, rows_per_block)
        if more.limit(1).count():
            core = placed(edges.unionByName(more))
    # border rows: all rows that near are in the list
    near = cores.filter(~F.array_contains(F.array(*is_core), F.lit(True)) | F.array_contains(F.array(*is_core), F.lit(False)))
    near = near.select("id", F.array(*is_core).alias("is"), F.explode(F.arrays_zip("near", "sims")).alias("p"))
    wanted = [~F.get("is", F.lit(s)) & (F.col("p.sims") >= t - SLACK) for s, (_, t) in enumerate(limits)]
    near = near.filter(F.array_contains(F.array(*wanted), F.lit(True))).select("id", F.col("p.near").alias("other"), *[w.alias(f"w{s}") for s, w in enumerate(wanted)])
    border = near.join(core.select(F.col("id").alias("other"), "comps"), "other").groupBy("id").agg(
        *[F.min(F.when(F.col(f"w{s}"), F.get("comps", F.lit(s)))).alias(f"b{s}") for s in range(len(limits))])
    return core.join(border, "id", "left").select("id", F.array(*[F.coalesce(F.get("comps", F.lit(s)), F.col(f"b{s}")) for s in range(len(limits))]).alias("comps"))


def dbscan_settings(df: DataFrame, settings: Sequence[tuple[int, float]], key: str = "vec_id", vec: str = "embedding", cores: DataFrame | None = None,
                    ms: Sequence[int] | None = None, rows_per_block: int = ROWS_PER_BLOCK, most: int = FOREST_EDGES) -> DataFrame:
    """(setting, key, component) for every row and setting (min_samples, eps), numbered from 0: smallest core key of the cluster, NULL for noise;
    border rows join the lowest cluster. ``cores`` are the ``core_similarities`` of ``ms``, if they are there already."""
    ms = list(ms or sorted({m for m, _ in settings}))
    cores = core_similarities(df, ms, key, vec, rows_per_block) if cores is None else cores
    found = components_by_setting(df, settings, cores, ms, key, vec, rows_per_block, most)
    return found.select(F.posexplode("comps").alias("setting", "component"), F.col("id").alias(key)).select("setting", key, "component")


def silhouettes(df: DataFrame, by: str, cluster: str, vec: str) -> DataFrame:
    """(by, silhouette): cosine silhouette of each clustering, as ``clustering.silhouette`` has it for one."""
    unit = df.select(by, F.col(cluster).alias("c"), l2_normalize(F.col(vec)).alias("v"))
    sums = cut_lineage(vector_mean(unit, [by, "c"], "v", "m").join(unit.groupBy(by, "c").agg(F.count("*").alias("n")), [by, "c"]))
    sizes = sums.groupBy(by).agg(F.count("*").alias("_k"), F.max("n").alias("_big"))
    if (sizes.agg(F.max("_k")).first()[0] or 0) > FOLD_ROWS:
        keys = [r[0] for r in sizes.select(by).collect()]       # one for each clustering
        parts = [silhouette(df.filter(F.col(by) == k), cluster, vec).select(F.lit(k).alias(by), "silhouette") for k in keys]
        return _union(parts)
    return folded_silhouettes(unit, sums, [by]).join(sizes, by).select(by, F.when((F.col("_k") > 1) & (F.col("_big") > 1), F.col("s")).alias("silhouette"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def silhouettes_by_setting(df: DataFrame, clusters: str, vec: str, most: int = SHIP_BYTES) -> DataFrame:
    """(setting, all, covered): cosine silhouettes of the clusterings in the array ``clusters``, with and without the rows of cluster -1.

    A row is read once for as many clusterings as have means of ``most`` bytes together, which go through the driver, and multiplied with all of
    these; a clustering with more is compared in blocks.
    """
    rows = df.select(l2_normalize(F.col(vec)).alias("v"), F.col(clusters).alias("c"))

    def partial(batches):
        import numpy as np
        import pandas as pd
        for own in batches:
            if not len(own):
                continue
            v, c = np.stack(own["v"].to_numpy()).astype(float), np.stack(own["c"].to_numpy())
            for s in range(c.shape[1]):
                order = np.argsort(c[:, s], kind="stable")
                start = np.flatnonzero(np.diff(c[order, s], prepend=-2))
                yield pd.DataFrame({"setting": s, "c": c[order[start], s], "n": np.diff(start, append=len(order)), "m": list(np.add.reduceat(v[order], start))})

    sums = cut_lineage(rows.mapInPandas(partial, "setting int, c int, n bigint, m array<double>"))
    sizes = sums.groupBy("setting", "c").agg(F.sum("n").alias("n"))
    long = sums.select("setting", "c", F.posexplode("m").alias("_d", "_v")).groupBy("setting", "c", "_d").agg(F.sum("_v").alias("_v"))
    packed = long.groupBy("setting", "c").agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_p")).join(sizes, ["setting", "c"])
    means = cut_lineage(packed.select("setting", "c", "n", F.transform("_p", lambda p: p["_v"] / F.col("n")).alias("m")))
    facts = [means.filter(test).groupBy("setting").agg(F.count("*").alias("k"), F.max("n").alias("big")).select("setting", ((F.col("k") > 1) & (F.col("big") > 1)).alias(name))
             for test, name in (("c IS NOT NULL", "_all"), ("c >= 0", "_covered"))]
    facts = facts[0].join(facts[1], "setting", "left")
    slices, room, out = [], 0, []
    for s, size in sorted(((r[0], r[1] * 8) for r in means.groupBy("setting").agg(F.sum(F.size("m"))).collect()), key=lambda x: x[1]):     # one row a setting
        if size > most:
            one = df.select(vec, F.get(clusters, F.lit(s)).alias("cluster"))
            both = [silhouette(d, "cluster", vec).select(F.col("silhouette").alias(name)) for d, name in ((one, "all"), (one.filter("cluster >= 0"), "covered"))]
            out.append(with_one(df.sparkSession.range(1).select(F.lit(s).alias("setting")), *both))
        elif size > room:
            slices.append([s])
            room = most - size
        else:
            slices[-1].append(s)
            room -= size
    for own in slices:
        table = df.sparkSession.sparkContext.broadcast(means.filter(F.col("setting").isin(own)).toPandas().sort_values(["setting", "c"]))
        found = rows.mapInPandas(_silhouette_sums(table), "setting int, s double, n bigint, t double, k bigint").groupBy("setting").agg(
            F.try_divide(F.sum("s"), F.sum("n")).alias("_s"), F.try_divide(F.sum("t"), F.sum("k")).alias("_t"))
        out.append(found.join(facts, "setting").select("setting", F.when(F.col("_all"), F.col("_s")).alias("all"), F.when(F.col("_covered"), F.col("_t")).alias("covered")))
    return _union(out) if out else df.sparkSession.createDataFrame([], "setting int, all double, covered double")


def _silhouette_sums(table):
    """Sums and numbers of silhouette values of the batches of a task, from the broadcast means (setting, c, m, n), for all and for covered rows."""
    def values(batches):
        import numpy as np
        import pandas as pd
        with np.errstate(all="ignore"):
            tables = {s: (g["c"].to_numpy(), np.stack(g["m"].to_numpy()), g["n"].to_numpy(float)) for s, g in table.value.groupby("setting")}
            for own in batches:
                if not len(own):
                    continue
                v, c = np.stack(own["v"].to_numpy()).astype(float), np.stack(own["c"].to_numpy())
                for s, (names, centre, size) in tables.items():
                    total = [0.0, 0.0]
                    step = max(1, (1 << 21) // len(names))
                    for i in range(0, len(v), step):
                        d = 1 - v[i:i + step] @ centre.T
                        me, line = np.searchsorted(names, c[i:i + step, s]), np.arange(len(d))
                        a = d[line, me] * size[me] / (size[me] - 1)
                        d[line, me] = np.inf
                        for which, first in enumerate((0, int(names[0] < 0))):      # noise is the first cluster
                            if len(names) - first > 1:
                                b = d[:, first:].min(axis=1)
                                top = np.maximum(a, b)
                                total[which] += np.where((size[me] > 1) & (top != 0) & (me >= first), (b - a) / top, 0.0).sum()
                    yield pd.DataFrame({"setting": [s], "s": [total[0]], "n": [len(v)], "t": [total[1]], "k": [int((c[:, s] >= 0).sum())]})

    return values


def cluster_scores_by(df: DataFrame, by: str, label: str, cluster: str, silhouette: DataFrame) -> DataFrame:
    """One row for each clustering: hungarian accuracy, nmi, ari, purity, silhouette (from the table of these) and cluster count."""
    table = cut_lineage(contingency(df, label, cluster, [by]))
    count = table.groupBy(by).agg(F.count_distinct("cluster").alias("n_clusters"))
    out = hungarian_accuracy(table, by=[by])
    for part in (nmi(table, [by]), ari(table, [by]), purity(table, [by]), silhouette, count):
        out = out.join(part, by)
    return out


def dbscan_report(df: DataFrame, min_samples: Sequence[int] = (5, 10, 20), multipliers: Sequence[float] = (0.9, 1.0, 1.1)) -> DataFrame:
    """One row per setting: eps, noise ratio, coverage, and scores over all and over covered rows (from three rows on)."""
    ms = sorted(set(min_samples))
    cores = core_similarities(df, ms)
    base = {m: estimate_knee(cores.select(F.col("id").alias("vec_id"), F.get("distances", F.lit(k)).alias("distance")), "vec_id").first()["eps"] for k, m in enumerate(ms)}
    wanted = [(m, x, max(base[m] * x, 2.220446049250313e-16)) for m in min_samples for x in multipliers]
    settings = sorted({(m, eps) for m, _, eps in wanted})           # with many copies distances are zero and all multipliers one setting
    comps = cut_lineage(components_by_setting(df, settings, cores, ms))
    found = comps.select(F.col("id").alias("vec_id"), F.posexplode("comps").alias("setting", "component"))
    ids = rank_rows(found.filter("component IS NOT NULL").select("setting", "component").distinct(), ["component"], ["setting"], "_r")
    named = found.join(ids, ["setting", "component"], "left").select("vec_id", "setting", F.coalesce(F.col("_r") - 1, F.lit(-1)).cast("int").alias("cluster"))
    wide = named.groupBy("vec_id").agg(F.array(*[F.max(F.when(F.col("setting") == s, F.col("cluster"))) for s in range(len(settings))]).alias("clusters"))
    wide = cut_lineage(df.select("vec_id", "label", "embedding").join(wide, "vec_id"))      # read several times
    rows = wide.select("label", F.posexplode("clusters").alias("setting", "cluster"))
    noise = (F.col("cluster") < 0).cast("double")
    facts = cut_lineage(rows.groupBy("setting").agg(F.avg(noise).alias("noise_ratio"), F.avg(1 - noise).alias("coverage"), F.count_if(F.col("cluster") >= 0).alias("_n")))
    covered = rows.filter("cluster >= 0").join(facts.filter("_n >= 3").select("setting"), "setting")
    prefixed = lambda d, p: d.select("setting", *[F.col(c).alias(p + c) for c in d.columns if c != "setting"])
    names = df.sparkSession.createDataFrame([(settings.index((m, e)), m, float(x), float(e)) for m, x, e in wanted], "setting int, min_samples int, eps_multiplier double, eps double")
    values = cut_lineage(silhouettes_by_setting(wide, "clusters", "embedding"))
    scores = [prefixed(cluster_scores_by(d, "setting", "label", "cluster", values.select("setting", F.col(p).alias("silhouette"))), p + "_") for d, p in ((rows, "all"), (covered, "covered"))]
    return names.join(facts.drop("_n"), "setting").join(scores[0], "setting").join(scores[1], "setting", "left").drop("setting")
