"""Queries over embedding neighbours, clustering and probes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C, embeddings as EM, joins as J, neighbors as N, sampling as S
from . import reports as P
from .inputs import SCORES
from .registry import query
from .scoring import CM, r6

VEC = "e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) v FROM embeddings)"
SIM = VEC + """, sim AS (SELECT a.vec_id q_id, a.label q_label, b.vec_id g_id, b.label g_label, ROUND(list_dot_product(a.v, b.v), 9) sim FROM e a, e b),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) r FROM sim WHERE q_id <> g_id)"""
VOTE = SIM + """, vt AS (SELECT q_id, q_label, g_label, SUM(exp(sim/0.07)) w FROM rk WHERE r<=20 GROUP BY ALL),
pr AS (SELECT q_id, q_label, g_label pred FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY w DESC, g_label) k FROM vt) WHERE k=1)"""


@query("j4_cosine_pairs", f"WITH {SIM} SELECT q_id, g_id, ROUND(sim,6) sim, CAST(r AS INT) AS rank FROM rk WHERE r<=10")
def _(t):
    return r6(N.nearest(t.embeddings, t.embeddings, 10, exclude_self=True).select("q_id", "g_id", "sim", "rank"))


@query("j5_topk_two_phase", f"WITH {SIM} SELECT q_id, g_id, CAST(r AS INT) AS rank FROM rk WHERE r<=20")
def _(t):
    # small blocks: many gallery shards, local top-k in each, then the global one
    return N.nearest(t.embeddings, t.embeddings, 20, exclude_self=True, rows_per_block=256).select("q_id", "g_id", "rank")


@query("w4_knn_vote", f"WITH {VOTE} SELECT q_id, q_label, pred FROM pr")
def _(t):
    return N.knn_vote(N.nearest(t.embeddings, t.embeddings, 20, exclude_self=True))


@query("w5_exclude_self", f"WITH {SIM} SELECT q_id, g_id, ROUND(sim,6) sim FROM rk WHERE r=1")
def _(t):
    return r6(N.nearest(t.embeddings, t.embeddings, 1, exclude_self=True).select("q_id", "g_id", "sim"))


KS = (1, 5, 10, 20)
RET = SIM + """, pos AS (SELECT q_id, COUNT(*) relevant, MAX(sim) best FROM rk WHERE q_label=g_label GROUP BY q_id),
fr AS (SELECT p.q_id, p.relevant, 1 + (SELECT COUNT(*) FROM rk s WHERE s.q_id=p.q_id AND s.sim>p.best) first_rank FROM pos p),
cu AS (SELECT q_id, q_label, r, CASE WHEN q_label=g_label THEN 1 ELSE 0 END rel, SUM(CASE WHEN q_label=g_label THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY r) cum FROM rk WHERE r<=20),
de AS (SELECT q_id, q_label, """ + ", ".join(
    f"SUM(CASE WHEN r<={k} THEN rel ELSE 0 END) h{k}, SUM(CASE WHEN r<={k} AND rel=1 THEN cum/r ELSE 0 END) a{k}" for k in KS) + """ FROM cu GROUP BY ALL),
dt AS (SELECT q_id, q_label, COALESCE(relevant,0) relevant, first_rank, """ + ", ".join(
    f"CAST(h{k}>0 AS DOUBLE) hit_at_{k}, h{k}/{k} precision_at_{k}, h{k}/NULLIF(relevant,0) recall_at_{k}, a{k}/NULLIF(LEAST(relevant,{k}),0) ap_at_{k}" for k in KS) + \
    " FROM de LEFT JOIN fr USING (q_id))"


@query("w3_retrieval_details", f"WITH {RET} SELECT q_id, q_label, relevant, first_rank, " + ", ".join(
    f"ROUND({m}_at_{k},6) {m}_at_{k}" for k in KS for m in ("hit", "precision", "recall", "ap")) + " FROM dt")
def _(t):
    return r6(P.retrieval_report(t.embeddings, t.embeddings, KS, same=True)[1])


@query("w3_top_lists", f"WITH {SIM} SELECT q_id, string_agg(CAST(g_id AS VARCHAR), ',' ORDER BY r) AS top_ids, string_agg(CAST(g_label AS VARCHAR), ',' ORDER BY r) AS top_labels FROM rk WHERE r<=10 GROUP BY q_id")
def _(t):
    lists = N.top_lists(N.nearest(t.embeddings, t.embeddings, 10, exclude_self=True))
    return lists.select("q_id", F.array_join("top_ids", ",").alias("top_ids"), F.array_join("top_labels", ",").alias("top_labels"))


@query("m2_retrieval_report", f"WITH {RET} SELECT COUNT(*) queries, ROUND(AVG(COALESCE(1.0/first_rank,0)),6) mrr, " + ", ".join(
    f"ROUND(AVG({s}_at_{k}),6) {o}_at_{k}" for k in KS for s, o in (("hit", "hit_rate"), ("precision", "precision"), ("recall", "recall"), ("ap", "map"))) + " FROM dt")
def _(t):
    return r6(P.retrieval_report(t.embeddings, t.embeddings, KS, same=True)[0])


@query("m2_retrieval_balanced")
def _(t):
    return r6(P.retrieval_report(t.embeddings, t.embeddings, KS, same=True, per_class=20)[0])


M1 = VOTE + ", valid AS (SELECT q_label gt, pred FROM pr)" + CM.replace("range(6)", "range(10)")


@query("m1_knn_report", f"""WITH {M1} SELECT ROUND(SUM(tp)/SUM(s),6) accuracy, ROUND(AVG(CASE WHEN s>0 THEN re END),6) balanced_accuracy, ROUND(AVG(f1),6) macro_f1, ROUND(SUM(f1*s)/SUM(s),6) weighted_f1,
ROUND(AVG(pr),6) macro_precision, ROUND(AVG(re),6) macro_recall, ROUND(AVG(tp/(s+p-tp)),6) miou FROM sc""")
def _(t):
    return r6(P.knn_report(t.embeddings, t.embeddings, 10, exclude_self=True))


M7 = VEC + """, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) n FROM e), sim AS (SELECT q.vec_id q_id, q.label q_label, g.vec_id g_id, g.label g_label, ROUND(list_dot_product(q.v,g.v),9) sim FROM o q, o g WHERE q.n>10 AND g.n<=10),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) r FROM sim), vt AS (SELECT k, q_id, q_label, g_label, SUM(exp(sim/0.07)) w FROM rk, (VALUES (5),(20)) ks(k) WHERE r<=k GROUP BY ALL),
pr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, q_id ORDER BY w DESC, g_label) z FROM vt)"""


@query("m7_knn_few_shot", f"WITH {M7} SELECT k, ROUND(AVG(CASE WHEN q_label=g_label THEN 1.0 ELSE 0 END),6) accuracy, 0.0::DOUBLE AS std, 2::BIGINT AS tries FROM pr WHERE z=1 GROUP BY k")
def _(t):
    return r6(P.knn_few_shot(t.embeddings, [5, 20], 10, tries=2, seed=None))


# the weight rows are class means, tokens form 2 x 2 grids of four consecutive vectors
M8 = """w AS (SELECT label, unnest(range(64)) d, unnest(embedding) v FROM embeddings), mm AS (SELECT label, d, AVG(CAST(v AS DOUBLE)) v FROM w GROUP BY ALL), wt AS (SELECT label, list(v ORDER BY d) wv FROM mm GROUP BY label),
s AS (SELECT vec_id, wt.label, list_dot_product(CAST(embedding AS DOUBLE[]), wv) sc FROM embeddings, wt), b AS (SELECT vec_id, label pred FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY sc DESC, label) r FROM s) WHERE r=1),
px AS (SELECT *, CAST(unnest(range(5)) AS INT) x FROM (SELECT DISTINCT vec_id//4 AS sample, CAST(unnest(range(3)) AS INT) y FROM embeddings))"""


@query("m8_predict_dense", f"WITH {M8} SELECT sample, y, x, pred FROM px JOIN b ON b.vec_id = sample*4 + (y*2//3)*2 + (x*2//5)")
def _(t):
    w = EM.class_means(t.embeddings, "label", "embedding").withColumn("bias", F.lit(0.0))
    v = F.col("vec_id")
    tok = t.embeddings.select(F.floor(v / 4).alias("sample"), F.floor(v % 4 / 2).cast("int").alias("gy"), (v % 2).cast("int").alias("gx"), "embedding")
    return P.predict_dense(tok, w, "sample", 2, 2, 3, 5)


@query("a30_mean_pool", "WITH p AS (SELECT vec_id//4 sample, unnest(range(64)) d, unnest(embedding) v FROM embeddings), m AS (SELECT sample, d, AVG(CAST(v AS DOUBLE)) v FROM p GROUP BY ALL) "
       "SELECT sample, array_to_string(list(CAST(ROUND(v*100000) AS BIGINT) ORDER BY d), ',') AS vec FROM m GROUP BY sample")
def _(t):
    p = EM.mean_pool(t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("sample"), "embedding"), "sample")
    return p.select("sample", F.array_join(F.transform("embedding", lambda x: F.round(x * 100000).cast("bigint")), ",").alias("vec"))


# --- cluster scores on a table of (language, source) ---------------------------------------------------
CT = "c AS (SELECT lang, source, COUNT(*) n FROM documents GROUP BY ALL), t AS (SELECT *, SUM(n) OVER (PARTITION BY lang) a, SUM(n) OVER (PARTITION BY source) b, SUM(n) OVER () z FROM c)"


def _table(t):
    return C.contingency(t.documents, "lang", "source")


@query("a25_purity", f"WITH {CT} SELECT ROUND(SUM(m)/SUM(s),6) purity FROM (SELECT source, MAX(n) m, SUM(n) s FROM c GROUP BY source)")
def _(t):
    return r6(C.purity(_table(t)))


@query("a26_nmi", f"WITH {CT} SELECT ROUND(SUM(n/z*ln(n*z/(a*b)))/((SUM(-n/z*ln(a/z))+SUM(-n/z*ln(b/z)))/2),6) nmi FROM t")
def _(t):
    return r6(C.nmi(_table(t)))


@query("a27_ari", f"""WITH {CT}, s AS (SELECT SUM(n*(n-1)/2) s, MAX(z*(z-1)/2) tt FROM t), r AS (SELECT SUM(a*(a-1)/2) r FROM (SELECT DISTINCT lang, a FROM t)), k AS (SELECT SUM(b*(b-1)/2) k FROM (SELECT DISTINCT source, b FROM t))
SELECT ROUND((s-r*k/tt)/((r+k)/2-r*k/tt),6) ari FROM s, r, k""")
def _(t):
    return r6(C.ari(_table(t)))


@query("a28_silhouette", f"""WITH {VEC}, d AS (SELECT a.vec_id, a.label la, b.label lb, SUM(CASE WHEN a.vec_id=b.vec_id THEN 0 ELSE 1-list_dot_product(a.v,b.v) END) s, COUNT(*) n FROM e a, e b GROUP BY ALL),
x AS (SELECT vec_id, MAX(CASE WHEN la=lb THEN s/(n-1) END) a, MIN(CASE WHEN la<>lb THEN s/n END) b FROM d GROUP BY vec_id) SELECT ROUND(AVG((b-a)/GREATEST(a,b)),6) silhouette FROM x""")
def _(t):
    return r6(C.silhouette(t.embeddings, "label", "embedding"))


@query("a29_hungarian_accuracy", "SELECT ROUND(GREATEST(SUM(CASE WHEN quality=toxic THEN 1 ELSE 0 END), SUM(CASE WHEN quality<>toxic THEN 1 ELSE 0 END))/COUNT(*),6) hungarian_accuracy FROM labels")
def _(t):
    return r6(C.hungarian_accuracy(C.contingency(t.labels, "quality", "toxic")))


# four languages against all sources: every choice of four different sources
@query("a29_hungarian_accuracy_wide", """WITH l AS (SELECT lang, ROW_NUMBER() OVER (ORDER BY lang) i FROM (SELECT DISTINCT lang FROM documents)), c AS (SELECT i, source, COUNT(*) n FROM documents JOIN l USING (lang) GROUP BY ALL),
g AS (SELECT l.i, s.source, COALESCE(c.n,0) n FROM l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN c ON c.i=l.i AND c.source=s.source)
SELECT ROUND(MAX(a.n+b.n+c.n+d.n)/(SELECT COUNT(*) FROM documents),6) hungarian_accuracy FROM g a, g b, g c, g d WHERE a.i=1 AND b.i=2 AND c.i=3 AND d.i=4
AND a.source<>b.source AND a.source<>c.source AND a.source<>d.source AND b.source<>c.source AND b.source<>d.source AND c.source<>d.source""")
def _(t):
    return r6(C.hungarian_accuracy(_table(t)))


def kdist(m):
    return SIM + f""", nr AS (SELECT q_id, sim, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) r FROM sim), kd AS (SELECT q_id, 1-sim d FROM nr WHERE r={m}),
cv AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d, q_id) rn, COUNT(*) OVER () n, MIN(d) OVER () lo, MAX(d) OVER () hi FROM kd), kn AS (SELECT d, rn, n FROM cv ORDER BY ROUND((d-lo)/(hi-lo)-(rn-1)/(n-1),12) DESC, rn LIMIT 1),
ep AS (SELECT CASE WHEN rn-1 < n//2 THEN (SELECT quantile_cont(d,0.9) FROM kd) ELSE d END eps FROM kn)"""


@query("w9_estimate_eps", f"WITH {kdist(5)} SELECT ROUND(eps,6) eps FROM ep")
def _(t):
    return r6(C.estimate_eps(t.embeddings, 5))


DB = kdist(5).replace("rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) r FROM sim WHERE q_id <> g_id)", "unused AS (SELECT 1)") + """,
nb AS (SELECT q_id, g_id FROM sim, ep WHERE sim >= 1-eps*0.9-1e-12), co AS (SELECT q_id FROM nb GROUP BY q_id HAVING COUNT(*)>=5), ce AS (SELECT nb.q_id a, nb.g_id b FROM nb JOIN co ON co.q_id=nb.q_id JOIN co c2 ON c2.q_id=nb.g_id),
rc(id, root) AS (SELECT q_id, q_id FROM co UNION SELECT ce.b, rc.root FROM rc JOIN ce ON ce.a=rc.id WHERE ce.b > rc.root), lb AS (SELECT id, MIN(root) comp FROM rc GROUP BY id)"""


@query("m4_dbscan", f"""WITH RECURSIVE {DB} SELECT e.vec_id, COALESCE(lb.comp, (SELECT MIN(l2.comp) FROM nb JOIN lb l2 ON l2.id=nb.g_id WHERE nb.q_id=e.vec_id)) AS component FROM e LEFT JOIN lb ON lb.id=e.vec_id""")
def _(t):
    eps = C.estimate_eps(t.embeddings, 5).first()["eps"] * 0.9
    return C.dbscan(t.embeddings, eps, 5)


@query("m4_dbscan_report")
def _(t):
    return P.dbscan_report(t.embeddings)


@query("m3_kmeans_report")
def _(t):
    return P.kmeans_report(t.embeddings)


def _parts(t):
    """Stratified train / valid / test of all vectors."""
    a = S.stratified_split(t.embeddings, "label", "vec_id", 0.2, seed=1)
    rest = a.filter("split = 'train'").drop("split")
    b = S.stratified_split(rest, "label", "vec_id", 0.2, seed=2)
    return b.filter("split = 'train'"), b.filter("split = 'val'"), a.filter("split = 'val'")


@query("m5_linear_probe")
def _(t):
    return P.linear_probe(*_parts(t), 10, max_iter=100)


@query("m6_logreg_sweep")
def _(t):
    train, valid, _ = _parts(t)
    return P.logreg_sweep(train, valid, [0.1, 1.0, 10.0])
