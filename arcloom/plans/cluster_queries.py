"""Queries over similarity graphs and clusterings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcloom.functions import texts
from arcloom.operators import clusters as c
from arcloom.operators import graph
from arcloom.operators import resolution as res
from arcloom.plans.graph_queries import edges_of
from arcloom.plans.text_queries import java_files, name_links
from arcloom.tables import cut, table

K = 20


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null")


def _neighbours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return c.nearest(v, v.where("vec_id % 100 = 0"), K)


def knn_sparsified(spark, sf_dir):
    """The queries (ids divisible by 100) with their nearest rows, in both directions."""
    return c.symmetric_max(_neighbours(spark, sf_dir)).select("i", "j", F.round("w", 6).alias("w"))


def _fused(spark, sf_dir):
    n = c.symmetric_max(_neighbours(spark, sf_dir))
    v = _vectors(spark, sf_dir)
    same = n.join(v.select(F.col("vec_id").alias("i"), F.col("label").alias("a")), "i").join(v.select(F.col("vec_id").alias("j"), F.col("label").alias("b")), "j")
    return c.fused(n, same.where("a = b").select("i", "j", F.lit(1.0).alias("w")), 0.5)


def fused_weights(spark, sf_dir):
    return _fused(spark, sf_dir).select("i", "j", F.round("w", 6).alias("w"))


def strong_links(spark, sf_dir):
    return c.above(fused_weights(spark, sf_dir), 0.8)


def cluster_size_stats(spark, sf_dir):
    s = c.size_stats(_vectors(spark, sf_dir), [])
    return s.select("clusters", *[F.round(x, 6).alias(x) for x in ("singletons", "tiny", "size_cv")])


def cluster_densities(spark, sf_dir):
    return c.cluster_densities(_vectors(spark, sf_dir), []).select("label", "n", F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


def cluster_quality(spark, sf_dir):
    q = c.quality(c.cluster_densities(_vectors(spark, sf_dir), []), [])
    return q.select(F.round("separation", 6).alias("separation"), F.round("density_std", 6).alias("density_std"))


def labelling_agreement(spark, sf_dir):
    """Adjusted Rand index of the labels and two labellings derived from the ids."""
    v = _vectors(spark, sf_dir)
    two = v.select(F.lit("mod7").alias("other"), F.col("label").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b")).unionByName(v.select(F.lit("half").alias("other"), F.col("label").alias("a"), F.floor(F.col("label") / 2).cast("int").alias("b")))
    return c.adjusted_rand(two, ["other"]).select("other", F.round("ari", 6).alias("ari"))


def _runs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ls = [F.col("label"), (F.col("vec_id") % 7).cast("int"), F.floor(F.col("label") / 2).cast("int")]
    out = None
    for n, x in enumerate(ls):
        one = v.select(F.lit(n).alias("run"), F.col("vec_id").alias("id"), x.alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def coassociated(spark, sf_dir):
    """How often three labellings put the queries (ids divisible by 100) and other rows together."""
    r = _runs(spark, sf_dir)
    return c.coassociation(r, r.where("id % 100 = 0"), 3).select("i", "j", F.round("freq", 6).alias("freq"))


def _graded_runs(spark, sf_dir, w):
    """Three clusterings of the queries' neighbourhood for each of five resolutions: the labels split into 1..5 parts each, by a shifted remainder."""
    v = _vectors(spark, sf_dir).join(w.select(F.col("i").alias("vec_id")).distinct(), "vec_id")
    v = v.select(F.col("vec_id").alias("id"), "label", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("gamma")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seed"))
    part = F.col("label") * 10 + (F.col("id") + F.floor(F.col("id") * F.col("seed") / 3)) % F.col("gamma")
    return v.select(F.lit(1).alias("g"), "gamma", "seed", "id", part.cast("long").alias("label"))


def resolution_statistics(spark, sf_dir):
    """What the clusterings of each resolution are like on the fused weights: means over the seeds, the stability between them."""
    w = cut(fused_weights(spark, sf_dir))
    t = res.run_statistics(cut(_graded_runs(spark, sf_dir, w)), w, ["g"])
    names = ("mean_ari", "mean_sep", "mean_density_std", "mean_clusters", "median_clusters", "mean_singletons", "mean_tiny", "mean_size_cv")
    return t.select("gamma", "nodes", *[F.round(x, 6).alias(x) for x in names])


def resolution_scores(spark, sf_dir):
    """The score of each resolution, and which is the best."""
    w = cut(fused_weights(spark, sf_dir))
    t = res.scored(res.run_statistics(cut(_graded_runs(spark, sf_dir, w)), w, ["g"]), ["g"], 3, 0.15)
    return t.select("gamma", F.round("score", 6).alias("score"), "best")


def weighted_densities(spark, sf_dir):
    """Densities of the labels on the fused weights."""
    w = cut(fused_weights(spark, sf_dir))
    labels = _vectors(spark, sf_dir).join(w.select(F.col("i").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("id"), "label")
    return c.weight_densities(w, labels, []).select("label", "n", F.round("intra", 9).alias("intra"), F.round("inter", 9).alias("inter"))


def silhouettes(spark, sf_dir):
    """Mean silhouette of the labels, by distances 1 - fused weight (pairs without a weight are at distance 1)."""
    w = cut(fused_weights(spark, sf_dir))
    labels = _vectors(spark, sf_dir).join(w.select(F.col("i").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("id"), "label")
    return c.silhouette(w, labels, []).select(F.round("silhouette", 6).alias("silhouette"))


#: The parameters of the file level and of the function level.
FILES = {"a": 0.5, "k": 20, "gammas": res.grid(0.05, 0.6, 25), "least": 3, "ratio": 0.15, "tau": 0.6}
FUNCTIONS = {"a": 0.25, "k": 20, "gammas": res.grid(0.05, 0.2, 24), "least": 5, "ratio": 0.2, "tau": 0.4}
SEEDS = list(range(1, 9))


def _group_weights(vectors, links, by, p):
    """Weights of a group's nodes: a · similarity of the names + (1 − a) · links, the k largest of each node, in both directions."""
    return c.group_weights(vectors, links, by, p["a"], p["k"])


def _files_clustered(spark, sf_dir):
    j = java_files(spark, sf_dir).where("repo is not null").select("repo", F.col("file_id").alias("id"), "name")
    links = name_links(spark, sf_dir).select(F.col("a").alias("id"), F.col("b").alias("j")).join(j.select("repo", "id"), "id").select("repo", F.col("id").alias("i"), "j")
    w = _group_weights(res.encoded(j, ["repo", "id"], "name"), links, ["repo"], FILES)
    return res.best_clustering(j.select("repo", "id"), w, ["repo"], FILES["gammas"], SEEDS, least=FILES["least"], ratio=FILES["ratio"], tau=FILES["tau"], merge=True)


def file_resolutions(spark, sf_dir):
    """Every resolution of the clustering of each repository's files, with its score."""
    return _files_clustered(spark, sf_dir)[1]


def file_clusters(spark, sf_dir):
    """The consensus clusters of each repository's files: size and first file."""
    return _files_clustered(spark, sf_dir)[0].groupBy("repo", "label").agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first_file"))


def module_features(spark, sf_dir):
    """Features: the functions of every file cluster, clustered again, numbered in the order of clusters and first members."""
    files = cut(_files_clustered(spark, sf_dir)[0].select(F.col("repo").alias("r"), F.col("id").cast("int").alias("file_id"), F.col("label").alias("module")))
    fn = cut(table(spark, sf_dir, "code_function").dropDuplicates(["func_id"]).join(files, "file_id").select("r", "module", F.col("func_id").alias("id"), F.col("func_name").alias("name"), "func_code"))
    names = fn.select("r", "module", "id", "name")
    called = fn.select("r", "module", F.col("id").alias("i"), F.explode(texts.identifiers(F.coalesce("func_code", F.lit("")))).alias("name"))
    hit = called.join(names.withColumnRenamed("id", "j"), ["r", "module", "name"]).where("i <> j").select("r", "module", "i", "j")
    links = hit.unionByName(hit.select("r", "module", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    by = ["r", "module"]
    w = _group_weights(res.encoded(names, [*by, "id"], "name"), links, by, FUNCTIONS)
    labels, _ = res.best_clustering(names.select(*by, "id"), w, by, FUNCTIONS["gammas"], SEEDS, least=FUNCTIONS["least"], ratio=FUNCTIONS["ratio"], tau=FUNCTIONS["tau"])
    f = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("functions"), F.min("id").alias("first_function"))
    return f.select(F.col("r").alias("repo"), "module", "functions", "first_function", F.row_number().over(Window.partitionBy("r").orderBy("module", "first_function")).cast("long").alias("feature"))


def merged_tiny(spark, sf_dir):
    """One pass of joining tiny clusters (every 50th row by itself) to large ones."""
    v = _vectors(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 50 == 0, F.col("vec_id") + 1000).otherwise(F.col("label").cast("long")))
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cent = v.select("label", F.posexplode(c.unit(F.col("embedding"))).alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("s")).join(n, "label")
    return c.merge_tiny(cent, 3)


def _class_runs(spark, sf_dir, seeds):
    """(repo, i, j, w) of numbered classes, and their clusterings (repo, gamma, seed, id, label)."""
    e = edges_of(spark, sf_dir).where("src <> dst")
    both = e.select("repo", "src", "dst").unionByName(e.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    no = cut(graph.dense_ids(both.select("repo", F.col("src").alias("name")).distinct(), ["repo", "name"], "id"))
    w = both.join(no.withColumnsRenamed({"name": "src", "id": "i"}), ["repo", "src"]).join(no.withColumnsRenamed({"name": "dst", "id": "j"}), ["repo", "dst"])
    w = cut(w.select("repo", "i", "j", F.lit(1.0).alias("w")))
    return w, res.partitions(no.select("repo", "id"), w, ["repo"], [0.05], seeds)


def class_communities(spark, sf_dir):
    """Communities of the class graph of each repository (sizes)."""
    _, got = _class_runs(spark, sf_dir, [2025])
    return got.groupBy("repo", "label").agg(F.count(F.lit(1)).alias("classes"))


def consensus_communities(spark, sf_dir):
    """Communities that eight runs with other seeds agree on (sizes)."""
    w, runs = _class_runs(spark, sf_dir, SEEDS)
    got = res.consensus(cut(runs.drop("gamma")), w, ["repo"], 0.6)
    return got.groupBy("repo", "label").agg(F.count(F.lit(1)).alias("classes"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_sparsified, fused_weights, strong_links, cluster_size_stats, cluster_densities, cluster_quality, labelling_agreement, coassociated, resolution_scores,
        merged_tiny, class_communities, consensus_communities, resolution_statistics, weighted_densities, silhouettes, file_resolutions, file_clusters, module_features,
    )
}

_U = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u FROM e)"""
_KNN = (
    _U
    + """, s AS (SELECT q.vec_id AS i, r.vec_id AS j, (1 + list_dot_product(q.u, r.u)) / 2 AS w FROM u q, u r WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(w, 9) DESC, j) AS n FROM s) WHERE n <= 20 AND i <> j),
k AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM t UNION ALL SELECT j, i, w FROM t) GROUP BY i, j)"""
)
_FUSED = _KNN + ", f AS (SELECT k.i, k.j, round(0.5 * k.w / (SELECT max(w) FROM k) + CASE WHEN a.label = b.label THEN 0.5 ELSE 0 END, 6) AS w FROM k JOIN u a ON a.vec_id = k.i JOIN u b ON b.vec_id = k.j) "
_PAIRS = (
    _U
    + """, p AS (SELECT a.label AS label, b.label AS other, a.vec_id AS i, (1 + list_dot_product(a.u, b.u)) / 2 AS w FROM u a, u b WHERE a.vec_id <> b.vec_id),
n AS (SELECT label, count(*) AS n FROM u GROUP BY label),
den AS (SELECT n.label, any_value(n.n) AS n, avg(CASE WHEN other = n.label THEN w END) AS intra, coalesce(avg(CASE WHEN other <> n.label THEN w END), 0) AS inter FROM n JOIN p ON p.label = n.label GROUP BY n.label)"""
)
_ARI = """
cell AS (SELECT k, a, b, count(*) AS n FROM two GROUP BY ALL), sa AS (SELECT k, sum(n * (n - 1) / 2) AS sa FROM (SELECT k, a, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY k),
sb AS (SELECT k, sum(n * (n - 1) / 2) AS sb, sum(n) AS alln FROM (SELECT k, b, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY k), ss AS (SELECT k, sum(n * (n - 1) / 2) AS s FROM cell GROUP BY k),
ari AS (SELECT k, (s - sa * sb / (alln * (alln - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (alln * (alln - 1) / 2)) AS ari FROM sa JOIN sb USING (k) JOIN ss USING (k))"""
_RUNS = "WITH runs AS (SELECT 0 AS run, vec_id AS id, label FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 1, vec_id, vec_id % 7 FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 2, vec_id, label // 2 FROM embeddings WHERE embedding IS NOT NULL) "

_STATS = (
    _FUSED
    + """, nd AS (SELECT DISTINCT u.vec_id AS id, label FROM u JOIN f ON f.i = u.vec_id),
r AS (SELECT g.gamma, s.seed, id, label * 10 + (id + (id * s.seed) // 3) % g.gamma AS label FROM nd, (SELECT unnest(range(1, 6)) AS gamma) g, (SELECT unnest(range(1, 4)) AS seed) s),
sz AS (SELECT gamma, seed, label, count(*) AS n FROM r GROUP BY ALL), tn AS (SELECT count(*) AS t FROM nd),
pw AS (SELECT a.gamma, a.seed, a.label, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS own, sum(CASE WHEN a.label <> b.label THEN w ELSE 0 END) AS outs
  FROM f JOIN r a ON a.id = f.i JOIN r b ON b.id = f.j AND b.gamma = a.gamma AND b.seed = a.seed WHERE f.i <> f.j GROUP BY ALL),
dn AS (SELECT sz.gamma, sz.seed, n, CASE WHEN n > 1 THEN coalesce(own, 0) / (n * (n - 1.0)) END AS intra, CASE WHEN t > n THEN coalesce(outs, 0) / (n * (t - n)) ELSE 0 END AS inter
  FROM sz CROSS JOIN tn LEFT JOIN pw ON pw.gamma = sz.gamma AND pw.seed = sz.seed AND pw.label = sz.label),
per AS (SELECT gamma, seed, count(*) AS clusters, avg((n = 1)::INT) AS singletons, avg((n <= 2)::INT) AS tiny, stddev_pop(n) / (avg(n) + 1e-12) AS cv,
  coalesce(sum(CASE WHEN intra IS NOT NULL THEN n * (intra - inter) END) / sum(CASE WHEN intra IS NOT NULL THEN n END), 0) AS sep, stddev_pop(intra) AS dstd FROM dn GROUP BY ALL),
two AS (SELECT a.gamma * 100 + a.seed * 10 + b.seed AS k, a.label AS a, b.label AS b FROM r a JOIN r b ON b.gamma = a.gamma AND b.id = a.id AND a.seed < b.seed),"""
    + _ARI
    + """, st AS (SELECT per.gamma, (SELECT t FROM tn) AS nodes, (SELECT avg(ari) FROM ari WHERE k // 100 = per.gamma) AS mean_ari, avg(sep) AS mean_sep, avg(dstd) AS mean_density_std, avg(clusters) AS mean_clusters,
  median(clusters) AS median_clusters, avg(singletons) AS mean_singletons, avg(tiny) AS mean_tiny, avg(cv) AS mean_size_cv FROM per GROUP BY per.gamma)"""
)

ORACLE = {
    "knn_sparsified": _KNN + " SELECT i, j, round(w, 6) AS w FROM k",
    "fused_weights": _FUSED + "SELECT i, j, w FROM f",
    "strong_links": _FUSED + "SELECT i, j, w FROM f WHERE w >= 0.8",
    "cluster_size_stats": "SELECT count(*) AS clusters, round(avg((n = 1)::INT), 6) AS singletons, round(avg((n <= 2)::INT), 6) AS tiny, round(stddev_pop(n) / (avg(n) + 1e-12), 6) AS size_cv FROM (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label)",
    "cluster_densities": _PAIRS + " SELECT label, n, round(intra, 6) AS intra, round(inter, 6) AS inter FROM den",
    "cluster_quality": _PAIRS + " SELECT round(sum(n * (intra - inter)) / sum(n), 6) AS separation, round(stddev_pop(intra), 6) AS density_std FROM den WHERE intra IS NOT NULL",
    "weighted_densities": _FUSED
    + """, nd AS (SELECT DISTINCT u.vec_id AS id, label FROM u JOIN f ON f.i = u.vec_id),
p AS (SELECT a.label, b.label AS other, coalesce(f.w, 0) AS w FROM nd a JOIN nd b ON a.id <> b.id LEFT JOIN f ON f.i = a.id AND f.j = b.id)
SELECT n.label, n.n, (SELECT round(avg(w), 9) FROM p WHERE p.label = n.label AND p.other = n.label) AS intra, (SELECT round(coalesce(avg(w), 0), 9) FROM p WHERE p.label = n.label AND p.other <> n.label) AS inter
FROM (SELECT label, count(*) AS n FROM nd GROUP BY label) n""",
    "silhouettes": _FUSED
    + """, nd AS (SELECT DISTINCT u.vec_id AS id, label FROM u JOIN f ON f.i = u.vec_id),
d AS (SELECT a.id, a.label, b.label AS other, avg(1 - coalesce(f.w, 0)) AS d FROM nd a JOIN nd b ON a.id <> b.id LEFT JOIN f ON f.i = a.id AND f.j = b.id GROUP BY ALL),
sil AS (SELECT id, min(CASE WHEN other = label THEN d END) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sil""",
    "labelling_agreement": "WITH two AS (SELECT 'mod7' AS k, label AS a, vec_id % 7 AS b FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 'half', label, label // 2 FROM embeddings WHERE embedding IS NOT NULL)," + _ARI + " SELECT k AS other, round(ari, 6) AS ari FROM ari",
    "coassociated": _RUNS + "SELECT a.id AS i, b.id AS j, round(count(*) / 3.0, 6) AS freq FROM runs a JOIN runs b ON a.run = b.run AND a.label = b.label WHERE a.id % 100 = 0 GROUP BY ALL",
    "resolution_statistics": _STATS + " SELECT gamma, nodes, round(mean_ari, 6) AS mean_ari, round(mean_sep, 6) AS mean_sep, round(mean_density_std, 6) AS mean_density_std, round(mean_clusters, 6) AS mean_clusters, round(median_clusters, 6) AS median_clusters, round(mean_singletons, 6) AS mean_singletons, round(mean_tiny, 6) AS mean_tiny, round(mean_size_cv, 6) AS mean_size_cv FROM st",
    "resolution_scores": _STATS
    + """, mm AS (SELECT *, greatest(2, floor(0.15 * nodes)) AS most,
  CASE WHEN max(mean_ari) OVER () - min(mean_ari) OVER () >= 1e-12 THEN (mean_ari - min(mean_ari) OVER ()) / (max(mean_ari) OVER () - min(mean_ari) OVER ()) ELSE 0 END AS na,
  CASE WHEN max(mean_sep) OVER () - min(mean_sep) OVER () >= 1e-12 THEN (mean_sep - min(mean_sep) OVER ()) / (max(mean_sep) OVER () - min(mean_sep) OVER ()) ELSE 0 END AS ns,
  CASE WHEN max(mean_density_std) OVER () - min(mean_density_std) OVER () >= 1e-12 THEN (mean_density_std - min(mean_density_std) OVER ()) / (max(mean_density_std) OVER () - min(mean_density_std) OVER ()) ELSE 0 END AS nd FROM st),
sc AS (SELECT gamma, round(0.45 * na + 0.45 * ns - (0.40 * (0.5 * mean_singletons + 0.5 * mean_tiny) + 0.20 * least(greatest((mean_clusters - most) / greatest(1, most), 0), 1)
  + 0.10 * least(greatest((3 - mean_clusters) / 3, 0), 1) + 0.20 * least(greatest(mean_size_cv - 1, 0), 1) + 0.15 * nd), 6) AS score FROM mm)
SELECT gamma, score, row_number() OVER (ORDER BY score DESC, gamma) = 1 AS best FROM sc""",
    "merged_tiny": _U
    + """, w AS (SELECT CASE WHEN vec_id % 50 = 0 THEN vec_id + 1000 ELSE label END AS label, u FROM u), n AS (SELECT label, count(*) AS n FROM w GROUP BY label),
c AS (SELECT label, d, sum(x) AS s FROM (SELECT label, unnest(u) AS x, unnest(range(len(u))) AS d FROM w) GROUP BY ALL), cn AS (SELECT c.label, d, s / n AS x, n FROM c JOIN n USING (label)),
sim AS (SELECT a.label, b.label AS target, b.n AS m, (1 + sum(a.x * b.x)) / 2 AS sim FROM cn a JOIN cn b ON a.d = b.d WHERE a.n < 3 AND b.n >= 3 GROUP BY ALL)
SELECT label, target FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim / (1 + ln(1 + m)), 9) DESC, target) AS r FROM sim) WHERE r = 1""",
}
