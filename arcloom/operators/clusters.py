"""Similarity graphs, clusterings and how good they are.

Pairs are sparse rows (i, j, w). Densities within and between clusters of all pairs of unit vectors
need no pairs: they follow from each cluster's vector sum (the sum of a cluster's pairwise cosines
is |Σu|² − n), so they cost one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.tables import cut


def unit(vec: Column) -> Column:
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # an array of one row, else the norm is taken anew for each element
    one = F.array(F.struct(v.alias("v"), F.when(norm == 0, 1.0).otherwise(norm).alias("n")))
    return F.when(vec.isNotNull(), F.transform(one, lambda r: F.transform(r["v"], lambda x: x / r["n"]))[0])


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", block: int = 512, chunk: int = 2048) -> DataFrame:
    """(i, j, w): for every query its ``k`` most similar rows by (1 + cosine) / 2, itself among them counted and then left out.

    Queries go in blocks against rows in chunks, each task one matrix product; only ``k`` rows a
    query leave a task, and a window takes the best of those. Ties go to the lower id.
    """
    nb = max(1, -(-queries.count() // block))
    nc = max(1, -(-rows.count() // chunk))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        one = df.select(F.col(key).alias("id"), unit(F.col(vec)).alias("u"), F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(n)).alias(name))
        return one.groupBy(name).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("u")).alias(f"{name}_u"))

    q, r = packed(queries, nb, "b"), packed(rows, nc, "c")
    both = r.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("b", F.col("b").cast("long")).join(q, "b")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qi, qu, ri, ru in zip(batch["b_ids"], batch["b_u"], batch["c_ids"], batch["c_u"]):
                a, b, ids = np.asarray(qu).reshape(len(qi), -1), np.asarray(ru).reshape(len(ri), -1), np.asarray(ri)
                s = (1 + a @ b.T) / 2
                out = []
                for n, i in enumerate(qi):
                    top = np.lexsort((ids, -np.round(s[n], 9)))[:k]
                    out += [(int(i), int(ids[t]), float(s[n][t])) for t in top]
                yield pd.DataFrame(out, columns=["i", "j", "w"])

    found = both.mapInPandas(best, "i long, j long, w double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("w", 9)), "j"))
    return found.withColumn("r", rank).where(f"r <= {k} and i <> j").select("i", "j", "w")


def group_weights(vectors: DataFrame, links: DataFrame, by: list[str], a: float, k: int, block: int = 1024) -> DataFrame:
    """(by, i, j, w): a · similarity + (1 − a) · link of each node's ``k`` heaviest partners in its group, in both directions.

    ``vectors`` (by, id, vec), ``links`` (by, i, j) in both directions. Similarities (1 + cosine) / 2 are
    scaled by the largest of the group, links by 1. The ``k`` most similar nodes and all linked ones
    hold a node's ``k`` heaviest; a group is compared in blocks of rows, a pair of blocks a task.
    Shorter vectors are filled up with zeros.
    """
    vectors = cut(vectors)  # used four times, and encoded by a model
    sizes = vectors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.max(F.size("vec")).alias("dims"))
    filled = F.concat("vec", F.array_repeat(F.lit(0.0), F.col("dims") - F.size("vec")))
    v = vectors.join(sizes, by).select(*by, F.col("id").cast("long").alias("id"), unit(filled).alias("u"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"))
    rows = cut(v.groupBy(*by, "b", "blocks").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("u")).alias("us")))
    mine = rows.select(*by, "ids", "us", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    pairs = mine.join(rows.select(*by, "b", F.col("ids").alias("jds"), F.col("us").alias("vs")), [*by, "b"])
    kinds = ", ".join(f"`{x}` {vectors.schema[x].dataType.simpleString()}" for x in by)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, jds = np.asarray(r.ids), np.asarray(r.jds)
                s = (1 + np.asarray(r.us).reshape(len(ids), -1) @ np.asarray(r.vs).reshape(len(jds), -1).T) / 2
                out = []
                for n, i in enumerate(ids):
                    order = [t for t in np.lexsort((jds, -np.round(s[n], 9)))[: k + 1] if jds[t] != i][:k]
                    out += [(int(i), int(jds[t]), float(s[n, t])) for t in order]
                got = pd.DataFrame(out, columns=["i", "j", "s"]).astype({"i": "int64", "j": "int64", "s": "float64"})
                for x in by:
                    got[x] = getattr(r, x)
                yield got[[*by, "i", "j", "s"]]

    near = pairs.mapInPandas(best, f"{kinds}, i long, j long, s double")
    near = cut(near.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.desc(F.round("s", 9)), "j"))).where(F.col("__r") <= k).drop("__r"))
    linked = cut(links.where("i <> j").select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct())  # used twice
    far = linked.join(near.select(*by, "i", "j"), [*by, "i", "j"], "left_anti")
    far = far.join(v.select(*by, F.col("id").alias("i"), F.col("u").alias("x")), [*by, "i"]).join(v.select(*by, F.col("id").alias("j"), F.col("u").alias("y")), [*by, "j"])
    far = far.select(*by, "i", "j", ((1 + F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda m, z: m + z)) / 2).alias("s"))
    top = near.groupBy(*by).agg(F.max("s").alias("top"))
    both = near.unionByName(far).join(linked.withColumn("link", F.lit(1.0)), [*by, "i", "j"], "left").join(top, by)
    w = a * F.when(F.col("top") > 1e-12, F.col("s") / F.col("top")).otherwise(0.0) + (1 - a) * F.coalesce("link", F.lit(0.0))
    heavy = Window.partitionBy(*by, "i").orderBy(F.desc(F.round("w", 9)), "j")
    kept = both.select(*by, "i", "j", w.alias("w")).withColumn("__r", F.row_number().over(heavy)).where(F.col("__r") <= k).drop("__r")
    turned = kept.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return kept.unionByName(turned).groupBy(*by, "i", "j").agg(F.max("w").alias("w"))


def symmetric_max(pairs: DataFrame) -> DataFrame:
    both = pairs.select("i", "j", "w").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("w"))


def symmetric_mean(pairs: DataFrame) -> DataFrame:
    """Average with the transpose, without the diagonal, not below zero."""
    both = pairs.select("i", "j", "w").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.where("i <> j").groupBy("i", "j").agg(F.greatest(F.sum("w") / 2, F.lit(0.0)).alias("w"))


def scaled01(pairs: DataFrame, implicit_zeros: bool = True) -> DataFrame:
    """Weights scaled to [0, 1] over the whole matrix; pairs that are not there are zeros of it."""
    ends = pairs.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    lo = F.least(F.col("lo"), F.lit(0.0)) if implicit_zeros else F.col("lo")
    out = pairs.crossJoin(F.broadcast(ends))  # one row
    return out.select("i", "j", F.when(F.col("hi") - lo > 1e-12, (F.col("w") - lo) / (F.col("hi") - lo)).otherwise(0.0).alias("w"))


def fused(semantic: DataFrame, structural: DataFrame, a: float) -> DataFrame:
    """a · scaled semantic + (1 − a) · scaled structural weights."""
    s, t = scaled01(semantic).withColumnRenamed("w", "s"), scaled01(structural).withColumnRenamed("w", "t")
    return s.join(t, ["i", "j"], "full").select("i", "j", (a * F.coalesce("s", F.lit(0.0)) + (1 - a) * F.coalesce("t", F.lit(0.0))).alias("w"))


def above(pairs: DataFrame, tau: float) -> DataFrame:
    return pairs.where(F.col("w") >= tau)


def size_stats(labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Clusters, share of singletons and of clusters of at most two, and the coefficient of variation of the sizes."""
    n = labels.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.avg((F.col("n") == 1).cast("double")).alias("singletons"),
        F.avg((F.col("n") <= 2).cast("double")).alias("tiny"),
        (F.stddev_pop("n") / (F.avg("n") + 1e-12)).alias("size_cv"),
    )


def cluster_densities(rows: DataFrame, by: list[str], label: str = "label", vec: str = "embedding") -> DataFrame:
    """(by, label, n, intra, inter): mean similarity (1 + cosine) / 2 within a cluster and to all other rows."""
    dims = rows.select(*by, label, F.posexplode(unit(F.col(vec))).alias("d", "x"))
    per = dims.groupBy(*by, label, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy(*by, "d").agg(F.sum("s").alias("t"), F.sum("n").alias("all"))
    both = per.join(whole, [*by, "d"]) if by else per.join(whole, "d")
    c = both.groupBy(*by, label).agg(F.max("n").alias("n"), F.max("all").alias("all"), F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("out"))
    n, rest = F.col("n"), F.col("all") - F.col("n")
    return c.select(*by, label, "n", F.when(n > 1, (1 + (F.col("own") - n) / (n * (n - 1))) / 2).alias("intra"), F.when(rest > 0, (1 + F.col("out") / (n * rest)) / 2).otherwise(0.0).alias("inter"))


def weight_densities(weights: DataFrame, labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by, label, n, intra, inter): mean weight within a cluster and to all other nodes; pairs without a weight are zeros.

    ``weights`` are (i, j, w) in both directions, with those of ``by`` that tell their graphs apart; ``labels`` (by, id, label)."""
    on = [k for k in by if k in weights.columns]
    at = labels.select(*by, "id", label)
    pairs = weights.where("i <> j").select(*on, "i", "j", "w").join(at.withColumnsRenamed({"id": "i", label: "a"}), [*on, "i"])
    pairs = pairs.join(at.withColumnsRenamed({"id": "j", label: "b"}), [*by, "j"])
    same = F.col("a") == F.col("b")
    sums = pairs.groupBy(*by, F.col("a").alias(label)).agg(F.sum(F.when(same, F.col("w")).otherwise(0.0)).alias("own"), F.sum(F.when(same, 0.0).otherwise(F.col("w"))).alias("out"))
    sizes = at.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*by).agg(F.sum("n").alias("all"))
    t = sizes.join(whole, by) if by else sizes.crossJoin(F.broadcast(whole))  # one row
    t = t.join(sums, [*by, label], "left")
    n, rest = F.col("n"), F.col("all") - F.col("n")
    own, out = F.coalesce("own", F.lit(0.0)), F.coalesce("out", F.lit(0.0))
    return t.select(*by, label, "n", F.when(n > 1, own / (n * (n - 1))).alias("intra"), F.when(rest > 0, out / (n * rest)).otherwise(0.0).alias("inter"))


def quality(densities: DataFrame, by: list[str]) -> DataFrame:
    """Size-weighted separation (singletons left out) and the deviation of the densities (infinite without any)."""
    use = F.col("intra").isNotNull()
    return densities.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(use, F.col("n") * (F.col("intra") - F.col("inter")))) / F.sum(F.when(use, F.col("n"))), F.lit(0.0)).alias("separation"),
        F.coalesce(F.stddev_pop("intra"), F.lit(float("inf"))).alias("density_std"),
    )


def silhouette(weights: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, silhouette): mean silhouette by distances 1 - weight; pairs without a weight are at distance 1, nodes alone count 0.

    Null with fewer than two clusters."""
    on = [k for k in by if k in weights.columns]
    at = labels.select(*by, "id", "label")
    sizes = at.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    near = weights.where("i <> j").select(*on, F.col("i").alias("id"), "j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "w")).alias("w"))
    near = near.join(at.withColumnsRenamed({"id": "j", "label": "other"}), [*on, "j"]).groupBy(*by, "id", "other").agg(F.sum("w").alias("w"))
    near = at.join(near, [*by, "id"]).join(sizes.withColumnRenamed("label", "other"), [*by, "other"])
    home = F.col("label") == F.col("other")
    # clusters without a weight to a node are at distance 1: they matter only where all others are
    met = near.groupBy(*by, "id").agg(F.max(F.when(home, F.col("w") / (F.col("n") - 1))).alias("own"), F.max(F.when(~home, F.col("w") / F.col("n"))).alias("far"))
    k = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    each = at.join(sizes, [*by, "label"]).join(met, [*by, "id"], "left")
    each = each.join(k, by) if by else each.crossJoin(F.broadcast(k))  # one row
    a, b = 1 - F.coalesce("own", F.lit(0.0)), 1 - F.coalesce("far", F.lit(0.0))
    s = F.when(F.col("n") == 1, 0.0).otherwise((b - a) / F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.greatest(a, b)))
    return each.groupBy(*by).agg(F.when(F.max("k") >= 2, F.avg(s)).alias("silhouette"))


def adjusted_rand(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, ari) of two labellings of the same rows, from their contingency counts."""

    def c2(x: Column) -> Column:
        return x * (x - 1) / 2

    cell = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cell.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("sa"))
    cols = cell.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("sb"), F.sum("n").alias("all"))
    both = cell.groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("s"))
    t = both.join(rows, by).join(cols, by) if by else both.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("sa") * F.col("sb") / F.greatest(c2(F.col("all")), F.lit(1.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return t.select(*by, F.when(top - expected == 0, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def mean_pairwise_rand(runs: DataFrame, by: list[str], run: str = "seed") -> DataFrame:
    """(by, mean_ari): mean adjusted Rand index of all pairs of runs (by, run, id, label); 1 where there is one run only."""
    a = runs.select(*by, "id", F.col(run).alias("r1"), F.col("label").alias("a"))
    b = runs.select(*by, "id", F.col(run).alias("r2"), F.col("label").alias("b"))
    each = adjusted_rand(a.join(b, [*by, "id"]).where("r1 < r2"), [*by, "r1", "r2"])
    mean = each.groupBy(*by).agg(F.avg("ari").alias("mean_ari"))
    return runs.select(*by).distinct().join(mean, by, "left").select(*by, F.coalesce("mean_ari", F.lit(1.0)).alias("mean_ari"))


def coassociation(runs: DataFrame, queries: DataFrame, n_runs: int) -> DataFrame:
    """(i, j, freq): share of the runs that put query i and row j together (zeros left out)."""
    q = queries.select("run", "label", F.col("id").alias("i"))
    hit = q.join(runs.select("run", "label", F.col("id").alias("j")), ["run", "label"])
    return hit.groupBy("i", "j").agg((F.count(F.lit(1)) / n_runs).alias("freq"))


def min_max(x: Column, over: Window) -> Column:
    """Scaled to [0, 1] over a window; what is not finite gives NaN, and all zeros come out where nothing finite differs."""
    inf = float("inf")
    real = F.when(~F.isnan(x) & (x < inf) & (x > -inf), x)
    lo, hi = F.min(real).over(over), F.max(real).over(over)
    return F.when(hi - lo >= 1e-12, F.coalesce((real - lo) / (hi - lo), F.lit(float("nan")))).otherwise(0.0)


def composite(ari: Column, sep: Column, small: Column, over: Column, under: Column, cv: Column, dens: Column) -> Column:
    """The score of a resolution: stability and separation against small, too many, too few, uneven clusters."""
    return 0.45 * ari + 0.45 * sep - (0.40 * small + 0.20 * over + 0.10 * under + 0.20 * cv + 0.15 * dens)


def cpm_communities(edges: DataFrame, keys: list[str], gamma: float | str, seed: int | str = 2025, rounds: int | None = None) -> DataFrame:
    """(keys, id, label): communities by local moving under the constant Potts model, many nodes at a time.
    ``gamma`` and ``seed`` are values, or the names of key columns that hold them.

    In each round half of the nodes (by a hash of the seed and the round) move to the neighbouring
    community of the largest gain: weight to it minus gamma times its size. Only moves that gain are
    made, so ties stay. It ends when no node wants to move. Moves of one round may spoil each other: a
    round that does not raise a graph's quality is taken back there, and instead each community is part
    of one move at most, which always raises it, so no state comes again. With ``rounds``, an error is
    raised where these are not enough. Everything is joins on nodes and communities, so no graph has to
    fit a task.
    """
    w = edges.select(*keys, "src", "dst", "w").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst").groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))
    w = cut(w)
    gamma, seed = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (gamma, seed))
    now = cut(w.select(*keys, F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    last, n = None, 0  # the states before a round of many moves, with their quality
    while True:
        best = cut(_wishes(w, now, keys, gamma), loop=True)
        # half the weight inside and half the pairs inside, seen from each node
        q = best.groupBy(*keys).agg(F.sum((F.col("w") - gamma * (F.col("n") - 1)) / 2).alias("quality"), F.count_if(F.col("to") != F.col("old")).alias("wishes"))
        if last is not None:
            q = q.join(last.groupBy(*keys).agg(F.first("quality").alias("before")), keys, "left")
        q = cut(q.withColumn("back", F.coalesce(F.col("quality") <= F.col("before") + 1e-9, F.lit(False)) if last is not None else F.lit(False)), loop=True)
        wishes = q.agg(F.sum("wishes")).first()[0]
        if not wishes:
            return now
        if rounds is not None and n >= rounds:
            raise RuntimeError(f"{wishes} nodes still want to move after {rounds} rounds")
        turn = F.pmod(F.xxhash64(seed, F.lit(n), "id"), F.lit(2)) == 0
        forth = best.join(q.where("not back").select(*keys, "quality"), keys)
        moves = forth.select(*keys, "id", F.when(turn, F.col("to")).otherwise(F.col("old")).alias("label"))
        if last is not None:
            moves = moves.unionByName(_apart(last.join(q.where("back").select(*keys), keys, "left_semi"), keys, seed, n))
        now, last, n = cut(moves, loop=True), forth, n + 1


def _wishes(w: DataFrame, now: DataFrame, keys: list[str], gamma: Column) -> DataFrame:
    """(keys, id, old, to, gain, w, n): where each node wants to be, with its weight to and the size of its own community."""
    to = w.join(now.select(*keys, F.col("id").alias("dst"), "label"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
    size = now.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    own = now.select(*keys, "id", "label").withColumn("w", F.lit(0.0))
    gain = to.unionByName(own).groupBy(*keys, "id", "label").agg(F.sum("w").alias("w")).join(size, [*keys, "label"]).join(now.withColumnRenamed("label", "old"), [*keys, "id"])
    home = F.col("label") == F.col("old")
    value = F.round(F.col("w") - gamma * (F.col("n") - home.cast("int")), 9)
    best = gain.groupBy(*keys, "id").agg(
        F.max_by("label", F.struct(value.alias("v"), home.alias("home"), F.xxhash64("label").alias("h"))).alias("to"), F.first("old").alias("old"),
        (F.max(value) - F.max(F.when(home, value))).alias("gain"), F.max(F.when(home, F.col("w"))).alias("w"), F.max(F.when(home, F.col("n"))).alias("n"),
    )
    return best


def _apart(best: DataFrame, keys: list[str], seed: Column, n: int) -> DataFrame:
    """(keys, id, label) after moves of which no two share a community, the largest gains first."""
    rank = F.struct("gain", F.xxhash64(seed, F.lit(n), "id"), "id")
    asked = best.where(F.col("to") != F.col("old")).select(*keys, "id", F.explode(F.array("old", "to")).alias("label"), rank.alias("rank"))
    first = asked.groupBy(*keys, "label").agg(F.max_by("id", "rank").alias("id"))
    moves = first.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("won"))
    return best.join(moves, [*keys, "id"], "left").select(*keys, "id", F.when(F.col("won") == 2, F.col("to")).otherwise(F.col("old")).alias("label"))


def agreeing(runs: DataFrame, edges: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, src, dst, f): edges whose ends are together in at least ``tau`` of the runs (keys, run, id, label), with that share."""
    n = runs.select("run").distinct().count() or 1
    a = runs.select(*keys, "run", F.col("id").alias("src"), F.col("label").alias("a"))
    b = runs.select(*keys, "run", F.col("id").alias("dst"), F.col("label").alias("b"))
    both = edges.select(*keys, "src", "dst").distinct().join(a, [*keys, "src"]).join(b, [*keys, "run", "dst"])
    return both.groupBy(*keys, "src", "dst").agg((F.sum((F.col("a") == F.col("b")).cast("int")) / n).alias("f")).where(F.col("f") >= tau)


def consensus(runs: DataFrame, edges: DataFrame, keys: list[str], tau: float, gamma: float = 0.1) -> DataFrame:
    """(keys, id, label): communities of the edges that at least ``tau`` of the runs agree on, weighted by that share.

    ``runs`` are (keys, run, id, label). Only pairs that are edges are looked at, not all pairs; nodes
    without such an edge are communities of their own and left out."""
    kept = agreeing(runs, edges, keys, tau).withColumnRenamed("f", "w")
    return cpm_communities(cut(kept), keys, gamma)


def merge_tiny(centroids: DataFrame, least: int) -> DataFrame:
    """(label, target): each cluster below ``least`` joins the large one of the highest mean similarity, large ones at a discount.

    ``centroids`` are (label, n, d, s): sizes and summed unit vectors by dimension; pairs are of clusters only."""
    small = centroids.where(F.col("n") < least).select("label", "d", (F.col("s") / F.col("n")).alias("x"))
    large = centroids.where(F.col("n") >= least).select(F.col("label").alias("target"), F.col("n").alias("m"), "d", (F.col("s") / F.col("n")).alias("y"))
    sim = small.join(large, "d").groupBy("label", "target", "m").agg(((1 + F.sum(F.col("x") * F.col("y"))) / 2).alias("sim"))
    return sim.groupBy("label").agg(F.max_by("target", F.struct(F.round(F.col("sim") / (1 + F.log1p("m")), 9), -F.col("target"))).alias("target"))
