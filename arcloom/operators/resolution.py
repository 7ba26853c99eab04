"""Clusterings over a grid of resolutions and seeds, how good they are, and the consensus of the best.

A group's graph (a project's files, a module's functions) is packed into one row. ``best_clustering``
optimises groups of every size in the same way, in the JVM, a resolution a task in large ones; all that
it keeps of a graph are arrays of numbers, 12 bytes an arc and 28 a node. ``partitions`` and ``consensus``
by themselves take the optimiser that is made of joins (``clusters.cpm_communities``) for groups of
more than ``LIMIT`` nodes.
"""

from __future__ import annotations

import math
import random
from collections import deque
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.jvm import java_function
from arcloom.operators import clusters
from arcloom.tables import cut

#: Nodes of a group that is optimised in one task, and tasks that the runs of a group are spread over at least.
LIMIT, SPREAD = 100_000, 24

#: Nodes of a group for each task that its resolutions are spread over.
SHARE = 100

#: ``optimised`` for all resolutions and seeds of a graph, in the JVM.
OPTIMISER = Path(__file__).with_name("Communities.java")

Encode = Callable[[list[str]], np.ndarray]


# -- vectors of names ---------------------------------------------------------------------------
def hashed_trigrams(dims: int = 64) -> Encode:
    """An encoder that needs no model: character trigrams of the words of a name, hashed with signs."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims))
        for n, t in enumerate(texts):
            for w in "".join(f" {c.lower()}" if c.isupper() else c for c in t).replace("_", " ").split():
                for k in range(len(w)):
                    h = zlib.crc32(f"^{w}$"[k : k + 3].encode("utf-8", "surrogatepass"))
                    out[n, h % dims] += 1 if h >> 16 & 1 else -1
        return out

    return encode


def encoded(rows: DataFrame, key: list[str], text: str, load: Callable[[], Encode] = hashed_trigrams) -> DataFrame:
    """(key, vec): the vector of each text by an injected model, loaded once a task; a null text gives the vector of the empty one."""
    kept = rows.select(*key, F.coalesce(text, F.lit("")).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            got = model(list(b["__text"]))
            yield b[key].assign(vec=[np.asarray(v, dtype=np.float64) for v in got])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + ", vec array<double>"
    return kept.mapInPandas(run, schema)


# -- one graph in memory ------------------------------------------------------------------------
def _moved(adj: list[dict[int, float]], mass: list[float], label: list[int], coef: float, rnd: random.Random, within: list[int] | None = None) -> bool:
    """Nodes move to the neighbouring community of the largest gain until none gains. ``within``: only nodes that are alone move, inside their group."""
    total: dict[int, float] = {}
    members: dict[int, int] = {}
    for v, c in enumerate(label):
        total[c] = total.get(c, 0.0) + mass[v]
        members[c] = members.get(c, 0) + 1
    order = list(range(len(adj)))
    rnd.shuffle(order)
    todo, waiting, any_moved, fresh = deque(order), [True] * len(adj), False, max(label, default=0) + 1
    while todo:
        v = todo.popleft()
        waiting[v] = False
        own = label[v]
        if within is not None and members[own] > 1:
            continue
        to: dict[int, float] = {own: 0.0}
        if within is None:
            for u, w in adj[v].items():
                c = label[u]
                if c in to:
                    to[c] += w
                else:
                    to[c] = w
        else:
            group = within[v]
            for u, w in adj[v].items():
                if within[u] == group:
                    to[label[u]] = to.get(label[u], 0.0) + w
        price = coef * mass[v]
        here = to.pop(own) - price * (total[own] - mass[v])
        best, value = own, here
        for c, w in to.items():
            if w > value:  # what a community costs is not below zero
                x = w - price * total[c]
                if x > value + 1e-12:
                    best, value = c, x
        if best == own and value < -1e-12 and members[own] > 1:  # better alone
            best, fresh = fresh, fresh + 1
            total[best], members[best] = 0.0, 0
        if best != own:
            label[v] = best
            total[own] -= mass[v]
            members[own] -= 1
            total[best] += mass[v]
            members[best] += 1
            any_moved = True
            if within is None:
                for u in adj[v]:
                    if not waiting[u] and label[u] != best:
                        waiting[u] = True
                        todo.append(u)
    return any_moved


def _dense(label: list[int]) -> list[int]:
    at: dict[int, int] = {}
    return [at.setdefault(c, len(at)) for c in label]


def quality(adj: list[dict[int, float]], label: list[int], mass: list[float], coef: float) -> float:
    inside = sum(w for v, near in enumerate(adj) for u, w in near.items() if u > v and label[u] == label[v])
    total: dict[int, float] = {}
    square: dict[int, float] = {}
    for v, c in enumerate(label):
        total[c] = total.get(c, 0.0) + mass[v]
        square[c] = square.get(c, 0.0) + mass[v] ** 2
    return inside - coef * sum((t * t - square[c]) / 2 for c, t in total.items())


def adjacent(n: int, src, dst, w) -> list[dict[int, float]]:
    """The neighbours of nodes 0..n-1 with their weights, the larger of both directions; no loops and no weights of 0."""
    base: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(np.asarray(src).tolist(), np.asarray(dst).tolist(), np.asarray(w).tolist()):
        if a != b and x:
            base[a][b] = base[b][a] = max(float(x), base[a].get(b, 0.0))
    return base


def optimised(n: int, src, dst, w, gamma: float, seed: int, objective: str = "CPM", base: list[dict[int, float]] | None = None, mass: list[float] | None = None) -> tuple[list[int], float]:
    """(labels numbered by first member, quality) of an undirected weighted graph on nodes 0..n-1.

    Nodes move locally; communities are refined into parts that hold together, the parts become the
    nodes of the next level, which starts from the communities; and all this again from its own
    result, until nothing moves. ``CPM`` weighs pairs by gamma, ``RB`` by gamma times the product of
    strengths over twice the total weight. ``base`` is the graph as ``adjacent`` gives it, where it is known;
    with ``mass``, each node stands for so many, for CPM.
    """
    base = adjacent(n, src, dst, w) if base is None else base
    strength = [sum(x.values()) for x in base]
    if objective == "CPM":
        mass, coef = mass or [1.0] * n, gamma
    elif objective == "RB":
        mass, coef = strength, gamma / max(sum(strength), 1e-12)
    else:
        raise ValueError("objective is CPM or RB")
    rnd, label, moved = random.Random(seed), list(range(n)), True
    while moved:
        moved = False
        adj, m, now, home = base, mass, list(label), list(range(n))
        while True:
            moved |= _moved(adj, m, now, coef, rnd)
            part = list(range(len(adj)))
            _moved(adj, m, part, coef, rnd, now)
            part = _dense(part)
            size = max(part, default=-1) + 1
            if size == len(adj):
                break
            up: list[dict[int, float]] = [{} for _ in range(size)]
            mm, nn = [0.0] * size, [0] * size
            for v, near in enumerate(adj):
                p = part[v]
                mm[p] += m[v]
                nn[p] = now[v]
                for u, x in near.items():
                    if part[u] != p:
                        up[p][part[u]] = up[p].get(part[u], 0.0) + x
            home, adj, m, now = [part[h] for h in home], up, mm, nn
        label = [now[h] for h in home]
    label = _dense(label)
    return label, quality(base, label, mass, coef)


def agreed(runs: list[list[int]], tau: float, gamma: float, seed: int) -> list[int]:
    """Labels by CPM on the graph of pairs that at least ``tau`` of the runs keep together, weighted by that share."""
    whole, mass, *pairs = agreement(runs, tau)
    got = optimised(len(mass), *pairs, gamma, seed, mass=mass.tolist())[0]
    return _dense([got[c] for c in whole])


def agreement(runs: list[list[int]], tau: float) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes' numbers, masses, src, dst, w): the graph of pairs that at least ``tau`` of the runs keep together, each pair once.

    Nodes that no run tells apart stay together in every optimum, so each set of them is one node with their number as its mass."""
    label = np.asarray(runs, np.int64).reshape(len(runs), -1)
    k = len(label)
    whole = _dense([tuple(x) for x in label.T.tolist()])
    first = np.unique(whole, return_index=True)[1] if whole else np.zeros(0, np.int64)
    at, mass = label[:, first], np.bincount(whole, minlength=len(first)).astype(float)
    src, dst, w = [], [], []
    # only pairs with a common community are looked at, in the first run that has them together
    for r in range(k):
        by = np.argsort(at[r], kind="stable")
        for g in np.split(by, np.flatnonzero(np.diff(at[r][by])) + 1):
            step = min(256, max(1, 2**22 // len(g)))
            for x in range(0, len(g) - 1, step):
                rows = g[x : x + step]
                same = [at[q][rows][:, None] == at[q][g][None, :] for q in range(k)]
                count = np.add.reduce([y.astype(np.int32) for y in same])
                fresh = (count / k >= tau) & (rows[:, None] < g[None, :])
                for q in range(r):
                    fresh &= ~same[q]
                i, j = np.nonzero(fresh)
                src.append(rows[i]), dst.append(g[j]), w.append(count[i, j] / k * mass[rows[i]] * mass[g[j]])
    none = np.zeros(0, np.int64)
    return whole, mass, np.concatenate([none, *src]), np.concatenate([none, *dst]), np.concatenate([np.zeros(0), *w])


def merged_small(label: list[int], src, dst, w, least: int = 2, accept: float = 0.0, passes: int = 5, discount: bool = True) -> list[int]:
    """Clusters below ``least`` join, one after another by label, the cluster of the highest mean weight (large ones at a
    discount, the lowest label among equals) if that reaches ``accept``; again until nothing changes, ``passes`` times at the most."""
    label = list(label)
    near: list[list[tuple[int, float]]] = [[] for _ in label]
    for a, b, x in zip(np.asarray(src).tolist(), np.asarray(dst).tolist(), np.asarray(w).tolist()):
        near[int(a)].append((int(b), float(x)))
    members: dict[int, list[int]] = {}
    for v, c in enumerate(label):
        members.setdefault(c, []).append(v)
    for _ in range(passes):
        changed, order, low = False, sorted(members), 0
        for c in order:
            own = members.get(c)
            if own is None or len(own) >= least or len(members) < 2:
                continue
            to: dict[int, float] = {}
            for v in own:
                for u, x in near[v]:
                    if label[u] != c:
                        to[label[u]] = to.get(label[u], 0.0) + x
            while order[low] not in members:
                low += 1
            lowest = order[low] if order[low] != c else next(d for d in order[low + 1 :] if d in members)
            to.setdefault(lowest, 0.0)  # of those without a weight, the only one that can be best
            score = {d: x / (len(own) * len(members[d])) / ((1 + math.log1p(len(members[d]))) if discount else 1.0) for d, x in to.items()}
            best = max(score, key=lambda d: (score[d], -d))
            if score[best] >= accept:
                for v in own:
                    label[v] = best
                members[best] += members.pop(c)
                changed = True
        if not changed:
            break
    return label


def _rands(label: np.ndarray) -> np.ndarray:
    """Adjusted Rand index of each pair of labellings (rows, by numbers from 0); as ``clusters.adjusted_rand``."""
    runs, n = label.shape
    k = int(label.max(initial=0)) + 1

    def pairs(of: np.ndarray, codes: np.ndarray, rows: int) -> np.ndarray:
        """Pairs of equal codes in each row; ``of`` tells the rows of the codes, which are in order."""
        at = np.flatnonzero(np.diff(codes, prepend=-1))
        count = np.diff(at, append=len(codes)).astype(np.float64)
        return np.bincount(of[at], count * (count - 1) / 2, rows)

    row = np.repeat(np.arange(runs), n)
    own = pairs(row, np.sort(row * k + label.ravel()), runs)
    out, whole = np.ones((runs, runs)), max(n * (n - 1) / 2, 1.0)
    for x in range(runs - 1):
        rest = label[x + 1 :]
        row = np.repeat(np.arange(len(rest)), n)
        s = pairs(row, np.sort(((np.arange(len(rest))[:, None] * k + label[x]) * k + rest).ravel()), len(rest))
        expected, top = own[x] * own[x + 1 :] / whole, (own[x] + own[x + 1 :]) / 2
        out[x, x + 1 :] = np.divide(s - expected, top - expected, out=np.ones(len(rest)), where=top != expected)
    return out


def _run_statistics(label: np.ndarray, src, dst, w) -> tuple[float, ...]:
    """(separation, density deviation, clusters, share of singletons, of tiny ones, size variation) of one labelling by numbers from 0."""
    n, k = np.bincount(label).astype(np.float64), float(len(label))
    a, same = label[src], label[src] == label[dst]
    own = np.bincount(a, np.where(same, w, 0.0), len(n))
    out = np.bincount(a, np.where(same, 0.0, w), len(n))
    use, rest = n > 1, k - n
    inter = np.divide(out, n * rest, out=np.zeros_like(n), where=rest > 0)
    intra = own[use] / (n[use] * (n[use] - 1))
    sep = float((n[use] * (intra - inter[use])).sum() / n[use].sum()) if use.any() else 0.0
    return sep, float(intra.std()) if use.any() else math.inf, float(len(n)), float((n == 1).mean()), float((n <= 2).mean()), float(n.std() / (n.mean() + 1e-12))


def statistics(runs: list[list[int]], src, dst, w, known: dict) -> dict[str, float]:
    """What ``run_statistics`` tells of one group's labellings (numbered by first member) of one resolution. ``known`` keeps
    what is known of a labelling; equal ones are looked at once."""
    use = np.asarray(src) != np.asarray(dst)
    src, dst, w = np.asarray(src)[use], np.asarray(dst)[use], np.asarray(w)[use]
    arrays = [np.asarray(r, np.int64) for r in runs]
    keys = [x.tobytes() for x in arrays]
    for k, x in zip(keys, arrays):
        if k not in known:
            known[k] = _run_statistics(x, src, dst, w)
    no: dict[bytes, int] = {}
    place = [no.setdefault(k, len(no)) for k in keys]
    rand = _rands(np.stack([arrays[place.index(q)] for q in range(len(no))]))
    pairs = [float(rand[min(p, q), max(p, q)]) for x, p in enumerate(place) for q in place[x + 1 :]]
    sep, dens, count, single, tiny, cv = zip(*(known[k] for k in keys))
    finite = [x for x in dens if x < math.inf]
    return {
        "mean_sep": float(np.mean(sep)), "mean_density_std": float(np.mean(finite)) if finite else math.inf, "mean_clusters": float(np.mean(count)), "median_clusters": float(np.median(count)),
        "mean_singletons": float(np.mean(single)), "mean_tiny": float(np.mean(tiny)), "mean_size_cv": float(np.mean(cv)), "mean_ari": float(np.mean(pairs)) if pairs else 1.0, "nodes": len(arrays[0]),
    }


# -- groups as rows -----------------------------------------------------------------------------
def grid(low: float, high: float, points: int) -> list[float]:
    """Resolutions evenly spaced by their logarithms."""
    if points == 1:
        return [low]
    return [round(10 ** (math.log10(low) + (math.log10(high) - math.log10(low)) * k / (points - 1)), 9) for k in range(points)]


def packed(nodes: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, ids, i, j, w): one row a group, nodes in the order of their ids and weights in any order."""
    ids = nodes.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("id").cast("long"))).alias("ids"))
    # a node's weights first: lists of single numbers hold an object for each
    near = weights.groupBy(*by, F.col("i").cast("long").alias("i")).agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))).alias("n"))
    rows = near.groupBy(*by).agg(F.collect_list(F.struct(F.array_repeat("i", F.size("n")).alias("i"), F.col("n.j").alias("j"), F.col("n.w").alias("w"))).alias("rows"))
    return ids.join(rows.select(*by, *[F.flatten(f"rows.{x}").alias(x) for x in ("i", "j", "w")]), by, "left")


def _graph(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(row.ids, np.int64)
    if row.i is None:
        none = np.zeros(0, np.int64)
        return ids, none, none, np.zeros(0)
    i, j = np.searchsorted(ids, np.asarray(row.i, np.int64)), np.searchsorted(ids, np.asarray(row.j, np.int64))
    order = np.lexsort((j, i))  # rows come in any order, and the order of neighbours decides between equals
    return ids, i[order], j[order], np.asarray(row.w, np.float64)[order]


def _stored(n: int, src, dst, w, mass=None) -> bytes:
    """The graph of ``adjacent``, its neighbours in the same order, as ``Communities.java`` reads it: numbers of nodes and arcs, where each
    node's arcs begin, the arcs' other ends (four bytes each), masses of nodes and weights of arcs (eight)."""
    use = (src != dst) & (w != 0)
    a, b = (np.stack(x, 1).ravel() for x in ((src[use], dst[use]), (dst[use], src[use])))
    order = np.lexsort((b, a))
    x = np.maximum(np.repeat(w[use], 2), 0.0)[order]
    head = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
    first = order[head]  # of an arc that is given twice
    turn = np.lexsort((first, a[first]))
    weight = (np.maximum.reduceat(x, head) if len(head) else x)[turn]
    start = np.concatenate([[0], np.cumsum(np.bincount(a[first], minlength=n))])
    parts = np.array([n, len(first)]), start, b[first][turn], np.ones(n) if mass is None else mass, weight
    return b"".join(np.asarray(p, "<i4" if k < 3 else "<f8").tobytes() for k, p in enumerate(parts))


def _arcs(graph: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, w) of a stored graph, both directions of each pair."""
    n, m = np.frombuffer(graph, "<i4", 2).tolist()
    start, to = np.frombuffer(graph, "<i4", n + 1, 8), np.frombuffer(graph, "<i4", m, 12 + 4 * n)
    return np.repeat(np.arange(n), np.diff(start)), to.astype(np.int64), np.frombuffer(graph, "<f8", m, 12 + 12 * n + 4 * m)


def stored(nodes: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, ids, graph): one row a group, the graph of ``weights`` on its nodes in the order of their ids."""
    rows = packed(nodes, weights, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_graph(r) for r in b.itertuples(index=False)]
            yield b[by].assign(ids=[g[0] for g in found], graph=[_stored(len(g[0]), *g[1:]) for g in found])

    return rows.mapInPandas(run, f"{_keys(rows, by)}, ids array<long>, graph binary")


def _communities(graph: str, gammas: Column, seeds: list[int], spark: SparkSession) -> Column:
    """``optimised`` of a stored graph: labels by resolution, seed and node."""
    no = F.lit(None).cast("array<long>")
    return java_function(spark, OPTIMISER, "arcloom_communities", "array<array<array<int>>>", graph, no, no, no, gammas, F.array(*[F.lit(s).cast("long") for s in seeds]))


def _spread(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows that hold much work each over a fixed number of tasks: by their bytes they would be put together."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *cols)


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)


def small_groups(nodes: DataFrame, by: list[str], limit: int) -> DataFrame:
    return nodes.groupBy(*by).agg((F.count_distinct("id") <= limit).alias("small"))


def partitions(nodes: DataFrame, weights: DataFrame, by: list[str], gammas: list[float], seeds: list[int], objective: str = "CPM", limit: int = LIMIT) -> DataFrame:
    """(by, gamma, seed, id, label): a clustering of every group for each resolution and seed.

    ``nodes`` (by, id), ``weights`` (by, i, j, w) in both directions. Labels are numbers by first
    member in groups of up to ``limit`` nodes, node ids in larger ones."""
    size = small_groups(nodes, by, limit)
    few, many = size.where("small").drop("small"), size.where("not small").drop("small")
    each = F.explode(F.array(*[F.lit(float(g)) for g in gammas])).alias("gamma")
    parts = min(len(seeds), -(-SPREAD // len(gammas)))
    some = F.explode(F.array(*[F.array(*[F.lit(x) for x in seeds[k::parts]]) for k in range(parts)])).alias("seeds")
    rows = _spread(packed(nodes.join(few, by, "left_semi"), weights.join(few, by, "left_semi"), by).select("*", each).select("*", some), *by, "gamma", "seeds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, src, dst, w = _graph(r)
                base = adjacent(len(ids), src, dst, w)
                for s in map(int, r.seeds):
                    label, _ = optimised(len(ids), src, dst, w, r.gamma, s, objective, base)
                    out = pd.DataFrame({"gamma": r.gamma, "seed": s, "id": ids, "label": np.asarray(label, np.int64)})
                    for k in by:
                        out[k] = getattr(r, k)
                    yield out[[*by, "gamma", "seed", "id", "label"]]

    small = rows.mapInPandas(run, f"{_keys(nodes, by)}, gamma double, seed int, id long, label long")
    if many.isEmpty():
        return small
    if objective != "CPM":
        raise ValueError("groups over the limit are clustered by CPM only")
    wide = weights.join(many, by, "left_semi").select(*by, F.col("i").alias("src"), F.col("j").alias("dst"), "w", each).select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    big = clusters.cpm_communities(wide, [*by, "gamma", "seed"], "gamma", "seed")
    alone = nodes.join(many, by, "left_semi").select(*by, F.col("id").cast("long").alias("id"), each).select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")).distinct()
    big = alone.join(big.withColumn("id", F.col("id").cast("long")), [*by, "gamma", "seed", "id"], "left")
    return small.unionByName(big.select(*by, "gamma", "seed", "id", F.coalesce(F.col("label").cast("long"), "id").alias("label")))


def graded(nodes: DataFrame, weights: DataFrame, by: list[str], gammas: list[float], seeds: list[int]) -> DataFrame:
    """(by, gamma, the columns of ``run_statistics``, runs): each group's clusterings of each resolution, ``runs`` a list of
    labels by the order of ids for each seed, with what they are like; all of a group and resolution in one task."""
    return _graded(stored(nodes, weights, by), by, gammas, seeds)


def _graded(graphs: DataFrame, by: list[str], gammas: list[float], seeds: list[int], share: int = SHARE) -> DataFrame:
    """``graded`` of stored graphs. A graph goes to a task for each ``share`` of its nodes, one for each resolution at the most."""
    parts = F.least(F.lit(len(gammas)), F.ceil(F.size("ids") / share).cast("int"))
    rows = graphs.withColumn("parts", parts).drop("ids").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.withColumn("gammas", F.filter(F.array(*[F.lit(float(g)) for g in gammas]), lambda _, k: k % F.col("parts") == F.col("part")))
    kinds = f"{_keys(graphs, by)}, gamma double, {', '.join(f'{x} double' for x in _STATISTICS)}, nodes long, runs array<array<int>>"
    names = [*by, "gamma", *_STATISTICS, "nodes", "runs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                arcs = _arcs(r.graph)
                known, out = {}, []
                for g, runs in zip(r.gammas, r.found):
                    out.append({"gamma": float(g), "runs": runs} | statistics(runs, *arcs, known) | {k: getattr(r, k) for k in by})
                yield pd.DataFrame(out, columns=names)

    made = _communities("graph", F.col("gammas"), seeds, graphs.sparkSession)
    return _spread(rows, *by, "part").withColumn("found", made).mapInPandas(run, kinds)


#: The columns of ``run_statistics`` without the number of nodes.
_STATISTICS = ("mean_sep", "mean_density_std", "mean_clusters", "median_clusters", "mean_singletons", "mean_tiny", "mean_size_cv", "mean_ari")


def run_statistics(runs: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, gamma, nodes, mean_ari, mean_sep, mean_density_std, mean_clusters, median_clusters, mean_singletons, mean_tiny, mean_size_cv)
    of clusterings (by, gamma, seed, id, label): means over the seeds; the density deviation's over the finite ones."""
    per = [*by, "gamma", "seed"]
    one = clusters.size_stats(runs, per).join(clusters.quality(clusters.weight_densities(weights, runs, per), per), per)
    finite = F.when(F.col("density_std") < float("inf"), F.col("density_std"))
    stats = one.groupBy(*by, "gamma").agg(
        F.avg("separation").alias("mean_sep"),
        F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("mean_density_std"),
        F.avg("clusters").alias("mean_clusters"),
        F.median("clusters").alias("median_clusters"),
        F.avg("singletons").alias("mean_singletons"),
        F.avg("tiny").alias("mean_tiny"),
        F.avg("size_cv").alias("mean_size_cv"),
    )
    n = runs.groupBy(*by, "gamma").agg(F.count_distinct("id").alias("nodes"))
    return stats.join(clusters.mean_pairwise_rand(runs, [*by, "gamma"]), [*by, "gamma"]).join(n, [*by, "gamma"])


def scored(stats: DataFrame, by: list[str], least: int, ratio: float) -> DataFrame:
    """Adds ``score`` and ``best`` (the least resolution of the highest score) to ``run_statistics``.

    Stability and separation are scaled over a group's resolutions; the number of clusters should lie
    between ``least`` and ``ratio`` of the nodes (at least 2)."""
    over = Window.partitionBy(*by)
    most = F.greatest(F.lit(2), F.floor(F.lit(ratio) * F.col("nodes")))

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    dens = F.col("mean_density_std")
    top = F.max(F.when(dens < float("inf"), dens)).over(over)
    t = stats.withColumn("__d", F.when(dens < float("inf"), dens).otherwise(F.coalesce(top, F.lit(1.0))))
    score = clusters.composite(
        clusters.min_max(F.col("mean_ari"), over),
        clusters.min_max(F.col("mean_sep"), over),
        0.5 * F.col("mean_singletons") + 0.5 * F.col("mean_tiny"),
        clip((F.col("mean_clusters") - most) / F.greatest(F.lit(1), most)),
        clip((F.lit(least) - F.col("mean_clusters")) / max(1, least)),
        clip(F.col("mean_size_cv") - 1.0),
        clusters.min_max(F.col("__d"), over),
    )
    t = t.withColumn("score", F.round(score, 9)).drop("__d")
    first = F.row_number().over(over.orderBy(F.desc("score"), "gamma"))
    return t.withColumn("best", first == 1)


def consensus(runs: DataFrame, weights: DataFrame, by: list[str], tau: float, gamma: float = 0.1, seed: int = 2025, merge: bool = False, limit: int = LIMIT) -> DataFrame:
    """(by, id, label): one clustering of each group from several (by, seed, id, label): CPM on the pairs that at least
    ``tau`` of them keep together; with ``merge``, clusters of one then join others by ``weights``.

    Groups over ``limit`` nodes are agreed along their weights only, by joins, and not merged."""
    size = small_groups(runs, by, limit)
    few, many = size.where("small").drop("small"), size.where("not small").drop("small")
    labels = runs.join(few, by, "left_semi").groupBy(*by, "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]).alias("l"))
    labels = labels.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "l"))), lambda x: x["l"]).alias("runs"))
    small = _consensus_rows(stored(runs.join(few, by, "left_semi"), weights.join(few, by, "left_semi"), by).join(labels, by), by, tau, gamma, seed, merge)
    if many.isEmpty():
        return small
    far = runs.join(many, by, "left_semi").withColumnRenamed("seed", "run")
    edges = weights.join(many, by, "left_semi").select(*by, F.col("i").alias("src"), F.col("j").alias("dst"))
    kept = clusters.agreeing(far, edges, by, tau).select(*by, "src", "dst", F.col("f").alias("w"))
    got = clusters.cpm_communities(kept, by, gamma, seed).select(*by, F.col("id").cast("long").alias("id"), "label")
    alone = far.select(*by, F.col("id").cast("long").alias("id")).distinct().join(got, [*by, "id"], "left")
    return small.unionByName(alone.select(*by, "id", F.coalesce(F.col("label").cast("long"), "id").alias("label")))


def _consensus_rows(rows: DataFrame, by: list[str], tau: float, gamma: float, seed: int, merge: bool) -> DataFrame:
    """``consensus`` of groups that are one row each: ``stored`` with ``runs``, the labels of each by the order of ids."""

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [agreement([list(x) for x in runs], tau) for runs in b["runs"]]
            yield b[[*by, "ids", "graph"]].assign(whole=[f[0] for f in found], pairs=[_stored(len(f[1]), *f[2:], f[1]) for f in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                label = _dense(r.found[0][0][r.whole].tolist())
                if merge:
                    label = _dense(merged_small(label, *_arcs(r.graph)))
                out = pd.DataFrame({"id": r.ids, "label": np.asarray(label, np.int64)})
                for k in by:
                    out[k] = getattr(r, k)
                yield out[[*by, "id", "label"]]

    pairs = _spread(rows, *by).mapInPandas(agree, f"{_keys(rows, by)}, ids array<long>, graph binary, whole array<int>, pairs binary")
    made = _communities("pairs", F.array(F.lit(float(gamma))), [seed], rows.sparkSession)
    return pairs.withColumn("found", made).mapInPandas(run, f"{_keys(rows, by)}, id long, label long")


def best_clustering(nodes: DataFrame, weights: DataFrame, by: list[str], gammas: list[float], seeds: list[int], *, least: int, ratio: float, tau: float, gamma: float = 0.1, merge: bool = False, limit: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """((by, id, label), scored resolutions): the consensus of each group's best resolution.

    A group of one node has one cluster and no resolutions; an empty one has no rows. Groups of every size are
    worked on in the same way; ``limit`` only tells how many nodes a task gets before a group's resolutions are spread."""
    sizes = nodes.select(*by, "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    plural = nodes.select(*by, "id").distinct().join(sizes.where("n > 1").drop("n"), by, "left_semi")
    graphs = cut(stored(plural, weights, by))
    own = cut(_graded(graphs, by, gammas, seeds, limit))
    results = cut(scored(own.drop("runs"), by, least, ratio))
    best = results.where("best").select(*by, "gamma")
    labels = _consensus_rows(graphs.join(own.join(best, [*by, "gamma"]).select(*by, "runs"), by), by, tau, gamma, 2025, merge)
    single = nodes.select(*by, F.col("id").cast("long").alias("id")).distinct().join(sizes.where("n = 1").drop("n"), by, "left_semi").withColumn("label", F.lit(0).cast("long"))
    return labels.unionByName(single), results
