import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arcloom.operators import clusters
from arcloom.operators import resolution as res
from arcloom.tables import cut


def cliques(k, n, extra=()):
    e = [(c * n + a, c * n + b, 1.0) for c in range(k) for a in range(n) for b in range(a)]
    return e + [(a, b, w) for a, b, w in extra]


def brute_quality(n, e, label, gamma):
    inside = sum(w for a, b, w in e if label[a] == label[b])
    return inside - gamma * sum(label.count(c) * (label.count(c) - 1) / 2 for c in set(label))


def all_partitions(n):
    def grow(label):
        if len(label) == n:
            yield label
            return
        for c in range(max(label, default=-1) + 2):
            yield from grow([*label, c])

    return grow([])


def test_optimum_of_small_graphs():
    rnd = random.Random(3)
    for trial in range(12):
        n = 7
        e = [(a, b, float(rnd.randrange(1, 5))) for a in range(n) for b in range(a) if rnd.random() < 0.45]
        for gamma in (0.3, 1.1):
            best = max(brute_quality(n, e, p, gamma) for p in all_partitions(n))
            got = [res.optimised(n, *zip(*e), gamma, s) if e else res.optimised(n, [], [], [], gamma, s) for s in range(4)]
            for label, q in got:
                assert q == pytest.approx(brute_quality(n, e, label, gamma)) and label == res._dense(label)
            assert max(q for _, q in got) == pytest.approx(best)


def test_cliques_and_objectives():
    e = cliques(4, 6, [(0, 6, 0.4), (6, 12, 0.4), (12, 18, 0.4)])
    for objective, gamma in (("CPM", 0.5), ("RB", 1.0)):
        label, _ = res.optimised(24, *zip(*e), gamma, 7, objective)
        assert label == [v // 6 for v in range(24)]
    assert res.optimised(3, [], [], [], 0.5, 1)[0] == [0, 1, 2] and res.optimised(0, [], [], [], 0.5, 1)[0] == []
    with pytest.raises(ValueError):
        res.optimised(3, [], [], [], 0.5, 1, "other")


def test_agreed_and_merged():
    runs = [[0, 0, 0, 1, 1], [0, 0, 1, 1, 1], [0, 0, 0, 1, 1]]
    assert res.agreed(runs, 0.6, 0.1, 1) == [0, 0, 0, 1, 1]
    # the lone node goes to the heavier neighbour; without weights to the lowest label; not below the bound
    e = [(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0), (4, 2, 0.5), (2, 4, 0.5)]
    assert res.merged_small([0, 0, 1, 1, 2], *zip(*e)) == [0, 0, 1, 1, 1]
    assert res.merged_small([0, 0, 1, 1, 2], *zip(*e[:4])) == [0, 0, 1, 1, 0]
    assert res.merged_small([0, 0, 1, 1, 2], *zip(*e), accept=0.9) == [0, 0, 1, 1, 2]
    assert res.merged_small([3], [], [], []) == [3]


def test_agreement_does_not_pair_nodes_that_no_run_tells_apart():
    n = 20_000  # 10 ** 8 pairs
    runs = [[v % 2 for v in range(n)]] * 7 + [[v % 4 for v in range(n)]]
    assert res.agreed(runs, 0.6, 0.1, 1) == [v % 2 for v in range(n)]
    assert res.agreed(runs, 1.0, 0.1, 1) == [v % 4 for v in range(n)]


def test_large_groups_are_optimised_in_one_task(spark):
    n = 3200
    w = spark.range(n).select(F.lit(1).alias("repo"), F.col("id").alias("i"), F.col("id").bitwiseXOR(F.lit(1)).alias("j"), F.lit(1.0).alias("w"))
    nodes = spark.range(n).select(F.lit(1).alias("repo"), "id")
    runs = res.partitions(nodes, w, ["repo"], [0.5], [1, 2, 3])
    assert runs.where("label = floor(id / 2)").count() == 3 * n  # by first member: not one by joins
    assert res.consensus(runs.drop("gamma"), w, ["repo"], 0.6).where("label = floor(id / 2)").count() == n


def test_grid_is_logarithmic():
    g = res.grid(0.05, 0.6, 25)
    assert g[0] == 0.05 and g[-1] == 0.6 and len(g) == 25 and all(math.isclose(g[k] ** 2, g[k - 1] * g[k + 1], rel_tol=1e-6) for k in range(1, 24))


def test_best_clustering_finds_planted_groups_by_both_ways(spark):
    e = cliques(3, 5, [(0, 5, 0.2), (5, 10, 0.2)])
    rows = [("r", a, b, w) for a, b, w in e] + [("r", b, a, w) for a, b, w in e] + [("s", 1, 2, 1.0), ("s", 2, 1, 1.0)]
    w = spark.createDataFrame(rows, "repo string, i int, j int, w double")
    nodes = spark.createDataFrame([("r", v) for v in range(15)] + [("s", 1), ("s", 2), ("s", 2), ("one", 9)], "repo string, id int")
    for limit in (1000, 1):
        labels, results = res.best_clustering(nodes, w, ["repo"], [0.3, 0.6], [1, 2], least=2, ratio=0.5, tau=0.6, merge=True, limit=limit)
        got = {(r["repo"], r["id"]): r["label"] for r in labels.collect()}
        assert len(got) == 18
        for a, b in itertools.combinations(range(15), 2):
            assert (got["r", a] == got["r", b]) == (a // 5 == b // 5)
        assert got["s", 1] == got["s", 2] and got["one", 9] == 0
        top = [r for r in results.collect() if r["best"]]
        assert sorted(r["repo"] for r in top) == ["r", "s"] and results.count() == 4
    assert res.best_clustering(nodes.limit(0), w.limit(0), ["repo"], [0.3], [1], least=2, ratio=0.5, tau=0.6)[0].count() == 0


def test_best_clustering_does_not_depend_on_how_its_work_is_split(spark):
    rnd = np.random.default_rng(2)
    rows = {(int(a), int(b)): float(x) for a, b, x in zip(rnd.integers(0, 40, 90), rnd.integers(0, 40, 90), rnd.random(90)) if a < b}
    w = spark.createDataFrame([("r", *e, x) for (a, b), x in rows.items() for e in ((a, b), (b, a))], "repo string, i int, j int, w double")
    nodes = spark.createDataFrame([("r", v) for v in range(41)], "repo string, id int")
    got = []
    for limit in (1000, 7, 1):
        labels, results = res.best_clustering(nodes, w, ["repo"], [0.1, 0.3, 0.6], [1, 2], least=2, ratio=0.5, tau=0.6, merge=True, limit=limit)
        got.append((sorted(labels.collect()), sorted(results.collect())))
    assert got[0] == got[1] == got[2]
    # the way on which small groups went: labels by first member, clusters of one join others by their weights
    best = next(r["gamma"] for r in got[0][1] if r["best"])
    e = sorted((a, b, x) for (i, j), x in rows.items() for a, b in ((i, j), (j, i)))
    runs = [res.optimised(41, *zip(*e), best, s)[0] for s in (1, 2)]
    assert [r["label"] for r in got[0][0]] == res._dense(res.merged_small(res.agreed(runs, 0.6, 0.1, 2025), *zip(*e)))


def test_stored_graphs_have_the_order_of_adjacent():
    rnd = random.Random(6)
    for n, m in ((1, 0), (5, 3), (30, 200)):
        e = sorted((rnd.randrange(n), rnd.randrange(n), rnd.choice((0.0, 0.5, rnd.random()))) for _ in range(m))  # loops, pairs given twice or in one direction, weights of 0
        src, dst, w = (np.array(x, t) for x, t in zip(zip(*e) if e else ((), (), ()), (np.int64, np.int64, np.float64)))
        want = [(v, u, x) for v, near in enumerate(res.adjacent(n, src, dst, w)) for u, x in near.items()]
        assert list(zip(*(x.tolist() for x in res._arcs(res._stored(n, src, dst, w))))) == want


def test_statistics_by_hand(spark):
    w = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 2, 3, 0.5), (1, 3, 2, 0.5)], "g int, i int, j int, w double")
    runs = spark.createDataFrame([(1, 0.1, s, i, l) for s, ls in ((1, [0, 0, 1]), (2, [0, 1, 2])) for i, l in zip((1, 2, 3), ls)], "g int, gamma double, seed int, id int, label int")
    r = res.run_statistics(runs, w, ["g"]).first()
    assert r["nodes"] == 3 and r["mean_clusters"] == 2.5 and r["mean_singletons"] == 0.75 and r["mean_tiny"] == 1.0
    assert r["mean_sep"] == pytest.approx((1.0 - 0.25) / 2) and r["mean_density_std"] == 0.0 and r["mean_ari"] == pytest.approx(0.0)
    alone = res.run_statistics(runs.where("seed = 2"), w, ["g"]).first()
    assert alone["mean_density_std"] == float("inf") and alone["mean_ari"] == 1.0


def test_statistics_in_one_task_equal_those_by_joins(spark):
    rnd = np.random.default_rng(8)
    rows = [(g, int(a), int(b), float(x)) for g, n in ((1, 40), (2, 3), (3, 150)) for a, b, x in zip(rnd.integers(0, n, 4 * n), rnd.integers(0, n, 4 * n), rnd.random(4 * n))]
    w = spark.createDataFrame(rows, "g int, i int, j int, w double").where("i <> j")
    w = cut(w.unionByName(w.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("g", "i", "j").agg(F.max("w").alias("w")))
    nodes = spark.createDataFrame([(g, v) for g, n in ((1, 41), (2, 3), (3, 150), (4, 2)) for v in range(n)], "g int, id int")
    args = nodes, w, ["g"], [0.1, 0.4, 1.5], [1, 2, 3]
    one, many = res.graded(*args), res.run_statistics(res.partitions(*args), w, ["g"])
    got = {(r["g"], r["gamma"]): r.asDict() for r in one.drop("runs").collect()}
    want = {(r["g"], r["gamma"]): r.asDict() for r in many.collect()}
    assert set(got) == set(want) and len(got) == 12 and dict(one.drop("runs").dtypes) == dict(many.dtypes)
    for k, x in want.items():
        assert got[k] == pytest.approx(x)
    runs = {(r["g"], r["gamma"], s + 1, v): x for r in one.select("g", "gamma", "runs").collect() for s, l in enumerate(r["runs"]) for v, x in enumerate(l)}
    assert runs == {(r["g"], r["gamma"], r["seed"], r["id"]): r["label"] for r in res.partitions(*args).collect()}


def test_min_max_leaves_out_what_is_not_finite(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", float("inf")), ("a", float("nan")), ("b", 2.0), ("b", 2.0), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = [(r["g"], r["x"], r["m"]) for r in df.withColumn("m", clusters.min_max(F.col("x"), Window.partitionBy("g"))).collect()]
    assert sorted(m for g, _, m in got if g == "a" and not math.isnan(m)) == [0.0, 1.0] and sum(math.isnan(m) for g, _, m in got if g == "a") == 2
    assert all(m == 0.0 for g, _, m in got if g != "a")


def test_group_weights_equal_the_dense_matrix(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(23, 6))
    link = {(int(a), int(b)) for a, b in rnd.integers(0, 23, (30, 2)) if a != b}
    link |= {(b, a) for a, b in link}
    vec = spark.createDataFrame([(1, i, [float(z) for z in x[i]]) for i in range(23)] + [(2, 0, [1.0]), (2, 1, [])], "repo int, id int, vec array<double>")
    links = spark.createDataFrame([(1, a, b) for a, b in link], "repo int, i int, j int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (1 + u @ u.T) / 2
    np.fill_diagonal(s, 0)
    a = np.zeros((23, 23))
    for i, j in link:
        a[i, j] = 1
    full = 0.4 * s / s.max() + 0.6 * a
    keep = np.zeros_like(full)
    for i in range(23):
        top = sorted((j for j in range(23) if j != i), key=lambda j: (-round(full[i, j], 9), j))[:4]
        keep[i, top] = full[i, top]
    want = np.maximum(keep, keep.T)
    got = np.zeros_like(full)
    for r in clusters.group_weights(vec, links, ["repo"], 0.4, 4, block=7).where("repo = 1").collect():
        got[r["i"], r["j"]] = r["w"]
    assert np.allclose(got, want)


def test_names_are_encoded_by_an_injected_model(spark):
    df = spark.createDataFrame([(1, "OrderService"), (2, "order_service"), (3, None), (4, "Bicycle")], "id int, name string").withColumn("vec", F.lit(1))
    got = {r["id"]: r["vec"] for r in res.encoded(df, ["id"], "name").collect()}
    assert got[1] == got[2] != got[4] and not any(got[3])
    one = res.encoded(df, ["id"], "name", lambda: lambda texts: np.array([[len(t)] for t in texts]))
    assert {r["id"]: r["vec"] for r in one.collect()} == {1: [12.0], 2: [13.0], 3: [0.0], 4: [7.0]}


def test_optimiser_in_the_jvm_gives_the_labels_of_the_one_in_python(spark):
    rnd = random.Random(4)
    gammas, seeds, graphs = [0.05, 0.3, 1.1], [0, 1, 2025, -7, 2**40], []
    for n in (1, 2, 9, 60, 400):
        e = {(rnd.randrange(n), rnd.randrange(n)): rnd.choice((0.0, 0.25, 0.5, rnd.random())) for _ in range(6 * n)}  # loops, weights of 0, equal ones, some in one direction only
        graphs.append((n, sorted((a, b, w) for (a, b), w in e.items())))
    graphs += [(24, sorted(cliques(4, 6, [(0, 6, 0.4)]))), (3, [])]
    mixed = [[(10 * a - 5, 10 * b - 5, w) for a, b, w in rnd.sample(e, len(e))] for _, e in graphs]
    rows = [(k, [10 * v - 5 for v in range(n)], *(map(list, zip(*m)) if m else (None,) * 3)) for k, ((n, _), m) in enumerate(zip(graphs, mixed))]
    df = spark.createDataFrame(rows, "k int, ids array<long>, a array<long>, b array<long>, w array<double>")
    call = res.java_function(spark, res.OPTIMISER, "arcloom_communities", "array<array<array<int>>>", "ids", "a", "b", "w", F.array(*map(F.lit, gammas)), F.array(*[F.lit(s).cast("long") for s in seeds]))
    got = {r["k"]: r["found"] for r in df.repartition(3).select("k", call.alias("found")).collect()}
    for k, (n, e) in enumerate(graphs):
        assert got[k] == [[res.optimised(n, *(zip(*e) if e else ([], [], [])), g, s)[0] for s in seeds] for g in gammas]


def test_names_are_encoded_once_for_the_weights(spark):
    count = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            count.add(len(texts))
            return np.array([[1.0, len(t)] for t in texts])

        return encode

    df = spark.createDataFrame([(1, i, "x" * i) for i in range(20)], "repo int, id int, name string")
    links = spark.createDataFrame([(1, 0, 19), (1, 19, 0)], "repo int, i int, j int")
    assert clusters.group_weights(res.encoded(df, ["repo", "id"], "name", load), links, ["repo"], 0.5, 3).count() > 0
    assert count.value == 20
