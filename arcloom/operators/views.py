"""Slices as numbers, what a selection of them touches, and the code and diffs that follow from it.

A selection (the features' slices) is data here, not state: everything is worked out for all
selections together, by joins on the numbers of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.operators.diff import assembled
from arcloom.operators.graph import closure, dense_ids
from arcloom.tables import cut

TYPES = ("Class", "Interface", "Enum", "Annotation")

#: Arcs of a graph whose slices are found in one task, and rows that a task makes of a group's nodes.
ARCS, ROWS = 2_000_000, 2_000_000


def is_type(kind: Column) -> Column:
    """Any type declaration."""
    return kind.isin(*TYPES)


def is_class(kind: Column) -> Column:
    """Classes and interfaces; enums and annotations are no nodes of a feature graph."""
    return kind.isin("Class", "Interface")


def numbered_slices(entries: DataFrame, keys: list[str], node: str = "id") -> DataFrame:
    """(keys, node, slice): entries numbered from 1 in the order of their keys and names."""
    return dense_ids(entries.select(*keys, node).distinct(), [*keys, node], "slice")


def slice_members(numbers: DataFrame, arcs: DataFrame, keys: list[str], node: str = "id") -> DataFrame:
    """(keys, slice, node): everything a slice's entry reaches."""
    return closure(numbers, arcs, [*keys, "slice"], node)


def selected(members: DataFrame, slices: DataFrame, by: str, keys: list[str], node: str = "id") -> DataFrame:
    """(by, keys, slice): the slices of the nodes that a selection (by, keys, node) is made of."""
    return members.join(slices, [*keys, node]).select(by, *keys, "slice").distinct()


def max_graph(choice: DataFrame, slices: DataFrame, arcs: DataFrame, by: str, keys: list[str], node: str = "id") -> tuple[DataFrame, DataFrame]:
    """(nodes: by + keys + node, arcs: by + keys + src, dst) that lie in any selected slice; none where nothing is selected."""
    nodes = choice.join(slices, [*keys, "slice"]).select(by, *keys, node).distinct()
    return nodes, nodes.withColumnRenamed(node, "src").join(arcs.select(*keys, "src", "dst"), [*keys, "src"]).select(by, *keys, "src", "dst")


def touched(choice: DataFrame, slices: DataFrame, by: str, keys: list[str], node: str = "id") -> DataFrame:
    """(by, keys, node, owned): nodes with a selected slice, and whether all their slices are selected."""
    has = slices.groupBy(*keys, node).agg(F.count(F.lit(1)).alias("all"))
    hit = choice.join(slices, [*keys, "slice"]).groupBy(by, *keys, node).agg(F.count(F.lit(1)).alias("some"))
    return hit.join(has, [*keys, node]).select(by, *keys, node, (F.col("some") == F.col("all")).alias("owned"))


def _reached(n: int, src: np.ndarray, dst: np.ndarray, entries: list[int]) -> list[int]:
    """For each of n nodes, the entries (by their place) that reach it, as the bits of a number. Nodes that reach
    each other are found first (Tarjan), so every arc is looked at twice, however many entries there are."""
    first = np.searchsorted(src, np.arange(n + 1)).tolist()
    to = dst.tolist()
    index, low, part, at = [-1] * n, [0] * n, [-1] * n, list(first)
    parts: list[list[int]] = []
    count, stack = 0, []
    for e in entries:
        if index[e] >= 0:
            continue
        path = [e]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            k, end = at[v], first[v + 1]
            while k < end:
                u = to[k]
                if index[u] < 0:
                    path.append(u)
                    break
                if part[u] < 0 and low[u] < low[v]:
                    low[v] = low[u]
                k += 1
            at[v] = k
            if k < end:
                continue
            path.pop()
            if low[v] == index[v]:
                own = []
                while not own or own[-1] != v:
                    own.append(stack.pop())
                    part[own[-1]] = len(parts)
                parts.append(own)
    bits = [0] * len(parts)
    for k, e in enumerate(entries):
        bits[part[e]] |= 1 << k
    for p in range(len(parts) - 1, -1, -1):  # parts come out after those that they reach
        for v in parts[p]:
            for u in to[first[v] : first[v + 1]]:
                if part[u] != p:
                    bits[part[u]] |= bits[p]
    return [bits[p] if p >= 0 else 0 for p in part]


def slice_groups(entries: DataFrame, arcs: DataFrame, keys: list[str], node: str = "id", limit: int = ARCS) -> tuple[DataFrame, DataFrame]:
    """(members: keys + node + group, groups: keys + group, slices, nodes, arcs): nodes that lie in the same slices
    are a group, named by one of them; each group with its slices, and how many nodes and arcs out of them it has.

    ``entries`` (keys, node) start a slice each, ``arcs`` (keys, src, dst) may come more than once. Slices have numbers
    within their graph. Graphs of up to ``limit`` arcs are looked at in one task each, so that what entries
    reach is never written out; larger ones take the closure by joins."""
    e, a = entries.select(*keys, node).where(F.col(node).isNotNull()).distinct(), arcs.select(*keys, "src", "dst")
    many = cut(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys))
    large = not many.isEmpty()
    few_e, few_a = (x.join(F.broadcast(many), keys, "left_anti") if large else x for x in (e, a))

    def grouped(key: tuple, own: pa.Table, out: pa.Table) -> pa.Table:
        names = pa.concat_arrays([c for x in (own[node], out["src"], out["dst"]) for c in x.chunks] or [pa.array([], pa.string())]).dictionary_encode()
        code, names, k = names.indices.to_numpy(), names.dictionary, len(own)
        n = len(names)
        pair = np.unique(code[k : k + len(out)].astype(np.int64) * n + code[k + len(out) :])
        src, dst = pair // max(n, 1), pair % max(n, 1)
        groups: dict[int, list[int]] = {}
        for v, b in enumerate(_reached(n, src, dst, code[:k].tolist())):
            if b:
                groups.setdefault(b, []).append(v)
        degree = np.bincount(src, minlength=n)
        slices = [np.flatnonzero(np.unpackbits(np.frombuffer(b.to_bytes(k // 8 + 1, "little"), np.uint8), bitorder="little")).astype(np.int64) for b in groups]
        ids = [names.take(pa.array(vs, pa.int64())) for vs in groups.values()]
        cols = {x: pa.repeat(key[i], len(groups)) for i, x in enumerate(keys)}
        cols |= {"group": pa.array([x[0].as_py() for x in ids], pa.string()), "slices": pa.array(slices, pa.list_(pa.int64())), "ids": pa.array([x.to_pylist() for x in ids], pa.list_(pa.string()))}
        return pa.table(cols | {"arcs": pa.array([int(degree[vs].sum()) for vs in groups.values()], pa.int64())})

    kinds = ", ".join(f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in keys)
    rows = cut(few_e.groupBy(*keys).cogroup(few_a.groupBy(*keys)).applyInArrow(grouped, f"{kinds}, group string, slices array<long>, ids array<string>, arcs long"))
    members = rows.select(*keys, F.explode("ids").alias(node), "group")
    groups = rows.select(*keys, "group", "slices", F.size("ids").cast("long").alias("nodes"), "arcs")
    if not large:
        return members, groups
    far = a.join(F.broadcast(many), keys, "left_semi").distinct()
    s = slice_members(cut(numbered_slices(e.join(F.broadcast(many), keys, "left_semi"), keys, node)), far, keys, node)
    s = s.groupBy(*keys, node).agg(F.array_sort(F.collect_list("slice")).alias("slices"))
    s = cut(s.withColumn("group", F.min(node).over(Window.partitionBy(*keys, "slices"))))
    out = s.join(far.groupBy(*keys, F.col("src").alias(node)).agg(F.count(F.lit(1)).alias("arcs")), [*keys, node], "left")
    out = out.groupBy(*keys, "group").agg(F.first("slices").alias("slices"), F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("arcs"), F.lit(0)).alias("arcs"))
    return members.unionByName(s.select(*keys, node, "group")), groups.unionByName(out)


def selections(own: DataFrame, members: DataFrame, groups: DataFrame, by: str, keys: list[str], node: str = "id") -> tuple[DataFrame, DataFrame]:
    """(chosen: by, keys, like; hits: keys, like, group, owned): what the slices of the nodes that a selection (by, keys, node)
    is made of hold: whole groups, with whether all slices of a group are selected.

    Selections of nodes in the same groups select the same, so ``hits`` has one of them, ``like``, for all."""
    at = own.join(members, [*keys, node]).groupBy(by, *keys).agg(F.array_sort(F.collect_set("group")).alias("__of"))
    at = cut(at.withColumn("like", F.min(by).over(Window.partitionBy(*keys, "__of"))))
    each = groups.select(*keys, "group", F.explode("slices").alias("slice"))
    asked = at.where(F.col(by) == F.col("like")).select(*keys, "like", F.explode("__of").alias("group"))
    picked = asked.join(each, [*keys, "group"]).select(*keys, "like", "slice").distinct()
    hits = picked.join(each, [*keys, "slice"]).groupBy(*keys, "like", "group").agg(F.count(F.lit(1)).alias("__n"))
    hits = hits.join(groups.select(*keys, "group", F.size("slices").alias("__all")), [*keys, "group"])
    return at.select(by, *keys, "like"), hits.select(*keys, "like", "group", (F.col("__n") == F.col("__all")).alias("owned"))


def held(chosen: DataFrame, hits: DataFrame, members: DataFrame, by: str, keys: list[str], node: str = "id", rows: int = ROWS) -> DataFrame:
    """(by, keys, node): the nodes of ``selections``. The nodes of a group come once for about ``rows`` rows made of them,
    so that no task makes all rows of a group that very many select."""
    at = chosen.join(hits.select(*keys, "like", "group"), [*keys, "like"]).select(by, *keys, "group")
    size = members.groupBy(*keys, "group").agg(F.collect_list(node).alias("__ids"))
    many = at.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("__by"))
    size = size.join(many, [*keys, "group"]).withColumn("__parts", F.ceil(F.col("__by") * F.size("__ids") / rows).cast("int"))
    parts = size.select(*keys, "group", "__ids", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__p"))
    at = at.join(size.select(*keys, "group", "__parts"), [*keys, "group"]).withColumn("__p", F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"))
    return at.join(parts, [*keys, "group", "__p"]).select(by, *keys, F.explode("__ids").alias(node))


def member_code(members: DataFrame, owners: DataFrame, by: str, keep_unbound: bool = False) -> DataFrame:
    """(by, top, origin, rest, members, left): each class's code, and what is left of it without a selection.

    ``members`` (top, member, pos, code), ``owners`` (by, member): who has a member. For every (by, top)
    with a member of its own: a member goes when the selection alone has it; members that nobody has
    go, too, unless ``keep_unbound``. A class without any member left is empty.
    """
    of = members.join(owners.select(by, "member").distinct(), "member", "left")
    count = of.groupBy("member").agg(F.count(by).alias("owners"))
    asked = of.where(F.col(by).isNotNull()).select(by, "top").distinct()
    mine = owners.select(by, "member", F.lit(True).alias("mine")).distinct()
    rows = asked.join(members, "top").join(count, "member").join(mine, [by, "member"], "left")
    alone = F.coalesce("mine", F.lit(False)) & (F.col("owners") == 1)
    gone = alone if keep_unbound else alone | (F.col("owners") == 0)
    rows = cut(rows.select(by, "top", "pos", "code", gone.alias("gone")))
    both = assembled(rows, [by, "top"], "pos", "code", "origin").join(assembled(rows, [by, "top"], "pos", "code", "rest", ~F.col("gone")), [by, "top"])
    n = rows.groupBy(by, "top").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("gone")).alias("left"))
    return both.join(n, [by, "top"])


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type): nodes of the old graph as Default, those that the new one has, too, or alone, as Modify."""
    o, n = old.select(*keys).distinct().withColumn("__o", F.lit(True)), new.select(*keys).distinct().withColumn("__n", F.lit(True))
    return o.join(n, keys, "full").select(*keys, F.when(F.col("__n").isNotNull(), "Modify").otherwise("Default").alias("type"))


def tree_depths(parents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, id, depth): everything below each top of a forest of (keys, parent, id)."""
    tops = parents.select(*keys, F.col("parent").alias("id")).join(parents.select(*keys, "id"), [*keys, "id"], "left_anti").distinct()
    return closure(tops.withColumn("top", F.col("id")), parents.withColumnsRenamed({"parent": "src", "id": "dst"}), [*keys, "top"], depth="depth")


def nested(members: DataFrame, keys: list[str], levels: int | None = None) -> DataFrame:
    """(keys, id, code): code of every outermost class with its inner classes put in, deepest first.

    ``members`` are (keys, id, owner, pos, code): ``owner`` is null at the top. An inner class stands
    after its owner's own code, in the order of ``pos``. One round a level of nesting."""
    up = members.where("owner is not null").select(*keys, F.col("owner").alias("parent"), "id")
    depth = tree_depths(up, keys).groupBy(*keys, "id").agg(F.max("depth").alias("depth"))
    now = cut(members.join(depth, [*keys, "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))))
    deepest = now.agg(F.max("depth")).first()[0] or 0
    for d in range(deepest, 0, -1):
        inner = now.where(F.col("depth") == d).groupBy(*keys, F.col("owner").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "code"))), lambda x: x["code"]), "\n").alias("inner"))
        rest = now.where(F.col("depth") < d).join(inner, [*keys, "id"], "left")
        now = cut(rest.withColumn("code", F.when(F.col("inner").isNotNull(), F.concat_ws("\n", "code", "inner")).otherwise(F.col("code"))).drop("inner"), loop=True)
    return now.select(*keys, "id", "code")


def looked_up(classes: DataFrame, code: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, code): new code of classes, under the full name, else under a name that ends in it (the least such)."""
    exact = code.groupBy(*keys, "id").agg(F.min("code").alias("c1"))
    last = F.substring_index("name", ".", -1)
    part = code.withColumnRenamed("id", "name").withColumn("last", last)
    some = classes.join(exact, [*keys, "id"], "left_anti").select(*keys, "id", F.substring_index("id", ".", -1).alias("last"))
    suffix = some.join(part, [*keys, "last"]).where(F.col("name").endswith(F.concat(F.lit("."), F.col("id"))) | F.col("id").endswith(F.concat(F.lit("."), F.col("name"))))
    by_end = suffix.groupBy(*keys, "id").agg(F.min_by("code", "name").alias("c2"))
    return classes.join(exact, [*keys, "id"], "left").join(by_end, [*keys, "id"], "left").select(*keys, "id", F.coalesce("c1", "c2").alias("code"))


def insert_positions(members: DataFrame, outer: list[str]) -> DataFrame:
    """Adds ``at``: a member's place among its outer class's kept ones (``kept``), by ``pos``."""
    before = Window.partitionBy(*outer).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("at", F.coalesce(F.sum(F.col("kept").cast("long")).over(before), F.lit(0)))
