"""Directed graphs as DataFrames: closures, entries, slices, feature graphs, hierarchies.

Arcs are (…group, src, dst[, arc_group, arc_kind, label]); group columns (a repository) keep graphs
apart and are part of every join key. Closures advance all sources of all graphs together, one join a
round, against the arcs and the set already visited; lineage is cut by a checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.tables import cut


#: Rounds after which the fronts of a closure are put together.
PACK = 12


def closure(seeds: DataFrame, arcs: DataFrame, keys: list[str], node: str = "id", depth: str | None = None, rounds: int | None = None) -> DataFrame:
    """Everything reachable from ``seeds`` (keys + node) over ``arcs`` (arc keys + src, dst), seeds included.

    ``keys`` are the seed columns carried along (a slice id, a repository); those that arcs have too
    are joined on. ``depth`` names a column for the number of the round that reached a node. Each round
    writes its front only; what was visited is the union of the fronts, put together every ``PACK``
    rounds, so a closure of n rounds writes its result about n / ``PACK`` times at the most.
    """
    on = [k for k in keys if k in arcs.columns]
    step = cut(arcs.select(*on, F.col("src").alias(node), F.col("dst").alias("__to")).distinct())
    front = cut(seeds.select(*keys, node).where(F.col(node).isNotNull()).distinct().withColumn("__depth", F.lit(0)))
    done, n = front, 0
    while rounds is None or n < rounds:
        n += 1
        reached = front.join(step, [*on, node]).select(*keys, F.col("__to").alias(node)).distinct()
        front = cut(reached.join(done.select(*keys, node), [*keys, node], "left_anti").withColumn("__depth", F.lit(n)), loop=True)
        if front.isEmpty():
            break
        done = done.unionByName(front)
        if n % PACK == 0:
            done = cut(done, loop=True)
    return done.withColumnRenamed("__depth", depth) if depth else done.drop("__depth")


def entries(methods: DataFrame, arcs: DataFrame, keys: list[str], node: str = "id") -> DataFrame:
    """Nodes that no arc points to, abstract and generated ones left out."""
    generated = F.exists(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: a.isin("lombok.Generated", "ltm.Generated"))
    live = methods.where(~F.coalesce("is_abstract", F.lit(False)) & ~generated)
    return live.join(arcs.select(*keys, F.col("dst").alias(node)).distinct(), [*keys, node], "left_anti")


def slice_graph(seeds: DataFrame, vertices: DataFrame, arcs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Slices of a typed graph, all at once: (members: keys + id, role M/F/T), (arcs used: keys + src, dst, arc_kind).

    ``vertices`` (id, kind) and ``arcs`` (src, dst, arc_group, arc_kind); ``keys`` name the slice. The
    rules, to the least fixpoint: methods and fields pull in what they call; methods, fields and
    enums what they use (enums as types, the rest as fields); fields pull in the initialisers that
    define them. Then once: types that methods and fields refer to, and owners; then the parents,
    outer types and annotations of types. Every arc a rule fires on is part of the slice.
    """
    on = [k for k in keys if k in arcs.columns]
    role = vertices.select(*[k for k in on if k in vertices.columns], "id", F.when(F.col("kind").isin("Enum", "Class", "Interface", "Annotation"), "T").when(F.col("kind").isin("Field", "AnnotationMember"), "F").otherwise("M").alias("role"), "kind")
    von = [k for k in on if k in vertices.columns]
    a = arcs.join(role.select(*von, F.col("id").alias("src"), F.col("role").alias("s_role"), F.col("kind").alias("s_kind")), [*von, "src"]).join(
        role.select(*von, F.col("id").alias("dst"), F.col("role").alias("d_role"), F.col("kind").alias("d_kind")), [*von, "dst"]
    )
    code = F.col("s_role").isin("M", "F")
    call = a.where((F.col("arc_kind") == "NormalCall") & code)
    use = a.where((F.col("arc_group") == "UseReference") & (code | (F.col("s_kind") == "Enum")))
    define = a.where((F.col("arc_kind") == "FieldDef") & F.col("s_kind").isin("StaticInitializer", "NormalInitializer")).select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"))
    forward = call.select(*on, "src", "dst").unionByName(use.select(*on, "src", "dst")).unionByName(define)
    core = closure(seeds, forward, keys)
    once = a.where((code & F.col("arc_group").isin("FieldReference", "MethodReference", "AnnotationReference"))).select(*on, "src", "dst")
    owner = a.where(F.col("arc_group") == "MemberArc").where(F.col("d_role").isin("M", "F")).select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"))
    touched = core.join(once.unionByName(owner).withColumnRenamed("src", "id"), [*on, "id"]).select(*keys, F.col("dst").alias("id"))
    types = core.join(role.where("role = 'T'").select(*von, "id"), [*von, "id"], "left_semi").select(*keys, "id").unionByName(touched)
    up = a.where(F.col("arc_group").isin("ParentArc", "InnerArc")).select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = up.unionByName(a.where((F.col("s_role") == "T") & (F.col("arc_group") == "AnnotationReference")).select(*on, "src", "dst"))
    members = cut(core.unionByName(closure(types, up, keys)).distinct())
    named = members.join(role.select(*von, "id", "role"), [*von, "id"], "left")
    both = members.withColumnRenamed("id", "src")
    fired = a.where(
        ((F.col("arc_kind") == "NormalCall") & code)
        | ((F.col("arc_group") == "UseReference") & (code | (F.col("s_kind") == "Enum")))
        | (code & F.col("arc_group").isin("FieldReference", "MethodReference", "AnnotationReference"))
        | ((F.col("s_role") == "T") & (F.col("arc_group") == "AnnotationReference"))
    )
    down = a.where(F.col("arc_group").isin("MemberArc", "ParentArc", "InnerArc"))
    used = both.join(fired.select(*on, "src", "dst", "arc_kind"), [*on, "src"]).select(*keys, "src", "dst", "arc_kind")
    used = used.unionByName(members.withColumnRenamed("id", "dst").join(down.select(*on, "src", "dst", "arc_kind"), [*on, "dst"]).select(*keys, "src", "dst", "arc_kind"))
    return named, used.distinct()


def dispatch(calls: DataFrame, owns: DataFrame, parents: DataFrame) -> DataFrame:
    """(caller, target): a call on a type may reach the type's own or inherited method and every overriding one.

    ``calls`` (caller, type, sig), ``owns`` (type, sig, method), ``parents`` (parent, child).
    """
    up = closure(calls.select(F.col("type").alias("origin"), F.col("type").alias("id")), parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), ["origin"], depth="d")
    nearest = up.join(owns.withColumnRenamed("type", "id"), "id").groupBy("origin", "sig").agg(F.min_by("method", F.struct("d", "id")).alias("target"))
    down = closure(calls.select(F.col("type").alias("origin"), F.col("type").alias("id")), parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")), ["origin"])
    over = down.join(owns.withColumnRenamed("type", "id"), "id").select("origin", "sig", F.col("method").alias("target"))
    to = nearest.unionByName(over).distinct()
    return calls.join(to.withColumnRenamed("origin", "type"), ["type", "sig"]).select("caller", "target").distinct()


def induced(members: DataFrame, arcs: DataFrame, keys: list[str], on: list[str], node: str = "id") -> DataFrame:
    """Arcs with both ends among the members of the same group: two joins on the ends, no pairs of members."""
    out = members.select(*keys, *[k for k in on if k not in keys], F.col(node).alias("src")).join(arcs.select(*on, "src", "dst"), [*on, "src"])
    return out.join(members.select(*keys, *[k for k in on if k not in keys], F.col(node).alias("dst")), [*keys, *[k for k in on if k not in keys], "dst"], "left_semi").select(*keys, "src", "dst")


def dense_ids(df: DataFrame, order: list[str], name: str = "n", start: int = 1) -> DataFrame:
    """Consecutive numbers in a total order without gathering rows: range partitions, counted, then numbered inside."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row a partition: its number of partitions is the cluster's, not the data's
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + inner + (start - 1)).cast("long")).drop("__p", "__before")


def first_match(left: DataFrame, candidates: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Ordered fallback: the value of the first candidate table that knows the row's key.

    Every candidate (table, join columns) is reduced to one row a key (its least value)."""
    tries = []
    for i, (t, on) in enumerate(candidates):
        one = t.groupBy(*on).agg(F.min(value).alias(f"__v{i}"))
        left = left.join(one, on, "left")
        tries.append(f"__v{i}")
    return left.withColumn(value, F.coalesce(*tries)).drop(*tries)
