"""Problem 9: mix sources to target shares of the tokens, with capped repeats.

Every text gets a fractional number of copies, the same for all texts of a source: its share of the
largest total that no source's cap forbids. The whole part is taken as it is; the fractions are
rounded by the pivotal method, weighted by size: two texts exchange expected tokens until one
fraction becomes 0 or 1, which keeps the source's expected tokens exactly and every text's expected
copies right on average. Buckets of texts are rounded independently, each leaves one undecided text,
and these go through a reduction tree (the same rounding in groups) until one text a source is left,
which goes to the nearer side; so a source misses its target by half a text at most.

Random draws are hashes of the seed and the texts' ids, so a lost task that runs again decides the
same. A source may hold any part of the rows: texts are combined by (source, text) on the map side,
buckets are bounded, and the tree's groups are, too.

Defined results: records without source or text take no part, nor do empty texts; sources are
compared in lower case without outer blanks; a text counts once (by its least doc_id, and for the
source of that record), so that no text is used more than ``max_repeats`` times; sources without
documents keep a row in the report, and the others' targets are scaled to sum to 1; a null or zero
share or cap selects nothing; sources that are not listed take no part; a source listed more than
once counts once, with its largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.tokens import TOKENIZERS, tokenizer
from arcloom.tables import cut, table

#: Texts a bucket holds on average, and undecided texts a group of the tree holds.
BUCKET = 20_000
GROUP = 64
SEED = 20_240_601


def token_counts(folder: str, name: str):
    """Tokens of a text: a pandas UDF."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(folder, name)
        for s in batches:
            out = []
            for i in range(0, len(s), 512):
                out += [len(e.ids) for e in tok.encode_batch(list(s.iloc[i : i + 512]), add_special_tokens=False)]
            yield pd.Series(out, dtype="int32")

    return count


def sized_texts(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(source, doc_id, tokens): each text once, for the listed source that has it first."""
    listed = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    rows = docs.where(F.col("source").isNotNull() & (F.col("text") != "")).select(F.lower(F.trim("source")).alias("source"), "doc_id", "text").join(F.broadcast(listed), "source")
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")), F.length("text"))
    first = rows.select("source", "doc_id", digest.alias("d")).groupBy("d").agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("doc_id"))
    return rows.select("doc_id", "text").join(first.select("source", "doc_id"), "doc_id").select("source", "doc_id", token_counts(folder, name)("text").alias("tokens")).where("tokens > 0")


def pivot(rows: list[tuple[int, float, float]], seed: int, level: int) -> tuple[list[tuple[int, int]], tuple[int, float, float] | None]:
    """Round fractions: ``rows`` are (id, tokens, fraction). Gives the decided (id, 0 or 1) and the one left over."""
    decided, left = [], None
    for i, size, p in rows:
        if p <= 1e-12 or p >= 1 - 1e-12:
            decided.append((i, int(p > 0.5)))
            continue
        if left is None:
            left = (i, size, p)
            continue
        j, other, q = left
        mass = size * p + other * q
        # either i gives all it can to j, or j to i; in tokens
        up = min(size * p, other * (1 - q))
        down = min(other * q, size * (1 - p))
        if _draw(i, j, seed, level) * (up + down) < down:
            p, q = p - up / size, q + up / other
        else:
            p, q = p + down / size, q - down / other
        open_ = []
        for k, s, x in ((j, other, q), (i, size, p)):
            if x <= 1e-9 or x >= 1 - 1e-9:
                decided.append((k, int(x > 0.5)))
            else:
                open_.append((k, s, x))
        left = open_[0] if open_ else None
        if left is not None:
            rest = mass - sum(s * v for k, s, x in ((j, other, q), (i, size, p)) for v in (x,) if k != left[0])
            left = (left[0], left[1], min(1.0, max(0.0, rest / left[1])))
    return decided, left


def _draw(i: int, j: int, seed: int, level: int) -> float:
    x = (i * 0x9E3779B97F4A7C15 ^ j * 0xC2B2AE3D27D4EB4F ^ (seed + level) * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * m) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 33) / 2**64


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats, texts, tokens, target, copies): what each source is to give. One row a listed source."""
    listed = targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    both = listed.join(have, "source", "left").withColumn("able", (F.col("share") > 0) & (F.col("max_repeats") > 0) & F.col("tokens").isNotNull())
    scale = both.agg(F.sum(F.when(F.col("able"), F.col("share"))).alias("all"))
    total = both.crossJoin(F.broadcast(scale)).agg(F.min(F.when(F.col("able"), F.col("max_repeats") * F.col("tokens") / (F.col("share") / F.col("all")))).alias("total"), F.first("all").alias("all"))
    out = both.crossJoin(F.broadcast(total))  # one row each: the totals
    target = F.when(F.col("able"), F.col("total") * F.col("share") / F.col("all")).otherwise(0.0)
    return out.select("source", "share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), target.alias("target"), F.when(F.col("able"), target / F.col("tokens")).otherwise(0.0).alias("copies"))


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = SEED, bucket: int = BUCKET, group: int = GROUP, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """((source, doc_id, tokens, copies), plan): the selection, with repeats as ``copies``, and what was planned."""
    texts = cut(sized_texts(docs, targets, folder))
    planned = plan(texts, targets)
    want = texts.join(F.broadcast(planned.select("source", "copies", "max_repeats")), "source")
    want = want.withColumn("whole", F.least(F.floor(F.col("copies") + 1e-9), F.col("max_repeats")).cast("int"))
    want = want.withColumn("part", F.when(F.col("whole") >= F.col("max_repeats"), 0.0).otherwise(F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0))))
    n = texts.count()
    buckets = max(1, -(-n // bucket))
    schema = "source string, doc_id long, tokens double, part double, g long, up int"

    def rounding(level: int):
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for source, g, rows in zip(b["source"], b["g"], b["rows"]):
                    decided, left = pivot([(int(r["doc_id"]), float(r["tokens"]), float(r["part"])) for r in rows], seed, level)
                    out += [(source, i, None, None, g, up) for i, up in decided]
                    if left is not None:
                        out.append((source, *left, g, None))
                yield pd.DataFrame(out, columns=["source", "doc_id", "tokens", "part", "g", "up"]).astype({"up": "Int32", "tokens": "float64", "part": "float64"})

        return one

    def level_of(rows: DataFrame, level: int) -> DataFrame:
        packed = rows.groupBy("source", "g").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("o"), "doc_id", "tokens", "part"))).alias("rows"))
        return cut(packed.mapInPandas(rounding(level), schema))

    open_rows = want.where("part > 0").select("source", "doc_id", F.col("tokens").cast("double").alias("tokens"), "part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(buckets)).alias("g"))
    done, level, now = [], 0, level_of(open_rows, 0)
    while True:
        done.append(now.where("up is not null").select("doc_id", "up"))
        rest = now.where("up is null")
        if buckets <= 1:
            break
        buckets, level = -(-buckets // group), level + 1
        now = level_of(rest.select("source", "doc_id", "tokens", "part", F.expr(f"g div {group}").alias("g")), level)
    done.append(rest.select("doc_id", F.when(F.col("part") >= 0.5, 1).otherwise(0).alias("up")))
    ups = done[0]
    for d in done[1:]:
        ups = ups.unionByName(d)
    out = want.join(ups, "doc_id", "left").select("source", "doc_id", "tokens", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("int").alias("copies")).where("copies > 0")
    return out, planned


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selected text once for each of its uses: source, doc_id, use (from 1), tokens."""
    chosen, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))
    return chosen.select("source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("use"), "tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed source's target and actual share of the selected tokens."""
    chosen, planned = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"))
    both = cut(planned.join(got, "source", "left"))
    whole = both.agg(F.sum("chosen").alias("whole"))
    return both.crossJoin(F.broadcast(whole)).select(
        "source",
        F.col("share").alias("target_share"),
        F.round(F.coalesce("chosen", F.lit(0)) / F.col("whole"), 6).alias("actual_share"),
        F.coalesce("chosen", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce("uses", F.lit(0)).cast("long").alias("uses"),
        F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"),
        "max_repeats",
    )


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
