"""Problem 1: values that lost their end, found by joining prefixes.

A value's last sentence is held against all sentences of the same field: a cut sentence is a strict
prefix of longer copies elsewhere. Names inside the sentences are masked, and prefixes are hashed,
so that copies are found although every copy names other things. Prefixes of the whole sentence up to
here come first, then the same without its last words (signal ``prefix``). Where too few other
values have them, the prefix is thinned out: its first words with its last ones (``parts``), at last
only its last words (``suffix``), which tells whether sentences end so, and is kept apart as a
signal of its own. The first of these that other values attest often enough decides:

* how often it ends a sentence (``ends``) and how often a sentence goes on after it (``goes_on``);
  for a prefix without the last words: how often the sentence ends within a few words, or goes on
  beyond them. Where hardly any sentence ends, the value was cut;
* a final word that occurs nowhere as a whole word and is a strict prefix of one that does was cut
  inside the word (``word``): whole words are taken apart into their prefixes of up to ``LONGEST``
  characters, which are joined with the words in question; longer ones are sorted within prefixes
  of that length and compared with their successors;
* what was appended at the cut (dots, a replacement character) is taken off first. A replacement
  character always means a cut, dots do where ends with that prefix rarely carry them.

Scale: texts are taken apart once; sentences are deduplicated by their masked form before prefixes
are built, only prefixes that some open end asks for are counted (the keys that are asked for are
broadcast up to ``FEW`` of them, beyond that they are joined), and every count is combined on the
map side, so no step gathers a hot value in one task. No global sort.

Defined results: null and blank values are never cases; a value that ends in a full stop is
complete; a value nothing else attests is complete; exact copies count once as evidence and are
all reported; records delivered twice are reported once; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.tables import cut, table

#: Smoothed share of sentence ends below which a prefix counts as the middle of a sentence.
RATIO = 0.15
#: Other values that must attest a prefix, by level (see ``_prefixes``).
SUPPORT = (5, 5, 6, 6, 6, 6, 8, 8, 10, 12)
SIGNAL = ("prefix", "prefix", "parts", "parts", "suffix", "suffix", "suffix", "suffix", "suffix", "suffix")
#: Keys (a long each) that are broadcast.
FEW = 2_000_000
LONGEST = 32

_HAN = r"぀-ヿ㐀-鿿"
_TOKEN = r"[A-Za-z0-9_]+(?:['’-][A-Za-z0-9_]+)*|[^\sA-Za-z0-9_]"
_CAMEL = r"^[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*$"
_MARK = r"(?:\s*[\[(]?(?:\.{3,}|…+)[\])]?|�+)\s*$"
_WORD = r"^[A-Za-z0-9_'’-]+$"
_STOP = r"[.!?。！？]+[\"”’」』)）]*$"
_SPLIT = r"(?<=[.!?])\s+|(?<=[。！？])"


def _key(token: Column) -> Column:
    """A word as it counts for being whole: of a compound name, its case and its last part."""
    camel = token.rlike(_CAMEL)
    return F.when(camel, F.concat(F.when(token.rlike("^[A-Z]"), "U:").otherwise("l:"), F.regexp_extract(token, r"([A-Z][a-z0-9]*|[A-Z]+)$", 1))).otherwise(token)


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike(_CAMEL), F.lit("Ξ")).when(t.rlike(r"^\d+$"), F.lit("9")).otherwise(t))


def _prefixes(toks: Column, j: Column, han: Column) -> Column:
    """The prefixes of position ``j`` (from 1) that ask for an end right here, hashed."""
    first, last = F.when(han, 3).otherwise(2), F.when(han, 6).otherwise(3)
    short = F.when(han, 4).otherwise(2)

    def tail(n: Column) -> Column:
        n = F.least(n, j)
        return F.slice(toks, j - n + 1, n)

    keys = {
        1: [F.slice(toks, F.lit(1), j)],
        3: [F.slice(toks, F.lit(1), F.least(first, j)), tail(last)],
        5: [F.slice(toks, F.lit(1), F.lit(1)), tail(last)],
        8: [F.slice(toks, F.lit(1), F.lit(1)), tail(short)],
        9: [tail(short)],
        10: [tail(F.when(han, 2).otherwise(1))],
    }
    return _levels(keys)


def _open_prefixes(toks: Column, j: Column, han: Column) -> Column:
    """The prefixes of position ``j`` that ask for an end within a few words, hashed."""

    def tail(n: Column) -> Column:
        n = F.least(n, j)
        return F.slice(toks, j - n + 1, n)

    return _levels({2: [F.slice(toks, F.lit(1), j)], 6: [tail(F.when(han, 5).otherwise(3))], 7: [tail(F.when(han, 4).otherwise(2))]})


def _place(toks: Column, j: Column) -> Column:
    """The first two words and the number of words: do sentences that begin so end about here?"""
    return _levels({4: [F.slice(toks, F.lit(1), F.least(F.lit(2), j)), j]})


def _levels(keys: dict[int, list[Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("level"), F.xxhash64(F.lit(n), *k).alias("key")) for n, k in keys.items()])


def sentences_of(values: DataFrame) -> DataFrame:
    """Adds the mark taken off, and the sentences as structs (raw tokens, stopped)."""
    core = values.withColumn("mark", F.regexp_extract(F.rtrim("value"), _MARK, 0)).withColumn("core", F.rtrim(F.regexp_replace(F.rtrim("value"), _MARK, "")))
    split = core.withColumn("parts", F.filter(F.split("core", _SPLIT), lambda s: F.trim(s) != ""))
    taken = F.transform("parts", lambda s: F.struct(F.regexp_extract_all(F.regexp_replace(s, _STOP, ""), F.lit(_TOKEN), F.lit(0)).alias("r"), s.rlike(_STOP).alias("stopped")))
    return split.withColumn("sents", taken).drop("core", "parts")


def find_truncated(values: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(table_name, row_id, field_name, loader, length, cut, signal, longer, copy_id) of ``values`` (table_name, row_id,
    field_name, loader, value): whether the value was cut, what tells so, how many values go on after the
    same prefix, and the least row id of one of them (of signals ``prefix``, ``parts`` and ``suffix``)."""
    field = ["table_name", "field_name"]
    mark = F.when(F.col("mark").contains("�"), 2).when(F.col("mark") != "", 1).otherwise(0)
    taken = sentences_of(values.where(F.trim("value") != "")).withColumn("mark", mark)
    whole = cut(taken.select(*field, "row_id", "loader", F.length("value").alias("length"), F.md5("value").alias("text"), "mark", "sents"))
    end = F.try_element_at("sents", F.lit(-1))
    raw = F.try_element_at(end["r"], F.lit(-1))
    stopped = F.coalesce(end["stopped"], F.lit(True))
    rows = whole.select(*field, "row_id", "loader", "length", "mark", F.xxhash64(_masked(end["r"]), raw).alias("end_key"), F.when(~stopped & raw.rlike(_WORD), raw).alias("last_word"), stopped.alias("stopped"))

    # one row for each masked sentence, with the number of different values that have it
    distinct = cut(whole.groupBy(*field, "text").agg(F.min(F.struct("row_id", "mark", "sents")).alias("v")).select(*field, "v.*", F.size("v.sents").alias("ns")))
    said = cut(
        # the number of sentences is a column already: computed here, it would carry all of them into each row
        distinct.select(*field, "row_id", "mark", "ns", F.posexplode("sents").alias("at", "s"))
        .withColumn("last", F.col("at") == F.col("ns") - 1)
        .select(*field, "row_id", _masked(F.col("s.r")).alias("toks"), F.try_element_at("s.r", F.lit(-1)).alias("raw"), (F.col("last") & ~F.col("s.stopped")).alias("open"), F.when(F.col("last"), F.col("mark")).otherwise(0).alias("mark"))
        .where(F.size("toks") > 0)
        .groupBy(*field, "toks", "raw", "open", "mark")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    )
    size = F.size("toks")
    han = F.col("raw").rlike(f"[{_HAN}]") | F.exists("toks", lambda t: t.rlike(f"[{_HAN}]"))
    at_field = F.xxhash64(*field)

    def of_field(p: Column) -> Column:
        return F.xxhash64(at_field, p["key"])

    open_ends = said.where(F.col("open") | (F.col("mark") > 0)).withColumn("han", han).withColumn("end_key", F.xxhash64("toks", "raw"))
    back = size - F.when(F.col("han"), 4).otherwise(2)
    asks = F.concat(_prefixes(F.col("toks"), size, F.col("han")), _place(F.col("toks"), size), F.when(back > 0, _open_prefixes(F.col("toks"), F.greatest(back, F.lit(1)), F.col("han"))).otherwise(F.array()))
    tries = cut(open_ends.select(*field, "end_key", "mark", F.explode(asks).alias("p")).select(*field, "end_key", "mark", "p.level", of_field(F.col("p")).alias("key")))
    keys = tries.select("key").distinct()
    if tries.count() <= FEW:
        keys = F.broadcast(keys)

    at = said.withColumn("han", han).select(*field, "toks", "mark", "n", "row_id", "han", F.explode(F.sequence(F.lit(1), size)).alias("j"))
    left = size - F.col("j")
    near = F.when(F.col("han"), 6)
    ends = F.create_map(*[x for k, e in enumerate((left == 0, left <= near.otherwise(2), left <= near.otherwise(3))) for x in (F.lit(k), e)])
    kind = F.when(F.col("p.level").isin(2, 6, 7), 1).when(F.col("p.level") == 4, 2).otherwise(0)
    every = F.concat(_prefixes(F.col("toks"), F.col("j"), F.col("han")), _open_prefixes(F.col("toks"), F.col("j"), F.col("han")), _place(F.col("toks"), F.col("j")))
    asked = at.select("n", "row_id", "mark", ends.alias("e"), at_field.alias("__f"), F.explode(every).alias("p"))
    asked = asked.select("n", "row_id", "mark", F.col("e")[kind].alias("ends"), F.xxhash64("__f", "p.key").alias("key")).join(keys, "key", "left_semi")
    seen = asked.groupBy("key").agg(
        F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("ends"),
        F.sum(F.when(F.col("ends"), 0).otherwise(F.col("n"))).alias("goes_on"),
        F.sum(F.when(F.col("ends") & (F.col("mark") > 0), F.col("n")).otherwise(0)).alias("marked"),
        F.min(F.when(~F.col("ends"), F.col("row_id"))).alias("copy_id"),
    )
    others = F.col("ends") + F.col("goes_on") - 1
    enough = reduce(lambda c, x: c.when(F.col("level") == x[0], others >= x[1]), enumerate(SUPPORT, 1), F.when(F.lit(False), F.lit(False)))
    judged = (
        tries.join(seen, "key")
        .where(enough & ((F.col("level") != 4) | (F.col("ends") >= 0.9 * (F.col("ends") + F.col("goes_on")))))
        .groupBy(*field, "end_key", "mark")
        .agg(F.min_by(F.struct("level", "ends", "goes_on", "marked", "copy_id"), "level").alias("e"))
        .select(
            *field,
            "end_key",
            "mark",
            F.element_at(F.array(*[F.lit(x) for x in SIGNAL]), F.col("e.level")).alias("how"),
            F.col("e.goes_on").alias("longer"),
            F.col("e.copy_id").alias("copy_id"),
            (F.col("e.ends") / (F.col("e.ends") + F.col("e.goes_on") + 1) < ratio).alias("inside"),
            ((F.col("mark") == 1) & (F.col("e.marked") < 0.5 * F.col("e.ends"))).alias("odd_mark"),
        )
    )
    got = rows.join(judged, [*field, "end_key", "mark"], "left").join(_cut_words(rows, distinct, field), [*field, "last_word"], "left")
    within = F.coalesce("inside", F.lit(False)) & ~F.col("stopped")
    signal = (
        F.when(within & (F.col("how") != "suffix"), F.col("how"))
        .when((F.col("mark") == 2) | (F.coalesce("odd_mark", F.lit(False)) & ~F.col("stopped")), "mark")
        .when(~F.col("stopped") & F.coalesce("part", F.lit(False)), "word")
        .when(within, "suffix")
    )
    out = got.withColumn("signal", signal)
    joined = F.col("signal").isin("prefix", "parts", "suffix")
    return out.select("table_name", "row_id", "field_name", "loader", "length", F.col("signal").isNotNull().alias("cut"), "signal", F.when(joined, F.col("longer")).alias("longer"), F.when(joined, F.col("copy_id")).alias("copy_id"))


def _cut_words(rows: DataFrame, distinct: DataFrame, field: list[str]) -> DataFrame:
    """(field, last_word, part): last words that are only the beginning of a word."""
    # every word that is not the last of an open end is whole
    tokens = F.flatten(F.transform("sents", lambda s: s["r"]))
    closed = F.element_at("sents", -1)["stopped"] & (F.col("mark") == 0)
    whole = (
        distinct.where(F.size("sents") > 0)
        .withColumn("w", tokens)
        .select(*field, F.explode(F.when(closed, F.col("w")).otherwise(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))).alias("w"))
        .where(F.col("w").rlike(_WORD))
        .distinct()
    )
    whole = cut(whole)
    asked = rows.where(F.col("last_word").isNotNull()).select(*field, F.col("last_word").alias("w")).distinct()
    keys = whole.select(*field, _key(F.col("w")).alias("k")).distinct()
    unknown = cut(asked.withColumn("k", _key(F.col("w"))).join(keys, [*field, "k"], "left_anti").select(*field, "w"))
    # a compound name's parts and the name itself are what a cut word may have been
    longer = whole.select(*field, "w").unionByName(whole.where(F.col("w").rlike(_CAMEL)).select(*field, F.regexp_extract("w", r"([A-Z][a-z0-9]*)$", 1).alias("w"))).where(F.length("w") > 1)
    sizes = F.sequence(F.lit(1), F.least(F.length("w") - 1, F.lit(LONGEST)))
    begins = longer.select(*field, F.explode(F.transform(sizes, lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("w")).distinct()
    parts = unknown.where(F.length("w") <= LONGEST).join(begins, [*field, "w"], "left_semi")
    pool = unknown.select(*field, "w", F.lit(True).alias("asked")).unionByName(longer.select(*field, "w", F.lit(False).alias("asked"))).where(F.length("w") > LONGEST).withColumn("p", F.substring("w", 1, LONGEST))
    one = pool.groupBy(*field, "p", "w").agg(F.bool_or("asked").alias("asked"))
    after = F.lead("w").over(Window.partitionBy(*field, "p").orderBy("w"))
    far = one.withColumn("after", after).where(F.col("asked") & F.col("after").startswith(F.col("w"))).select(*field, "w")
    return parts.select(*field, "w").unionByName(far).select(*field, F.col("w").alias("last_word"), F.lit(True).alias("part"))


def project_fields(features: DataFrame, modules: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str, field: str) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.lit(field).alias("field_name"), "loader", F.col(field).alias("value"))

    parts = [of(features, "features", "feature_desc"), of(features, "features", "feature_desc_cn"), of(modules, "modules", "module_desc")]
    return reduce(DataFrame.unionByName, parts)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(project_fields(table(spark, sf_dir, "features"), table(spark, sf_dir, "modules")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where("cut").select("table_name", "row_id", "field_name").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field and loader truncates, and the length at which most of its cuts lie."""
    one = _found(spark, sf_dir).dropDuplicates(["table_name", "row_id", "field_name"])
    return one.groupBy("table_name", "field_name", "loader").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("cut").alias("n_cut"),
        F.round(F.count_if("cut") / F.count(F.lit(1)), 4).alias("rate"),
        F.mode(F.when(F.col("cut"), F.col("length")), deterministic=True).alias("usual_length"),
    )


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every damaged field what tells so, how many values go on after the same prefix, and one of them."""
    return _found(spark, sf_dir).where("cut").select("table_name", "row_id", "field_name", "signal", "longer", "copy_id").dropDuplicates(["table_name", "row_id", "field_name"])


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_evidence": p1_evidence}
ORACLE: dict[str, str] = {}
