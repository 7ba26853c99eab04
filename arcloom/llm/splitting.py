"""Problem 5: pieces of oversized files, cut at natural boundaries, by pointer doubling.

Every file over its limit is reduced to its boundaries: places (code point offsets) where it may be
cut, each with a rank (after a blank line or a closing brace in column 0, at a line, after a
statement or a blank inside a long line, anywhere). Where code has none for a long stretch, places
are added, so that no stretch without a boundary is longer than a quarter of what a piece may add
(``max_chars - overlap_chars``), down to one code point: there is always a legal cut.

A piece that is cut at a boundary is followed by one that starts the overlap before it: at a line
if one begins within ``slack`` before that place, else after a statement or blank within it, else
exactly there. So every boundary has one start, and one sweep joins it to its farthest legal
successor: starts moved by the limit are sorted among the boundaries, and ``last`` windows look
back for the farthest boundary of each rank (no pairs are formed). The best rank that is not too
near wins. Squaring this table (a join with itself) while applying it to the boundaries reached so
far doubles the known cuts, so all greedy cuts of all files come out after log2(longest chain)
joins. Boundaries that are nobody's successor cannot lie on a chain and leave before each squaring.

Defined results: null code, unknown extensions and files within the limit (compared by extension in
lower case) give no pieces; line ends count as they are; pieces are numbered from 0, cover the file,
have at most ``max_chars`` code points, each ends after the one before it, and starts
``overlap_chars`` before the last cut or up to a quarter of that more; copies and repeated
deliveries are one file; ties of rank go to the farther boundary; an empty spec gives no pieces; a
spec with ``max_chars < 1`` or without ``0 <= overlap_chars < max_chars`` raises an error where a
file needs it; rows of the spec with nulls apply to no file, and of several rows for an extension
that with the least limit and overlap holds. Surrogate pairs are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.llm.syntax import extension
from arcloom.tables import cut, table

_LINE = r"[^\r\n]*+(?:(?:\r\n|\r|\n)(?:[ \t]*+(?:\r\n|\r|\n))*+|$)"
_INNER = r"[^;,{}> \t]*+(?:[;,{}> \t]|$)"
#: Lines longer than this get boundaries inside, and runs without any get one every ``GRID`` code points (less where limits are small).
LONG, GRID = 160, 64
_KEEP = ("file_id", "n", "max_chars", "overlap_chars")


def oversized(files: DataFrame, spec: DataFrame) -> DataFrame:
    """(file_id, file_code, n, max_chars, overlap_chars): files over the limit of their extension, once."""
    limit = F.struct("max_chars", "overlap_chars")
    per = spec.where("ext is not null and max_chars is not null and overlap_chars is not null").groupBy("ext").agg(F.min(limit).alias("limit"))
    rows = files.where(F.col("file_code").isNotNull()).select("file_id", extension(F.col("file_path")).alias("ext"), "file_code", F.length("file_code").alias("n"))
    rows = rows.join(F.broadcast(per), "ext").select("file_id", "file_code", "n", "limit.*").where(F.col("n") > F.col("max_chars"))
    legal = (F.col("max_chars") >= 1) & (F.col("overlap_chars") >= 0) & (F.col("overlap_chars") < F.col("max_chars"))
    checked = F.when(legal, F.col("max_chars")).otherwise(F.raise_error(F.lit("split spec: 0 <= overlap_chars < max_chars is required")))
    return rows.withColumn("max_chars", checked.cast("int")).dropDuplicates(["file_id"])


def _quarter() -> Column:
    """A quarter of what a piece adds."""
    return F.floor((F.col("max_chars") - F.col("overlap_chars")) / 4)


def slack() -> Column:
    """How far before (cut - overlap) a piece may start at a natural place."""
    return F.least(F.floor(F.col("overlap_chars") / 4), _quarter()).cast("int")


def boundaries_of(big: DataFrame) -> DataFrame:
    """(file_id, n, max_chars, overlap_chars, pos, rank, begin, run): the places where a file may be cut; rank 1 is best.

    The text is taken apart into lines, long lines into runs that end after a statement or a blank;
    running sums of the lengths are the offsets. ``begin`` is where the run that ends here begins
    (null at offset 0 and inside a run), ``run`` its text if it is a whole line.
    """
    long = F.greatest(F.lit(1), F.least(F.lit(LONG), _quarter())).cast("int")
    lines = F.regexp_extract_all("file_code", F.lit(_LINE), F.lit(0))
    marked = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > long, F.regexp_extract_all(x, F.lit(_INNER), F.lit(0))).otherwise(F.array(x))))
    rows = big.select(*_KEEP, F.posexplode(marked).alias("i", "run"))
    by = Window.partitionBy("file_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("run").rlike(r"[\r\n]$")
    blank = F.col("run").rlike(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)$")
    top = F.col("run").rlike(r"^\}[;)]*[ \t]*(?:\r\n|\r|\n)")
    rank = F.when(blank | top, 1).when(line, 2).when(F.col("run").rlike(r"[;,{}>]$"), 3).otherwise(4)
    at = rows.select(*_KEEP, "run", F.sum(F.length("run")).over(by).cast("int").alias("pos"), rank.alias("rank")).where(F.length("run") > 0)
    # a long run gets a boundary every grid code points
    step = F.greatest(F.lit(1), F.least(F.lit(GRID), _quarter())).cast("int")
    none = (F.lit(None).cast("int").alias("begin"), F.lit(None).cast("string").alias("run"))
    inner = F.transform(F.sequence(F.lit(1), F.floor((F.length("run") - 1) / step).cast("int")), lambda k: F.struct((F.col("pos") - F.length("run") + k * step).cast("int").alias("pos"), F.lit(5).alias("rank"), *none))
    own = F.struct("pos", "rank", (F.col("pos") - F.length("run")).cast("int").alias("begin"), F.when(F.length("run") <= long, F.col("run")).alias("run"))
    every = F.when(F.length("run") > step, F.concat(inner, F.array(own))).otherwise(F.array(own))
    every = F.when(line & (F.length("run") <= long), F.array(own)).otherwise(every)
    first = big.select(*_KEEP, F.lit(0).alias("pos"), F.lit(1).alias("rank"), *none)
    return at.select(*_KEEP, F.explode(every).alias("b")).select(*_KEEP, "b.*").unionByName(first)


def starts_of(bounds: DataFrame) -> DataFrame:
    """(file_id, n, max_chars, overlap_chars, pos, rank, start): for every boundary, where the piece after it starts."""
    wanted = F.when(F.col("pos") == 0, 0).otherwise(F.col("pos") - F.col("overlap_chars")).cast("int")
    asks = bounds.select(*_KEEP, wanted.alias("at"), F.lit(1).alias("asks"), "pos", "rank", F.lit(None).cast("string").alias("run"))
    lines = bounds.where("begin is not null").select(*_KEEP, F.col("begin").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("rank"), "run")
    back = Window.partitionBy("file_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    around = F.last(F.when(F.col("asks") == 0, F.struct("at", "run")), ignorenulls=True).over(back)
    found = asks.unionByName(lines).select("*", around.alias("around")).where("asks = 1")
    inside = F.col("at") - F.col("around.at")
    # runs of long lines have such places at their ends only
    natural = F.length(F.regexp_extract(F.substring(F.col("around.run"), inside - slack() + 1, slack()), r"^([\s\S]*[;,{}> \t])", 1))
    start = (
        F.when((F.col("overlap_chars") == 0) | (F.col("at") <= 0), F.greatest(F.col("at"), F.lit(0)))
        .when(inside <= slack(), F.col("around.at"))
        .when(natural > 0, F.col("at") - slack() + natural)
        .otherwise(F.col("at"))
    )
    return found.select(*_KEEP, "pos", "rank", start.cast("int").alias("start"))


def successors(bounds: DataFrame) -> DataFrame:
    """(file_id, pos, start, next): for every boundary, the start of the piece after it and that piece's end (null at the end of the file)."""
    places = cut(starts_of(bounds))
    asks = places.where(F.col("pos") < F.col("n")).select(*_KEEP, (F.col("start") + F.col("max_chars")).alias("at"), F.lit(1).alias("asks"), "pos", "start", F.lit(None).cast("int").alias("rank"))
    ends = places.select(*_KEEP, F.col("pos").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("start"), "rank")
    back = Window.partitionBy("file_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("rank") <= r, F.col("at")), ignorenulls=True).over(back).alias(f"c{r}") for r in (1, 2, 3, 4, 5)]
    found = asks.unionByName(ends).select("*", *last).where("asks = 1")
    # the end of a piece lies past the piece before it, and not too near for its rank
    least = F.col("start") + F.col("overlap_chars") + slack() + 1
    end = F.when(F.col("at") >= F.col("n"), F.col("n"))
    for r, share in zip((1, 2, 3, 4), (0.6, 0.4, 0.25, 0.1)):
        end = end.when(F.col(f"c{r}") >= F.greatest(least, F.col("start") + F.col("max_chars") * share), F.col(f"c{r}"))
    stuck = F.raise_error(F.concat(F.lit("no legal cut in file "), F.col("file_id").cast("string")))
    end = end.when((F.col("c5") > F.col("pos")) & (F.col("c5") > F.col("start")), F.col("c5")).otherwise(stuck)
    return found.select("file_id", "pos", "start", end.cast("int").alias("next"))


def reachable(links: DataFrame) -> DataFrame:
    """(file_id, pos): the boundaries that the chain from 0 reaches, by doubling the successor table (file_id, pos, next)."""
    step = links.select("file_id", "pos", "next")
    known = step.where("pos = 0").select("file_id", "pos")
    while True:
        # only boundaries that are a successor, or the first, can be met again
        met = step.select("file_id", F.col("next").alias("pos")).unionByName(known).distinct()
        step = cut(step.join(met, ["file_id", "pos"], "left_semi"))
        if step.isEmpty():
            return known
        known = cut(known.unionByName(known.join(step, ["file_id", "pos"]).select("file_id", F.col("next").alias("pos"))).distinct())
        to = step.select("file_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        step = step.join(to, ["file_id", "next"]).select("file_id", "pos", F.col("far").alias("next"))


def split(files: DataFrame, spec: DataFrame) -> DataFrame:
    """(file_id, piece, start, stop, text): the pieces of every oversized file."""
    big = oversized(files, spec)
    links = cut(successors(boundaries_of(big)))
    spans = links.join(reachable(links), ["file_id", "pos"]).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "next"))).alias("spans"))
    code = big.select("file_id", "file_code").join(spans, "file_id")
    return code.select("file_id", "file_code", F.posexplode("spans").alias("piece", "s")).select(
        "file_id", "piece", F.col("s.start").alias("start"), F.col("s.next").alias("stop"), F.substring(F.col("file_code"), F.col("s.start") + 1, F.col("s.next") - F.col("s.start")).alias("text")
    )


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "code_file"), table(spark, sf_dir, "split_spec"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that need cutting, as the operator cuts them (a file's first piece stands for it)."""
    return _pieces(spark, sf_dir).where("piece = 0").select("file_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE = {
    "p5_found": """
SELECT DISTINCT file_id FROM code_file JOIN split_spec ON lower(regexp_extract(file_path, '\\.([A-Za-z0-9_]+)$', 1)) = ext
WHERE file_code IS NOT NULL AND length(file_code) > max_chars
""",
}
