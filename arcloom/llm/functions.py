"""Problem 4: functions with the documentation that belongs to them.

Code is lexed by one regular expression into rows (id, pos, token). Within a source, windows give
each row its depth in braces and parentheses; every ``;``, ``{`` and ``}`` outside parentheses ends
an island (the running count of such ends before a row is the island's number), and an island that
ends in ``{`` and has a name before its first parenthesis opens a function. Its body ends at the
next brace of the same level; one that ends in ``;`` is a method without a body if the brace around
it opens a type. ``lag`` windows tell names from annotations and calls, and a ``last`` window that
looks from each comment to the next name of its island attaches it to the function. Python has
islands of logical lines instead: ``lead`` finds a definition's docstring, and comments and
decorators above it are its island. All windows share one partitioning, and sources are partitioned
by their id before they are exploded, so token rows are never shuffled. Everything runs inside the JVM.

Trivial documentation is: none, a placeholder, tags only, a separator, code, or words of the
function's own name (articles and inflection aside). Terse remarks that add something are kept.

Defined results: null code has no function (its description may still count); null names match no
words; an unclosed body ends with the text; equal rows delivered twice are one; other languages'
texts count like any words; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.llm.syntax import extension
from arcloom.tables import cut, table

_TOKEN = (
    r"/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n\r]*+"
    r'|"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\[\s\S])*+`"
    r"|[A-Za-z_$][\w$]*+|->|[{}();@=.]"
)
_NOT_NAMES = "if for while switch catch synchronized try return throw new else do case assert super this yield".split()

#: What stands in for a description that is missing.
PLACEHOLDERS = (
    "todo fixme xxx tbd n/a na none null nil nothing empty description desc undefined unknown untitled stub placeholder 无 暂无 暂无描述 暂无说明 描述 说明 "
    "方法说明 方法描述 函数说明 功能描述 待补充 待完善 待定 未知 なし 説明"
).split()
PLACEHOLDER_TEXTS = r"^(?:auto[- ]?generated(?: method| constructor)?(?: stub)?|generated (?:method|code|stub)|to be (?:written|done|defined|determined|documented|completed)|no (?:description|comment|documentation)(?: available| yet)?|(?:todo|fixme|xxx)\b.*|not (?:documented|available|applicable)(?: yet)?|description (?:goes )?here|add description|write me|coming soon)$"


def tokens_of(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, pos, tok): the tokens that matter for structure; literals and operators are lexed and left out."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{code}`").alias("code")).where(F.col("code").isNotNull())
    return rows.repartition("key").select("key", F.posexplode(_kept("code")).alias("pos", "tok"))


def _kept(code: str) -> Column:
    return F.filter(F.regexp_extract_all(F.col(code), F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^[\"'`]"))


def functions_of(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, n, name, level, first, opens, closes, comments): each function, by its token positions."""
    t = tokens_of(df, key, code)
    by = Window.partitionBy("key").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")
    comment = tok.startswith("/*") | tok.startswith("//")
    brace = F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)
    paren = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    t = t.select(
        "key",
        "pos",
        "tok",
        comment.alias("comment"),
        F.coalesce(F.sum(brace).over(before), F.lit(0)).alias("level"),
        F.coalesce(F.sum(paren).over(before), F.lit(0)).alias("inside"),
        F.last(F.when(~comment, tok), ignorenulls=True).over(before).alias("prev"),
    )
    # what stands in parentheses has counted by now; only its braces matter further
    t = t.where((F.col("inside") <= 0) | F.col("tok").isin("{", "}"))
    ends = F.col("tok").isin("{", "}", ";") & (F.col("inside") <= 0)
    named = (tok == "(") & (F.col("inside") <= 0) & F.col("prev").rlike(r"^[A-Za-z_$]")
    t = t.select(
        "*",
        ends.alias("ends"),
        F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)).alias("island"),
        F.lag(F.when(~F.col("comment"), F.col("prev"))).over(by).alias("prev2"),
        named.alias("named"),
    )
    # a parenthesis after @Name belongs to an annotation; after new or a dot it is a call
    t = t.withColumn("named", F.col("named") & ~F.coalesce(F.col("prev2").isin("@", ".", "new"), F.lit(False)) & ~F.col("prev").isin(*_NOT_NAMES))
    # three aggregations look at the marked tokens: they are kept, not made three times
    t = cut(t.select("key", "pos", F.when(F.col("comment") | F.col("tok").rlike(r"^[{};=]|^->|^(?:return|throw|new|else|case|class|interface|enum)$"), F.col("tok")).otherwise(F.substring("tok", 1, 1)).alias("tok"), "comment", "level", "inside", "ends", "island", "named", F.when(F.col("named"), F.col("prev")).alias("prev")))
    level = F.when(tok == "}", F.col("level") - 1).otherwise(F.col("level"))
    same = Window.partitionBy("key", "lv").orderBy("pos")
    isle = t.groupBy("key", "island").agg(
        F.min(F.when(~F.col("comment"), F.col("pos"))).alias("first"),
        F.max_by("tok", F.when(~F.col("comment"), F.col("pos"))).alias("last"),
        F.max(F.when(F.col("ends"), F.col("pos"))).alias("opens"),
        F.min(F.when(F.col("named"), F.struct("pos", F.col("prev").alias("name")))).alias("at"),
        F.min(F.when((F.col("tok").isin("=", "->") | F.col("tok").isin("return", "throw", "new", "else", "case")) & (F.col("inside") <= 0), F.col("pos"))).alias("broken"),
        F.count_if((F.col("inside") <= 0) & F.col("tok").rlike(r"^[A-Za-z_$]")).alias("words"),
        F.max((F.col("inside") <= 0) & F.col("tok").isin("class", "interface", "enum")).alias("type"),
        F.min("level").alias("level"),
    )
    # the brace around an island is the last one that opened its level
    around = Window.partitionBy("key", F.col("level") + F.when(F.col("last") == "{", 1).otherwise(0)).orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    isle = isle.withColumn("in_type", (F.col("level") <= 0) | F.coalesce(F.last(F.when(F.col("last") == "{", F.col("type")), ignorenulls=True).over(around), F.lit(False)))
    isle = isle.where(F.col("at").isNotNull() & (F.col("broken").isNull() | (F.col("broken") > F.col("at.pos"))))
    isle = isle.where((F.col("last") == "{") | ((F.col("last") != "}") & (F.col("words") >= 2) & F.col("in_type")))
    closes = (
        t.where(F.col("tok").isin("{", "}"))
        .select("key", "pos", "tok", level.alias("lv"))
        .withColumn("closes", F.lead("pos").over(same))
        .where(F.col("tok") == "{")
        .select("key", F.col("pos").alias("opens"), "closes")
    )
    out = isle.withColumn("head", F.col("at.pos")).join(closes, ["key", "opens"], "left").join(_attached(t.where(F.col("inside") <= 0), "island", "named"), ["key", "head"], "left")
    return out.select("key", F.row_number().over(Window.partitionBy("key").orderBy("head")).alias("n"), F.col("at.name").alias("name"), "level", "first", "opens", "closes", _none_said("comments"))


def _attached(rows: DataFrame, island: str, named: str) -> DataFrame:
    """(key, head, comments): comments, each attached to the next name of its island."""
    some = rows.where(F.col("comment") | F.col(named)).select("key", island, "pos", "tok", "comment", named)
    on = Window.partitionBy("key", island).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    owned = some.withColumn("head", F.last(F.when(F.col(named), F.col("pos")), ignorenulls=True).over(on)).where(F.col("comment") & F.col("head").isNotNull())
    return owned.groupBy("key", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda c: c["tok"]).alias("comments"))


def _none_said(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>")).alias(name)


_PY_TOKEN = (
    r'[rRbBuUfF]{0,2}(?:"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\z)|"(?:[^"\\\n\r]++|\\[\s\S])*+"?)'
    + r"|[rRbBuUfF]{0,2}(?:'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)|'(?:[^'\\\n\r]++|\\[\s\S])*+'?)"
    + r"|#[^\n\r]*+|\\(?:\r\n|\r|\n)|(?:\r\n|\r|\n)[ \t]*+|[A-Za-z_]\w*+|[()\[\]{}@:]"
)


def python_functions(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, n, name, level, comments): the functions of Python sources, ``level`` being the indentation; the docstring comes last."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{code}`").alias("code")).where(F.col("code").isNotNull())
    # a line break before the text, so that every line has one
    found = F.filter(F.regexp_extract_all(F.concat(F.lit("\n"), F.col("code")), F.lit(_PY_TOKEN), F.lit(0)), lambda t: ~t.startswith("\\"))
    t = rows.repartition("key").select("key", F.posexplode(found).alias("pos", "tok"))
    by = Window.partitionBy("key").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")
    bracket = F.when(tok.isin("(", "[", "{"), 1).when(tok.isin(")", "]", "}"), -1).otherwise(0)
    breaks = tok.rlike(r"^[\r\n]")
    t = t.withColumn("open", breaks & (F.coalesce(F.sum(bracket).over(before), F.lit(0)) <= 0))
    t = t.withColumn("line", F.sum(F.when(F.col("open"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    word = F.struct("pos", "tok")
    lines = (
        t.groupBy("key", "line")
        .agg(F.max(F.when(F.col("open"), F.length(F.regexp_replace("tok", r"[\r\n]", "")))).alias("indent"), F.slice(F.array_sort(F.collect_list(F.when(~breaks, word))), 1, 3).alias("w"))
        .where(F.size("w") > 0)
        .select("key", F.col("line").alias("pos"), "indent", F.transform("w", lambda x: x["tok"]).alias("w"))
    )
    first = F.element_at("w", 1)
    second, third = F.try_element_at("w", F.lit(2)), F.try_element_at("w", F.lit(3))
    name = F.when(first == "def", second).when((first == "async") & (second == "def"), third)
    lines = lines.select("key", "pos", "indent", first.alias("tok"), name.alias("name"), first.startswith("#").alias("comment"))
    lines = lines.withColumn("defines", F.col("name").isNotNull())
    at = Window.partitionBy("key").orderBy("pos")
    # an island is a run of comments and decorators with the line after it; a docstring is the next line that says something
    closed = F.when(F.col("comment") | (F.col("tok") == "@"), 0).otherwise(1)
    lines = lines.withColumn("island", F.coalesce(F.sum(closed).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stated = lines.where("not comment").withColumn("next", F.lead(F.struct("indent", "tok")).over(at)).where("defines")
    doc = F.when((F.col("next.indent") > F.col("indent")) & F.col("next.tok").rlike(r"^[rRbBuUfF]{0,2}[\"']"), F.array("next.tok")).otherwise(F.array().cast("array<string>"))
    out = stated.withColumn("head", F.col("pos")).join(_attached(lines, "island", "defines"), ["key", "head"], "left")
    return out.select("key", F.row_number().over(Window.partitionBy("key").orderBy("head")).alias("n"), "name", F.col("indent").alias("level"), F.concat(_none_said("comments"), doc).alias("comments"))


# -- documentation ----------------------------------------------------------------------------
def cleaned(comment: Column) -> Column:
    """The text of a comment: without its delimiters, block tags, inline tags and markup."""
    x = F.regexp_replace(comment, r"^/\*+|\*+/$", "\n")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?://+|\*+(?!\*))[ \t]?", "")
    x = F.regexp_replace(x, r"(?ms)^[ \t]*@[A-Za-z].*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\{@[A-Za-z]+[^}]*\}", " "), r"</?[A-Za-z][^<>]*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]*(?:\r\n|\r|\n)[ \t]*", "\n"), r"^\s+|\s+$", "")


def cleaned_python(comment: Column) -> Column:
    """The text of a comment or docstring."""
    quote = r"(?:\"\"\"|\'\'\'|[\"\'])"
    x = F.regexp_replace(comment, rf"^[rRbBuUfF]{{0,2}}{quote}|(?<=.){quote}$", "\n")
    x = F.regexp_replace(x, r"(?m)^[ \t]*#+[ \t]?", "")
    x = F.regexp_replace(x, r"(?ms)^[ \t]*(?:@|:)[A-Za-z].*", "")
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]*(?:\r\n|\r|\n)[ \t]*", "\n"), r"^\s+|\s+$", "")


def _stem(word: Column) -> Column:
    w = F.regexp_replace(word, r"ies$", "y")
    w = F.regexp_replace(w, r"(?<=..)(?:ing|ed|es|s|e)$", "")
    return F.regexp_replace(w, r"([bdgklmnprt])\1$", "$1")


def says_something(text: Column, name: Column) -> Column:
    """Whether a description is more than a placeholder, separator, code or the function's name."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(s))

    def kept(s: Column) -> Column:
        plain = F.lower(F.regexp_replace(s, r"^[\s\-–—.:*#=]+|[\s\-–—.!:;*#=。]+$", ""))
        separator = s.rlike(r"^([-=*#~_+/<>])\1{2,}") | s.rlike(r"^#?(?:end)?region\b|^</?editor-fold")
        code = s.rlike(r"[;{}]\s*$|^\s*(?:if|for|while|return|else|try|switch)\b.*[({].*[)}]|^\w+(?:\.\w+)+\(.*\)$|^\w+\(.*\);?$|^\w+\s*=[^=]|^@\w+")
        return (plain != "") & ~separator & ~code & ~plain.isin(*PLACEHOLDERS) & ~plain.rlike(PLACEHOLDER_TEXTS)

    said = F.array_join(F.filter(lines, kept), " ")
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(said, r"([a-z0-9])([A-Z])", "$1 $2")), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), lambda w: ~w.isin("the", "a", "an", "of", "for", "this", "method", "function"))
    own = F.transform(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), _stem)
    return F.size(F.array_except(F.transform(words, _stem), own)) > 0


def documented(functions: DataFrame) -> DataFrame:
    """(func_id, code, description, place): the functions whose documentation says something."""
    src = functions.dropDuplicates(["func_id"]).select("func_id", "func_name", "func_desc", "func_code")
    outer = functions_of(src, "func_id", "func_code").groupBy("key").agg(F.min_by("comments", "n").alias("comments"), F.min_by("name", "n").alias("found_name")).withColumnRenamed("key", "func_id")
    both = src.join(outer, "func_id", "left").withColumn("name", F.coalesce("func_name", "found_name"))
    # an array of comments: line comments in a row are one text, each is judged by itself
    texts = F.transform(F.coalesce("comments", F.array().cast("array<string>")), cleaned)
    useful = F.filter(texts, lambda x: says_something(x, F.col("name")))
    desc = F.when(says_something(F.col("func_desc"), F.col("name")), F.col("func_desc"))
    described = F.when(F.size(useful) > 0, F.array_join(useful, "\n")).otherwise(desc)
    code = F.trim(F.regexp_replace("func_code", r"^(?:\s++|/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*+)++", ""))
    return both.select("func_id", code.alias("code"), described.alias("description"), F.when(F.size(useful) > 0, "comment").otherwise("func_desc").alias("place")).where(F.col("description").isNotNull())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "code_function")).select("func_id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "code_function"))


def p4_file_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the Java, JavaScript and Python files themselves: how many of them a comment or docstring documents."""
    files = table(spark, sf_dir, "code_file").withColumn("ext", extension(F.col("file_path"))).where(F.col("ext").isin("java", "js", "py")).dropDuplicates(["file_id"])
    braced = functions_of(files.where("ext <> 'py'"), "file_id", "file_code").where("closes is not null").select("key", "name", F.transform("comments", cleaned).alias("said"))
    python = python_functions(files.where("ext = 'py'"), "file_id", "file_code").select("key", "name", F.transform("comments", cleaned_python).alias("said"))
    useful = F.exists("said", lambda x: says_something(x, F.col("name")))
    return braced.unionByName(python).groupBy(F.col("key").alias("file_id")).agg(F.count(F.lit(1)).alias("functions"), F.count_if(useful).alias("documented"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_file_functions": p4_file_functions}
ORACLE: dict[str, str] = {}
