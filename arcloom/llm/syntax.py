"""Problem 2: source files that no supported dialect of their language accepts.

Every file is lexed and run through the generalised LL recogniser (``gll``) of the language its
extension names, the grammars of all its dialects together in one stack; the dialects that accept
it come out. Files that all of them reject are then held against the exact parser where Python has
one (Python, JSON, XML), which can only acquit. Work is one pass
over the files without a shuffle of their contents; the rates per repository and language combine on
the map side.

Defined results: null code is no case; empty code is an empty compilation unit, module or script,
but no JSON value and no document; a byte order mark at the start belongs to the encoding and is
skipped; other extensions are no case; copies and repeated deliveries of a file are one row.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from json import JSONDecodeError, loads
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from arcloom.llm import lexers
from arcloom.llm.grammars import grammar
from arcloom.tables import table

LANGUAGES = ("java", "js", "py", "json", "xml")


def extension(path: Column) -> Column:
    """The extension in lower case, whatever the path's separators; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))


def parsed(language: str, code: str) -> tuple[list[str], int]:
    """The dialects that accept the text, and the token at which the longest parse ended (-1: no token fits)."""
    g = grammar(language)
    code = code[1:] if code.startswith("\ufeff") else code
    got = getattr(lexers, language)(code, g)
    if got is None:
        return [], -1
    ok, at = g.accepting(got[0], got[1], g.tid("ASI")) if language == "js" else g.accepting(got)
    return [d for k, d in enumerate(g.dialects) if ok >> k & 1], at


def rejected_at(language: str, code: str) -> int | None:
    """None if some dialect accepts the text, else where the last parse ended."""
    ok, at = parsed(language, code)
    return None if ok else at


def _no_constant(_: str):
    raise JSONDecodeError("not RFC 8259", "", 0)


def acquitted(language: str, code: str) -> bool:
    """Whether an exact parser accepts what the recogniser rejected."""
    code = code[1:] if code.startswith("\ufeff") else code
    try:
        if language == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(code)
        elif language == "json":
            loads(code, parse_constant=_no_constant)
        elif language == "xml":
            expat.ParserCreate("utf-8").Parse(code.encode("utf-8"), True)  # whatever encoding it declares: it is text here
        else:
            return False
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError, expat.ExpatError):
        return False


#: The name of an exact parser's verdict among the dialects.
EXACT = "exact parser"
_VERDICT = StructType().add("broken", BooleanType()).add("accepted", ArrayType(StringType())).add("at", IntegerType())


def verdict(language: str, code: str | None) -> tuple[bool, list[str], int]:
    """(broken, dialects that accept it, where the longest parse ended)."""
    if code is None or language not in LANGUAGES:
        return False, [], 0
    accepted, at = parsed(language, code)
    if not accepted and acquitted(language, code):
        accepted = [EXACT]
    return not accepted, accepted, at


def is_broken(language: str, code: str | None) -> bool:
    return verdict(language, code)[0]


@F.pandas_udf(_VERDICT)
def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for language, code in batches:
        yield pd.DataFrame([verdict(a, b) for a, b in zip(language, code)], columns=["broken", "accepted", "at"])


def check_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, broken, accepted, at) of every file with code in a supported language."""
    rows = files.select("file_id", "repo", extension(F.col("file_path")).alias("language"), "file_code")
    rows = rows.where(F.col("language").isin(*LANGUAGES) & F.col("file_code").isNotNull())
    return rows.select("file_id", "repo", "language", judged("language", "file_code").alias("v")).select("file_id", "repo", "language", "v.*")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(table(spark, sf_dir, "code_file")).where("broken").select("file_id").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = check_files(table(spark, sf_dir, "code_file")).groupBy("file_id").agg(F.first("repo").alias("repo"), F.first("language").alias("language"), F.bool_or("broken").alias("broken"))
    return one.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken"), F.round(F.count_if("broken") / F.count(F.lit(1)), 4).alias("rate"))


def p2_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of a repository and language each dialect rejects; what only an exact parser accepts, all of them do."""
    one = check_files(table(spark, sf_dir, "code_file")).dropDuplicates(["file_id"])
    names = F.create_map(*[F.lit(x) for k in LANGUAGES for x in (k, F.array(*[F.lit(d) for d in grammar(k).dialects]))])
    each = one.select("repo", "language", F.explode(names[F.col("language")]).alias("dialect"), "accepted")
    return each.groupBy("repo", "language", "dialect").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.array_contains("accepted", F.col("dialect"))).alias("rejected"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p2_dialects": p2_dialects}
ORACLE: dict[str, str] = {}
