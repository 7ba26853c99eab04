"""Scalar functions on text: lines of code, identifiers, replies with fenced JSON, encodings."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def lines(code: Column) -> Column:
    return F.split(code, r"\r\n|\r|\n")


def line_slice(lines_: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, inclusive) of an array of lines, as text."""
    return F.array_join(F.slice(lines_, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def is_code_line(line: Column) -> Column:
    """Counts as a line of code: not blank, and not beginning like a comment."""
    x = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (x != "") & ~x.startswith("//") & ~x.startswith("/*") & ~x.startswith("*")


def lines_of_code(code: Column) -> Column:
    return F.size(F.filter(lines(code), is_code_line)).cast("long")


def identifiers(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(IDENTIFIER), F.lit(0)))


def fenced(text: Column, language: str = "json") -> Column:
    """The content of the first fenced block of a language; null without one."""
    got = F.regexp_extract(text, rf"(?s)```{language}\s*(.*?)```", 1)
    return F.when(got != "", F.trim(got))


def balanced(text: str | None) -> str | None:
    """The first balanced object of a reply, braces in strings aside; what is left from its brace if it does not end; null without one."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    return text[start:].strip()


def bullets(value) -> str:
    """Any JSON value as text: entries as lines ``- key: text``, items of lists as lines ``- text``."""
    if value is None:
        return ""
    if isinstance(value, dict):
        pairs = ((str(k).strip(), bullets(v)) for k, v in value.items())
        return "\n".join("- " + ": ".join(x for x in kv if x) for kv in pairs if any(kv))
    if isinstance(value, list):
        rows = (row.strip() for item in value for row in bullets(item).splitlines())
        return "\n".join(row if row.startswith("- ") else f"- {row}" for row in rows if row)
    return str(value).strip()


def _bullets_of(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return bullets(json.loads(text))
    except ValueError:
        return text.strip()


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a reply; null without one."""
    return pandas_udf(lambda s: s.map(balanced, na_action="ignore"), StringType())(text)


def bullet_text(text: Column) -> Column:
    """JSON text as bullet lines; other text as it is."""
    return pandas_udf(lambda s: s.map(_bullets_of, na_action="ignore"), StringType())(text)


def usecase(text: Column) -> Column:
    """A reply's description, flow and notes, with empty strings where it has none."""
    got = F.from_json(first_object(text), "description string, flow string, notf string")
    return F.struct(*[F.coalesce(got[k], F.lit("")).alias(k) for k in ("description", "flow", "notf")])


def needed_files(text: Column) -> Column:
    """A reply's answer whether more files are needed, and which (filename, recommendReason)."""
    files = "array<struct<filename:string,recommendReason:string>>"
    got = F.from_json(fenced(text), f"needAdditionalFile boolean, additionalFileList {files}")
    return F.struct(F.coalesce(got["needAdditionalFile"], F.lit(False)).alias("need"), F.coalesce(got["additionalFileList"], F.array().cast(files)).alias("files"))


def file_plans(text: Column) -> Column:
    """A reply's list of (filename, plan, note), by itself or under ``modifiedFileList``."""
    plans = "array<struct<filename:string,plan:string,note:string>>"
    block = fenced(text)
    inside = F.from_json(block, f"modifiedFileList {plans}")["modifiedFileList"]
    return F.coalesce(F.when(block.startswith("["), F.from_json(block, plans)), inside, F.array().cast(plans))


def chunk_content(line: Column) -> Column:
    """The text a streamed line carries: ``data:`` lines only, nothing for the end mark."""
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    return F.when((body != "") & (body != "[DONE]"), F.coalesce(F.get_json_object(body, "$.choices[0].delta.content"), F.lit("")))


def import_lines(text: Column) -> Column:
    """Import statements of a fenced reply, or of plain source."""
    return F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.startswith("import "))


def imported(code: Column) -> Column:
    """Names imported by Java source, ``.*`` kept."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?:^|\n)[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"), F.lit(1)))


def base64_text(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def one_line(code: Column) -> Column:
    """Newlines escaped, as the interchange files have them."""
    return F.replace(F.replace(code, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\\n"))
