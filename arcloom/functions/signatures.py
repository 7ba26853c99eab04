"""Names of classes, methods and their parameter types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(signature: Column) -> Column:
    """What stands before the parameters."""
    return F.trim(F.substring_index(signature, "(", 1))


def class_of(signature: Column) -> Column:
    """The owner: before the last dot of the head; null if there is none."""
    h = head(signature)
    return F.when(h.contains("."), F.regexp_extract(h, r"^(.*)\.[^.]*$", 1))


def short_name(signature: Column) -> Column:
    return F.substring_index(head(signature), ".", -1)


def simple_class(signature: Column) -> Column:
    return F.substring_index(class_of(signature), ".", -1)


def method_of(signature: Column) -> Column:
    """The method's name; a constructor's is its class's."""
    n = short_name(signature)
    return F.when(n == "<init>", simple_class(signature)).otherwise(n)


def _characters(text: Column) -> Column:
    """The characters of ``text`` with the depth in type arguments and in other brackets before each."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("ang"), F.lit(0).alias("par"), F.array().cast("array<struct<c:string,ang:int,par:int>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        ang = a["ang"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        par = a["par"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        return F.struct(ang.alias("ang"), par.alias("par"), F.concat(a["out"], F.array(F.struct(c.alias("c"), ang.alias("ang"), par.alias("par")))).alias("out"))

    return F.aggregate(chars, zero, step)["out"]


def split_parameters(inside: Column) -> Column:
    """The parameters between the commas that stand outside of all brackets, without type arguments."""
    kept = F.filter(_characters(inside), lambda x: (x["ang"] == 0) & (x["c"] != ">"))
    # a comma between parameters becomes a character that no source has
    text = F.array_join(F.transform(kept, lambda x: F.when((x["c"] == ",") & (x["par"] == 0), F.lit("\x00")).otherwise(x["c"])), "")
    return F.filter(F.transform(F.split(text, "\x00"), lambda x: F.trim(x)), lambda x: x != "")


def parameter_types(signature: Column) -> Column:
    """The parameters' types, erased, without their names, modifiers, annotations and packages."""
    inside = F.regexp_extract(signature, r"\((.*)\)\s*$", 1)
    typed = F.transform(split_parameters(inside), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:final\s+|@\w+(?:\([^)]*\))?\s+)+", ""), r"\s+\w+$", ""))
    return F.transform(typed, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"^(?:\w+\.)+(\w)", "$1"))


def normalised(signature: Column) -> Column:
    """class.method(T1,T2): equal for signatures that differ in argument names, generics or packages of types only."""
    return F.concat(F.coalesce(F.concat(class_of(signature), F.lit(".")), F.lit("")), method_of(signature), F.lit("("), F.array_join(parameter_types(signature), ","), F.lit(")"))


def package_of(class_id: Column) -> Column:
    return F.when(class_id.contains("."), F.regexp_extract(class_id, r"^(.*)\.[^.]*$", 1))


def git_name(link: Column) -> Column:
    """owner/name of a repository link; fixed words for a missing and for an odd link."""
    found = F.regexp_extract(link, r"[/:]([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+?)(?:\.git)?/?$", 1)
    return F.when(link.isNull() | (F.trim(link) == ""), "no link").when(found == "", "unknown").otherwise(found)


def kind_label(kind: Column) -> Column:
    """The output name of a vertex kind; an unknown kind is an error."""
    known = ("Interface", "Class", "Enum", "Method", "Constructor", "Field", "StaticInitializer", "NormalInitializer", "Annotation", "AnnotationMember")
    return F.when(kind.isin(*known), kind).when(kind.isNull(), "Unknown").otherwise(F.raise_error(F.concat(F.lit("unknown vertex kind "), kind)))
