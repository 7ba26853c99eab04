"""Declarations, imports, references and calls of Java source, and the typed graph they form.

One pass over the files (a lexer and a brace stack in Python, vectorised over Arrow batches) emits
flat facts; everything that needs more than one file (names to classes, calls to methods,
inheritance) is resolved by joins. Sources that do not parse give the facts found before the place
where they break, and a fact ``broken`` that tells where; on demand they are an error. Resolution is by name and number of arguments: an unknown receiver is resolved
where one method of the repository has that name and arity.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.operators.graph import closure
from arcloom.tables import cut

_LEX = re.compile(
    r"\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
    r'|("""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|([A-Za-z_$][\w$]*)|(\d[\w.]*)|(->|::|\.\.\.|[-+*/%&|^]=|==|!=|<=|>=|\+\+|--|&&|\|\||[{}()\[\];,.@=<>?:!~+\-*/%&|^])'
)
_MODIFIERS = set("public private protected static abstract final native synchronized transient volatile strictfp default sealed".split())
_TYPES = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class"}
_WORDS = set("if for while switch catch try return throw new else do case assert super this synchronized instanceof".split())
_NEW = ("new", "this_new", "super_new")
_PRIMS = set("int long short byte char boolean float double void var String Object Integer Long Boolean Double".split())


class _Unit:
    """Facts of one compilation unit."""

    def __init__(self, code: str):
        self.code = code
        self.t = [(m.group(0), m.lastindex, m.start()) for m in _LEX.finditer(code) if m.lastindex]
        self.i = 0
        self.package = ""
        self.facts: list[tuple] = []
        self.open_at: int | None = None  # where something begins that never ends
        self.starts = [0] + [m.end() for m in re.finditer("\n", code)]

    def line(self, pos: int) -> int:
        return bisect.bisect_right(self.starts, pos)

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else ""

    def fact(self, what: str, **f) -> None:
        self.facts.append((what, f))

    def skip(self, a: str, b: str) -> int:
        """From ``a`` at the cursor past its partner; gives the index after it."""
        depth, begin = 0, self.i
        while self.i < len(self.t):
            x = self.t[self.i][0]
            self.i += 1
            depth += (x == a) - (x == b)
            if depth == 0:
                return self.i
        if self.open_at is None:
            self.open_at = begin
        return self.i

    def name(self) -> str:
        out = ""
        while self.i < len(self.t) and (self.t[self.i][1] == 2 or self.peek() in (".", "*")):
            if out and out[-1] != "." and self.peek() != ".":
                break
            out += self.peek()
            self.i += 1
        return out

    def annotations(self) -> list[str]:
        out = []
        while self.peek() == "@" and self.peek(1) != "interface":
            self.i += 1
            out.append(self.name())
            if self.peek() == "(":
                self.skip("(", ")")
        return out

    def unit(self) -> None:
        while self.i < len(self.t):
            x = self.peek()
            if x == "package":
                self.i += 1
                self.package = self.name()
            elif x == "import":
                self.i += 1
                static = self.peek() == "static"
                self.i += static
                self.fact("import", name=self.name(), static=static)
            elif x in (";", "}"):
                self.i += 1
            else:
                at = self.i
                if not self.member(self.package, "", set()):
                    self.i = max(self.i, at + 1)

    def member(self, owner: str, simple: str, fields: set[str]) -> bool:
        notes, mods, begin = [], [], self.i
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                notes += self.annotations()
            elif self.peek() in _MODIFIERS and not (self.peek() == "default" and self.peek(1) == ":"):
                mods.append(self.peek())
                self.i += 1
            else:
                break
        x = self.peek()
        if x == "@" and self.peek(1) == "interface":
            self.i += 1
            return self.type("Annotation", owner, notes, mods, begin)
        if x in _TYPES and self.i + 1 < len(self.t) and self.t[self.i + 1][1] == 2 and (x != "record" or self.peek(2) in ("(", "<")):
            return self.type(_TYPES[x], owner, notes, mods, begin)
        if not simple:
            return False
        if x == "{":
            start = self.i
            end = self.skip("{", "}")
            text = re.sub(r"\s+", " ", self.code[self.t[start][2] : self.t[end - 1][2] + 1])
            kind = "StaticInitializer" if "static" in mods else "NormalInitializer"
            self.declare(kind, f"{owner}.{text}", owner, kind, notes, mods, start, end)
            self.body(f"{owner}.{text}", owner, start, end, {}, fields)
            return True
        return self.field_or_method(owner, simple, notes, mods, begin, fields)

    def declare(self, kind: str, id_: str, owner: str, name: str, notes: list[str], mods: list[str], a: int, b: int, argc: int = -1, params: str | None = None) -> None:
        last = self.t[min(b, len(self.t)) - 1][2]
        self.fact("decl", vkind=kind, id=id_, owner=owner, name=name, notes=notes, mods=mods, start=self.line(self.t[a][2]), end=self.line(last), argc=argc, abstract="abstract" in mods or kind == "Interface", params=params)
        for n in notes:
            self.fact("ref", src=id_, kind="AnnotationUse", type=n)

    def type_names(self, a: int, b: int) -> list[str]:
        """Names of types between two token positions (all of them, inside type arguments, too)."""
        out, k = [], a
        while k < b:
            if self.t[k][1] == 2 and self.t[k][0] not in _MODIFIERS and self.t[k][0] not in ("extends", "super"):
                n = self.t[k][0]
                while k + 2 < b and self.t[k + 1][0] == "." and self.t[k + 2][1] == 2:
                    n += "." + self.t[k + 2][0]
                    k += 2
                out.append(n)
            k += 1
        return out

    def type(self, kind: str, owner: str, notes: list[str], mods: list[str], begin: int) -> bool:
        self.i += 1
        simple = self.peek()
        fqn = f"{owner}.{simple}" if owner else simple
        self.i += 1
        at = len(self.facts)
        parents: list[tuple[str, str]] = []
        mode = ""
        while self.i < len(self.t) and self.peek() not in ("{", ";"):
            x = self.peek()
            if x in ("extends", "implements", "permits"):
                mode = x
                self.i += 1
            elif x == "<":
                self.skip("<", ">")
            elif x == "(":
                self.skip("(", ")")
            elif mode in ("extends", "implements") and self.t[self.i][1] == 2:
                parents.append(("Extends" if mode == "extends" else "Implements", self.name()))
            else:
                self.i += 1
        self.i += 1
        for k, n in parents:
            self.fact("parent", child=fqn, kind=k, type=n)
        fields: set[str] = set()
        if kind == "Enum":
            while self.i < len(self.t) and self.peek() not in (";", "}"):
                if self.t[self.i][1] == 2:
                    self.fact("constant", owner=fqn, name=self.peek())
                    self.i += 1
                    if self.peek() == "(":
                        self.skip("(", ")")
                    if self.peek() == "{":
                        self.skip("{", "}")
                else:
                    self.i += 1
        ctor = False
        opened = self.i - 1
        while self.i < len(self.t) and self.peek() != "}":
            here = self.i
            n = len(self.facts)
            if self.peek() == ";":
                self.i += 1
            elif not self.member(fqn, simple, fields):
                self.i = max(self.i, here + 1)
            ctor |= any(k == "decl" and f["vkind"] == "Constructor" and f["owner"] == fqn for k, f in self.facts[n:])
        if self.i >= len(self.t) and self.open_at is None:
            self.open_at = min(opened, len(self.t) - 1)
        self.i += 1
        if not ctor and kind in ("Class", "Enum") and "abstract" not in mods:
            self.declare("Constructor", f"{fqn}.{simple}()", fqn, simple, ["ltm.Generated"], ["public"], begin, begin + 1, 0)
        self.facts.insert(at, ("decl", dict(vkind=kind, id=fqn, owner=owner if owner != self.package else "", name=simple, notes=notes, mods=mods, start=self.line(self.t[begin][2]), end=self.line(self.t[min(self.i, len(self.t)) - 1][2]), argc=-1, abstract="abstract" in mods or kind == "Interface", params=None)))
        for n in notes:
            self.fact("ref", src=fqn, kind="AnnotationUse", type=n)
        return True

    def field_or_method(self, owner: str, simple: str, notes: list[str], mods: list[str], begin: int, fields: set[str]) -> bool:
        a = self.i
        if self.peek() == "<":
            self.skip("<", ">")
            a = self.i
        while self.i < len(self.t) and self.peek() not in ("(", ";", "=", "{", "}", ","):
            if self.peek() == "<":
                self.skip("<", ">")
            else:
                self.i += 1
        if self.i >= len(self.t) or self.peek() in ("}", "{") or self.t[self.i - 1][1] not in (2, 4):
            return False
        end_of_type = self.i - 1
        name = self.t[self.i - 1][0]
        if self.peek() == "(":
            p = self.i
            q = self.skip("(", ")") - 1
            params, depth, start = [], 0, p + 1
            for k in range(p + 1, q + 1):
                x = self.t[k][0]
                depth += (x in "(<[") - (x in ")>]") if x in ("(", "<", "[", ")", ">", "]") else 0
                if (x == "," and depth == 0) or k == q:
                    if k > start:
                        params.append((start, k))
                    start = k + 1
            scope, types, whole = {}, [], []
            for s, e in params:
                while s < e and (self.t[s][0] in _MODIFIERS or self.t[s][0] == "@"):
                    s += 2 if self.t[s][0] == "@" else 1
                text = re.sub(r"<.*>", "", "".join(x[0] for x in self.t[s : e - 1]))
                types.append(text)
                whole.append(re.sub(r"\s+", " ", self.code[self.t[s][2] : self.t[e - 1][2] + len(self.t[e - 1][0])]))
                scope[self.t[e - 1][0]] = text
            ctor = end_of_type == a and name == simple
            id_ = f"{owner}.{name}({', '.join(types)})"
            while self.i < len(self.t) and self.peek() not in ("{", ";"):
                self.i += 1
            b = self.i
            e = self.skip("{", "}") if self.peek() == "{" else self.i + 1
            self.i = e
            self.declare("Constructor" if ctor else "Method", id_, owner, name, notes, mods + ([] if self.t[min(b, len(self.t) - 1)][0] == "{" else ["abstract"]), begin, e, len(types), ", ".join(whole))
            if not ctor:
                for n in self.type_names(a, end_of_type):
                    self.fact("ref", src=id_, kind="ReturnType", type=n)
            for s, x in params:
                for n in self.type_names(s, x - 1):
                    self.fact("ref", src=id_, kind="ParameterType", type=n)
            if b < len(self.t) and self.t[b][0] == "{":
                self.body(id_, owner, b, e, scope, fields)
            return True
        while True:
            kind = " ".join(x[0] for x in self.t[a:end_of_type])
            id_ = f"{owner}.{kind} {name}"
            fields.add(name)
            stop = self.i
            depth = 0
            while stop < len(self.t) and not (depth == 0 and self.t[stop][0] in (";", ",")):
                depth += (self.t[stop][0] in "({[") - (self.t[stop][0] in ")}]") if self.t[stop][0] in ("(", "{", "[", ")", "}", "]") else 0
                stop += 1
            self.declare("Field", id_, owner, name, notes, mods, begin, stop)
            for n in self.type_names(a, end_of_type):
                self.fact("ref", src=id_, kind="FieldType", type=n)
            self.fact("field", owner=owner, name=name, id=id_, type=re.sub(r"<.*>", "", "".join(x[0] for x in self.t[a:end_of_type])))
            self.body(id_, owner, self.i, stop, {}, fields)
            self.i = stop
            if self.peek() != ",":
                self.i += 1
                return True
            self.i += 1
            name = self.peek()
            self.i += 1

    def arguments(self, at: int, scope: dict[str, str]) -> list[str]:
        """What the types of the arguments in the parentheses that open at a token position seem to be; ? where nothing tells."""
        depth, begin, j, parts = 0, at + 1, at, []
        while j < len(self.t):
            y = self.t[j][0]
            depth += (y in "({[") - (y in ")}]") if y in ("(", "{", "[", ")", "}", "]") else 0
            if depth == 0 or (y == "," and depth == 1):
                if j > begin or y == ",":
                    parts.append((begin, j))
                begin = j + 1
            if depth == 0:
                break
            j += 1
        return [self.type_of(a, b, scope) for a, b in parts]

    def type_of(self, a: int, b: int, scope: dict[str, str]) -> str:
        """The type an expression between two token positions seems to have."""
        x, kind, _ = self.t[a] if a < b else ("", 0, 0)
        if x == "new" and a + 1 < b:
            return self.t[a + 1][0]
        if b - a != 1:
            return "?"
        if kind == 1:
            return "char" if x[0] == "'" else "String"
        if kind == 3:
            return "long" if x[-1] in "lL" else "float" if x[-1] in "fF" and not x.startswith("0x") else "double" if "." in x or x[-1] in "dD" else "int"
        return "boolean" if x in ("true", "false") else scope.get(x) or "?"

    def reference(self, src: str, owner: str, left: str, name: str, scope: dict[str, str], fields: set[str], k: int) -> None:
        """A method reference is a call with any number of arguments."""
        chained = k >= 2 and self.t[k - 2][0] == "."
        if name == "new":
            self.fact("call", src=src, owner=owner, recv=left, how="new", name=left, args=None)
        elif left in ("this", "super"):
            self.fact("call", src=src, owner=owner, recv=left, how="self" if left == "this" else "super", name=name, args=None)
        elif left in scope and not chained:
            self.fact("call", src=src, owner=owner, recv=scope[left], how="scoped", name=name, args=None)
        elif left in fields and not chained:
            self.fact("call", src=src, owner=owner, recv=left, how="field", name=name, args=None)
        elif left[:1].isupper():
            self.fact("call", src=src, owner=owner, recv=left, how="type", name=name, args=None)

    def body(self, src: str, owner: str, a: int, b: int, scope: dict[str, str], fields: set[str]) -> None:
        """Calls, uses and local types between two token positions."""
        scope = dict(scope)
        k = a
        while k < min(b, len(self.t)):
            x, kind, _ = self.t[k]
            nxt = self.t[k + 1][0] if k + 1 < len(self.t) else ""
            prev = self.t[k - 1][0] if k else ""
            if x == "->" and kind == 4 and k and self.t[k - 1][1] == 2:
                scope.pop(self.t[k - 1][0], None)  # the parameter of a lambda has no declared type
            elif x == "::" and k + 1 < len(self.t):
                self.reference(src, owner, prev, nxt, scope, fields, k)
            elif x in ("this", "super") and nxt == "(":
                self.fact("call", src=src, owner=owner, recv="", how=f"{x}_new", name=owner.rsplit(".", 1)[-1], args=self.arguments(k + 1, scope))
            elif kind == 2 and x not in _WORDS and x not in _MODIFIERS:
                if nxt == "(" :
                    args = self.arguments(k + 1, scope)
                    if prev == "new":
                        self.fact("call", src=src, owner=owner, recv=x, how="new", name=x, args=args)
                    elif prev == ".":
                        q = self.t[k - 2][0] if k >= 2 else ""
                        chained = k >= 3 and self.t[k - 3][0] == "."
                        recv = scope.get(q, "") if not chained else ""
                        how = "self" if q == "this" else "super" if q == "super" else "type" if q[:1].isupper() and not chained else "scoped" if recv else "field" if q in fields else "unknown"
                        self.fact("call", src=src, owner=owner, recv=recv if how == "scoped" else q, how=how, name=x, args=args)
                    else:
                        self.fact("call", src=src, owner=owner, recv="", how="self", name=x, args=args)
                elif prev != "." and k + 1 < len(self.t) and self.t[k + 1][1] == 2 and nxt not in ("instanceof",) and (x[:1].isupper() or x in _PRIMS):
                    scope[nxt] = x
                    self.fact("ref", src=src, kind="VariableType", type=x)
                elif prev == "new":
                    self.fact("call", src=src, owner=owner, recv=x, how="new", name=x, args=None)
                elif x[:1].isupper() and nxt == "." and k + 2 < len(self.t) and self.t[k + 2][1] == 2 and self.t[k + 3 if k + 3 < len(self.t) else k][0] != "(":
                    self.fact("use", src=src, owner=x, name=self.t[k + 2][0], define=False, qualified=True)
                elif x in fields and x not in scope and (prev != "." or (k >= 2 and self.t[k - 2][0] == "this")):
                    self.fact("use", src=src, owner=owner, name=x, define=nxt in ("=", "+=", "-=", "*=", "/=", "++", "--"), qualified=False)
            k += 1


def facts(code: str) -> tuple[str, list[tuple]]:
    """(package, facts) of one source; one that does not hold together has a fact ``broken`` with its line."""
    u = _Unit(code)
    try:
        u.unit()
    except (IndexError, RecursionError):
        u.open_at = min(u.i, len(u.t) - 1) if u.open_at is None else u.open_at
    if u.open_at is not None and u.t:
        u.fact("broken", line=u.line(u.t[u.open_at][2]))
    return u.package, u.facts


_FACT = (
    "file_id int, repo int, pkg string, fact string, src string, owner string, kind string, name string, type string, argc int, notes array<string>, "
    "start int, end int, abstract boolean, flag boolean"
)


def facts_of(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Facts of every Java file (file_id, repo, code) as rows. With ``mode`` FAILFAST a broken file is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.strip().split(" ")[0] for c in _FACT.split(",")]
        for b in batches:
            out = []
            for i, repo, code in zip(b["file_id"], b["repo"], b["code"]):
                pkg, rows = facts(code)
                for k, f in rows:
                    if k == "decl":
                        out.append((i, repo, pkg, k, f["id"], f["owner"], f["vkind"], f["name"], f["params"], f["argc"], f["notes"], f["start"], f["end"], f["abstract"], "static" in f["mods"]))
                    elif k == "import":
                        out.append((i, repo, pkg, k, None, None, None, f["name"], None, None, None, None, None, None, f["static"]))
                    elif k == "parent":
                        out.append((i, repo, pkg, k, f["child"], None, f["kind"], None, f["type"], None, None, None, None, None, None))
                    elif k == "ref":
                        out.append((i, repo, pkg, k, f["src"], None, f["kind"], None, f["type"], None, None, None, None, None, None))
                    elif k == "call":
                        out.append((i, repo, pkg, k, f["src"], f["owner"], f["how"], f["name"], f["recv"], -1 if f["args"] is None else len(f["args"]), f["args"], None, None, None, None))
                    elif k == "use":
                        out.append((i, repo, pkg, k, f["src"], f["owner"], None, f["name"], None, None, None, None, None, f["qualified"], f["define"]))
                    elif k == "field":
                        out.append((i, repo, pkg, k, f["id"], f["owner"], None, f["name"], f["type"], None, None, None, None, None, None))
                    elif k == "broken":
                        if mode == "FAILFAST":
                            raise ValueError(f"file {i} breaks at line {f['line']}")
                        out.append((i, repo, pkg, k, None, None, None, None, None, None, None, f["line"], None, None, None))
                    elif k == "constant":
                        out.append((i, repo, pkg, k, None, f["owner"], None, f["name"], None, None, None, None, None, None, None))
            yield pd.DataFrame(out, columns=cols).astype({"repo": "Int32", "argc": "Int32", "start": "Int32", "end": "Int32", "abstract": "boolean", "flag": "boolean"})

    return files.where(F.col("code").isNotNull()).select("file_id", "repo", "code").mapInPandas(run, _FACT)


#: Annotations that make accessors.
GETTERS, SETTERS = ("Getter", "Data", "Value"), ("Setter", "Data")


def marked(annotations: Column) -> Column:
    """Annotations with a copy under a name of its own of each that a tool would expand."""
    copies = F.transform(F.filter(annotations, lambda a: F.substring_index(a, ".", -1).isin(*GETTERS, *SETTERS)), lambda a: F.concat(F.lit("ltm.lombok."), F.substring_index(a, ".", -1)))
    return F.concat(annotations, copies)


def restored(annotations: Column) -> Column:
    """The copies back under their names, once each."""
    return F.array_distinct(F.transform(annotations, lambda a: F.regexp_replace(a, r"^ltm\.lombok\.", "")))


def accessors_of(v: DataFrame) -> DataFrame:
    """Methods that annotations of a class or field stand for, marked as generated: like ``vertices_of``."""

    def has(names: tuple[str, ...], col: str) -> Column:
        return F.exists(F.coalesce(col, F.array().cast("array<string>")), lambda a: F.substring_index(a, ".", -1).isin(*names))

    types = v.where(F.col("kind") == "Class").select("repo", F.col("id").alias("owner_id"), F.col("annotations").alias("on_class"))
    fields = v.where("kind = 'Field' and not coalesce(is_static, false)").join(types, ["repo", "owner_id"])
    cap = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substr(name, 2)"))
    kind = F.trim(F.regexp_replace(F.regexp_replace(F.expr("substr(id, length(owner_id) + 2)"), r"<.*>", ""), r"\s+\S+$", ""))
    get = fields.where(has(GETTERS, "annotations") | has(GETTERS, "on_class")).withColumns({"name": F.concat(F.when(kind == "boolean", "is").otherwise("get"), cap), "sig": F.lit(""), "argc": F.lit(0)})
    put = fields.where(has(SETTERS, "annotations") | has(SETTERS, "on_class")).withColumns({"sig": kind, "name": F.concat(F.lit("set"), cap), "argc": F.lit(1)})
    both = get.unionByName(put)
    made = both.withColumns({"id": F.concat("owner_id", F.lit("."), "name", F.lit("("), "sig", F.lit(")")), "kind": F.lit("Method"), "annotations": F.array(F.lit("lombok.Generated")), "is_abstract": F.lit(False), "params": F.lit(None).cast("string")})
    return made.select(*v.columns).join(v.select("repo", "id"), ["repo", "id"], "left_anti").dropDuplicates(["repo", "id"]).select(*v.columns)


def methods_of(f: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, method_signature, method_code, class_name, start_line, end_line) of declared methods and constructors:
    ``Class.name( T a, U b )`` with type arguments, a constructor's name being <init>; the code by its lines."""
    d = f.where("fact = 'decl' and kind in ('Method', 'Constructor') and argc >= 0 and not array_contains(notes, 'ltm.Generated')")
    name = F.when(F.col("kind") == "Constructor", "<init>").otherwise(F.col("name"))
    sig = F.concat("owner", F.lit("."), name, F.lit("( "), F.coalesce("type", F.lit("")), F.lit(" )"))
    lines = files.select("file_id", F.split("code", r"\r\n|\r|\n").alias("l"))
    got = d.select("file_id", sig.alias("method_signature"), F.col("owner").alias("class_name"), F.col("start").alias("start_line"), F.col("end").alias("end_line")).distinct()
    return got.join(lines, "file_id").select("file_id", "method_signature", F.array_join(F.slice("l", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n").alias("method_code"), "class_name", "start_line", "end_line")


def unresolved(f: DataFrame, v: DataFrame) -> DataFrame:
    """(repo, type, files): names of types in the sources that no class of the repository answers to."""
    asked = f.where("fact in ('parent', 'ref', 'field') and type is not null and type <> ''").select("repo", "file_id", "pkg", "type").distinct()
    known = resolve(asked, f, v)
    return asked.join(known.select("repo", "file_id", "type"), ["repo", "file_id", "type"], "left_anti").groupBy("repo", "type").agg(F.count_distinct("file_id").alias("files"))


def vertices_of(f: DataFrame) -> DataFrame:
    """(repo, id, kind, …) of all declarations, with the accessors that annotations stand for."""
    v = declared(f)
    return v.unionByName(accessors_of(v)).drop("is_static")


def declared(f: DataFrame) -> DataFrame:
    d = f.where("fact = 'decl'")
    return d.select("repo", F.col("src").alias("id"), "kind", "name", F.when(F.col("owner") != "", F.col("owner")).alias("owner_id"), "argc", F.col("abstract").alias("is_abstract"), F.col("notes").alias("annotations"), F.col("type").alias("params"), F.col("flag").alias("is_static"), "file_id", "start", "end").dropDuplicates(["repo", "id"])


def resolve(names: DataFrame, f: DataFrame, v: DataFrame) -> DataFrame:
    """(repo, file_id, pkg, type, class_id): names in a file to classes of its repository.

    In order: the full name, an import of it, the same package, a wildcard import, and the only class of that simple name."""
    types = v.where(F.col("kind").isin("Class", "Interface", "Enum", "Annotation")).select("repo", F.col("id").alias("class_id"))
    simple = types.withColumn("s", F.substring_index("class_id", ".", -1))
    n = names.select("repo", "file_id", "pkg", "type").distinct().withColumn("s", F.substring_index("type", ".", -1))
    imp = f.where("fact = 'import' and not flag").select("repo", "file_id", F.col("name").alias("imp")).distinct()
    exact = n.join(types.select("repo", F.col("class_id").alias("type"), F.col("class_id").alias("c1")), ["repo", "type"]).select("repo", "file_id", "type", F.lit(1).alias("p"), F.col("c1").alias("class_id"))
    named = n.join(imp.withColumn("s", F.substring_index("imp", ".", -1)), ["repo", "file_id", "s"]).join(types.withColumnRenamed("class_id", "imp"), ["repo", "imp"]).select("repo", "file_id", "type", F.lit(2).alias("p"), F.col("imp").alias("class_id"))
    same = n.withColumn("class_id", F.concat_ws(".", "pkg", "type")).join(types, ["repo", "class_id"]).select("repo", "file_id", "type", F.lit(3).alias("p"), "class_id")
    wide = n.join(imp.where("imp like '%.*'"), ["repo", "file_id"]).withColumn("class_id", F.concat(F.expr("substr(imp, 1, length(imp) - 1)"), F.col("type"))).join(types, ["repo", "class_id"]).select("repo", "file_id", "type", F.lit(4).alias("p"), "class_id")
    only = simple.groupBy("repo", "s").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    any_ = n.join(only, ["repo", "s"]).select("repo", "file_id", "type", F.lit(5).alias("p"), "class_id")
    return exact.unionByName(named).unionByName(same).unionByName(wide).unionByName(any_).groupBy("repo", "file_id", "type").agg(F.min_by("class_id", F.struct("p", "class_id")).alias("class_id"))


#: The boxes of the primitive types.
BOXES = {"int": "Integer", "long": "Long", "short": "Short", "byte": "Byte", "char": "Character", "boolean": "Boolean", "float": "Float", "double": "Double"}


def misfits(args: Column, target: Column) -> Column:
    """How many arguments have another type than a method's id says: equal names, a box, or a longer name with the same end fit, and what is unknown does."""
    types = F.split(F.regexp_extract(target, r"\(([^()]*)\)$", 1), r",\s*")
    box = F.create_map(*[F.lit(x) for pair in BOXES.items() for x in pair])

    def differs(a: Column, t: Column) -> Column:
        same = (a == "?") | (a == t) | (F.try_element_at(box, a) == t) | (F.try_element_at(box, t) == a) | t.endswith(F.concat(F.lit("."), a)) | a.endswith(F.concat(F.lit("."), t))
        return F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)

    given = F.coalesce(args, F.array().cast("array<string>"))
    return F.aggregate(F.zip_with(given, F.slice(types, F.lit(1), F.size(given)), differs), F.lit(0), lambda m, x: m + x)


def arcs_of(f: DataFrame, v: DataFrame) -> DataFrame:
    """(repo, src, dst, arc_group, arc_kind): class, reference and call arcs, each once."""
    f, v = cut(f), cut(v)
    types = v.where(F.col("kind").isin("Class", "Interface", "Enum", "Annotation")).select("repo", "id", "kind")
    wanted = f.where("fact in ('parent', 'ref', 'field')").select("repo", "file_id", "pkg", "type").unionByName(
        f.where("fact = 'call' and kind in ('new', 'type', 'scoped')").select("repo", "file_id", "pkg", "type")
    ).unionByName(f.where("fact = 'use' and abstract").select("repo", "file_id", "pkg", F.col("owner").alias("type")))
    known = cut(resolve(wanted.where("type is not null and type <> ''"), f, v))

    def arc(df: DataFrame, src: str, dst: str, group, kind) -> DataFrame:
        return df.select("repo", F.col(src).alias("src"), F.col(dst).alias("dst"), group.alias("arc_group"), kind.alias("arc_kind"))

    lit = F.lit
    named = {"Class": "InnerClass", "Interface": "InnerClass", "Enum": "InnerEnum", "Annotation": "InnerAnnotation"}
    inner = F.create_map(*[lit(x) for kv in named.items() for x in kv])
    own = v.where("owner_id is not null").join(types.select("repo", F.col("id").alias("owner_id")), ["repo", "owner_id"])
    member = own.where(~F.col("kind").isin(*named))
    parts = [
        arc(own.where(F.col("kind").isin(*named)), "owner_id", "id", lit("InnerArc"), inner[F.col("kind")]),
        arc(member, "owner_id", "id", lit("MemberArc"), F.when(F.col("kind").isin("Field", "Method", "Constructor"), F.concat(F.col("kind"), lit("Member"))).otherwise(F.col("kind"))),
    ]
    parent = f.where("fact = 'parent'").join(known, ["repo", "file_id", "type"])
    parents = cut(parent.select("repo", F.col("class_id").alias("parent"), F.col("src").alias("child"), "kind").distinct())
    parts.append(arc(parents, "parent", "child", lit("ParentArc"), F.col("kind")))
    ref = f.where("fact = 'ref'").join(known, ["repo", "file_id", "type"])
    group = F.when(F.col("kind") == "AnnotationUse", "AnnotationReference").when(F.col("kind") == "FieldType", "FieldReference").otherwise("MethodReference")
    parts.append(arc(ref.where("src <> class_id"), "src", "class_id", group, F.col("kind")))
    # subtypes are referenced with their supertype
    sub = cut(closure(types.select("repo", F.col("id").alias("top"), "id"), parents.select("repo", F.col("parent").alias("src"), F.col("child").alias("dst")), ["repo", "top"], depth="d"))
    fan = ref.where("kind <> 'AnnotationUse'").join(sub.where("d > 0").select("repo", F.col("top").alias("class_id"), F.col("id").alias("below")), ["repo", "class_id"])
    parts.append(arc(fan.where("src <> below"), "src", "below", group, F.col("kind")))
    # uses of fields and enum constants
    fields = v.where("kind = 'Field'").select("repo", F.col("owner_id").alias("owner"), "name", F.col("id").alias("field"))
    use = f.where("fact = 'use' and not abstract").join(fields, ["repo", "owner", "name"]).where("src <> field")
    parts.append(arc(use, "src", "field", lit("UseReference"), F.when(F.col("flag"), "FieldDef").otherwise("FieldUse")))
    out = f.where("fact = 'use' and abstract").withColumnRenamed("owner", "type").drop("kind").join(known, ["repo", "file_id", "type"])
    enum = out.join(types.where("kind = 'Enum'").select("repo", F.col("id").alias("class_id")), ["repo", "class_id"])
    parts.append(arc(enum, "src", "class_id", lit("UseReference"), lit("EnumUse")))
    other = out.join(fields.withColumnRenamed("owner", "class_id"), ["repo", "class_id", "name"]).where("src <> field")
    parts.append(arc(other, "src", "field", lit("UseReference"), lit("FieldUse")))
    # calls: the receiver's class, then the nearest owner above it and every override below it
    call = f.where("fact = 'call'").select("repo", "file_id", "src", "owner", "kind", "name", F.col("type").alias("recv"), "argc", F.col("notes").alias("args"))
    typed = call.where("kind in ('new', 'type', 'scoped')").join(known.withColumnRenamed("type", "recv"), ["repo", "file_id", "recv"])
    selfs = call.where("kind in ('self', 'super')").withColumn("class_id", F.col("owner"))
    field_type = f.where("fact = 'field'").join(known, ["repo", "file_id", "type"]).select("repo", "owner", F.col("name").alias("recv"), "class_id").distinct()
    by_field = call.where("kind = 'field'").join(field_type, ["repo", "owner", "recv"])
    again = call.where("kind = 'this_new'").withColumn("class_id", F.col("owner"))
    above = call.where("kind = 'super_new'").join(parents.where("kind = 'Extends'").select("repo", F.col("child").alias("owner"), F.col("parent").alias("class_id")), ["repo", "owner"])
    above = above.withColumn("name", F.substring_index("class_id", ".", -1))
    selfs = selfs.unionByName(again).unionByName(above.select(*again.columns))
    cols = ["repo", "src", "kind", "name", "argc", "args", "class_id"]
    sited = cut(typed.select(*cols).unionByName(selfs.select(*cols)).unionByName(by_field.select(*cols)).distinct())
    methods = v.where(F.col("kind").isin("Method", "Constructor")).select("repo", F.col("owner_id").alias("o"), F.col("name").alias("name"), F.col("argc").alias("n"), F.col("id").alias("target"), F.col("kind").alias("tkind"))
    up = sub.select("repo", F.col("id").alias("class_id"), F.col("top").alias("o"), "d")
    fits = (F.col("argc") == F.col("n")) | (F.col("argc") < 0)
    near = sited.join(up, ["repo", "class_id"]).join(methods, ["repo", "o", "name"]).where(fits & (F.col("kind").isin(*_NEW) == (F.col("tkind") == "Constructor"))).where(~(F.col("kind").isin(*_NEW) & (F.col("d") > 0)))
    # the nearest owner's, and of its overloads the one that the arguments fit best
    near = near.groupBy("repo", "src", "class_id", "kind", "name", "argc", "args").agg(F.min_by("target", F.struct("d", misfits(F.col("args"), F.col("target")).alias("m"), "target")).alias("target"))
    down = sub.where("d > 0").select("repo", F.col("top").alias("class_id"), F.col("id").alias("o"))
    below = sited.where("kind in ('scoped', 'field', 'self')").join(down, ["repo", "class_id"]).join(methods, ["repo", "o", "name"]).where(fits & (F.col("tkind") == "Method"))
    lone = methods.where("tkind = 'Method'").groupBy("repo", "name", "n").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("k")).where("k = 1")
    unknown = call.where("kind = 'unknown'").join(lone.withColumnRenamed("n", "argc"), ["repo", "name", "argc"])
    for df in (near, below, unknown):
        parts.append(arc(df, "src", "target", lit("CallArc"), lit("NormalCall")))
    made = near.where("kind = 'new'").select("repo", "src", F.col("class_id").alias("owner_id")).distinct().join(v.where("kind = 'NormalInitializer'").select("repo", "owner_id", "id"), ["repo", "owner_id"])
    parts.append(arc(made, "src", "id", lit("CallArc"), lit("InitializerCall")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.distinct()
