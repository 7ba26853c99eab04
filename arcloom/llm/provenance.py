"""Problem 7: source files that nobody wrote by hand: generated, minified, vendored, or data.

The judgement is by names. Every file is measured in one pass over its whole text; a character
trigram model of identifiers is trained for each language on the names of all files:

* mangled names: the cross-entropy of the file's distinct names (bits a character) far above the
  language's median over all files, with mostly one- and two-letter names: minified or bundled;
* template-like names: low diversity, a large share of names that are a stem with a counter:
  generated (a tool's notice at the head says the same, and tools that write hashes do so too);
* foreign naming: folder names that neither the names of the file's own repository nor those of its
  language (the file itself left out) would suggest: vendored by the style alone where it is very
  strange, with lines that are in other repositories, too, where it is less so. Known copies need no
  strange style: names of a folder and its files that are the same in other repositories, confirmed
  by a sketch of the lines shared with those copies;
* hardly any names, nearly only literals: data saved as code.

Scale: files are read once, only measures of fixed size leave the pass; folder statistics are
distinct counts combined on the map side; copies are found through at most ``SKETCH`` line hashes a
file, grouped by (folder, name, hash), so no group of copies is gathered or compared in pairs. Names
are counted in each partition and the counts added up by repository and by language; the files of
a repository meet its counts in pieces of ``PIECE`` files.

Defined results: null code is never a case; files overwritten by something that is no program of
their language (dumps, pages) are not data; ties do not occur in thresholds (>=); copies delivered
twice are one row; a null path has no folder; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.extract import content_language, without_texts
from arcloom.llm.sampling import gathered, sparse
from arcloom.llm.syntax import extension
from arcloom.tables import cut, table

SKETCH = 64
#: Lines under more different file names than this belong to licences and idioms, not to one library.
COMMON = 20
PIECE = 5000
MANGLED = 1.2
#: Bits a letter, and times the typical file's, of a folder name that is foreign by itself, and with copied lines.
STRANGE, BESIDE = (3.6, 2.5), (3.0, 2.0)
NUMBERED = 0.09

_PROGRAM = ("java", "js", "py")
_ID = re.compile(r"[A-Za-z_$][\w$]*", re.A)
_LITERAL = re.compile(r"[0-9a-fA-F]{12,}|[A-Za-z0-9+/=]{30,}|-?\d+\.\d+|\d+")
_DECLARES = re.compile(r"\b(?:class|const|var|let|function|window|static|final|def)\b|(?m:^\s*[\w.]+\s*=\s*[\[{(])")
_DUMP = re.compile(r"\s*[0-9a-fA-F]{8}:? (?:[0-9a-fA-F]{2,4} ){4}")
#: Notices that tools leave at the head of what they write.
_NOTICE = re.compile(
    r"(?i)@generated\b|<auto-generated|auto-?generated (?:file|by|code)|(?:code|file) (?:was |is )?(?:generated|produced|created) (?:by|automatically|from)|generated (?:by|from) the|was created automatically"
    r"|automatisch (?:erzeugt|generiert|erstellt)|(?:produit|généré|genere) (?:par|automatiquement)|自动生成|自動生成|generado (?:por|automáticamente)|gerado (?:por|automaticamente)|(?:сгенерирован|создан) автоматически|do not edit!|@Generated\s*\("
)
#: All that may stand before the first declaration: comments, annotations, imports, prologues.
_HEAD = re.compile(
    r"(?:[\s\ufeff]++|//[^\n\r]*+|/\*[\s\S]*?\*/|#[^\n\r]*+|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![^>]*+>|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|[\"']use strict[\"'];?"
    r"|(?:package|import|from)\b[^\n\r;]*+;?|@(?!interface\b)[\w.]++(?:\s*\((?:[^()\"]|\"(?:[^\"\\\n]|\\.)*+\"|\([^()]*+\))*+\))?|(?:public|final|abstract)\b)*+"
)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0_$^"
_CODE = np.full(128, len(_ALPHABET), np.int64)
for _k, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _k
for _c in "123456789":
    _CODE[ord(_c)] = _ALPHABET.index("0")
_N = len(_ALPHABET) + 1
_SPARSE = "key string, at array<int>, n array<long>"


def bare(code: str, ext: str) -> tuple[str, str]:
    """(content language, the code outside comments and literals)."""
    lang = content_language(code, ext)
    return lang, code if lang in ("json", "xml") else without_texts(code, ext)


def names_of(code: str, ext: str) -> tuple[str, list[str]]:
    """(content language, identifiers) outside comments and literals."""
    lang, text = bare(code, ext)
    return lang, _ID.findall(text)


def _codes(names: list[str]) -> np.ndarray:
    raw = np.frombuffer(("^^" + "^^".join(n.lower() for n in names) + "^").encode("ascii", "replace"), np.uint8)
    return _CODE[np.minimum(raw, 127)]


class Trigrams:
    """Interpolated character trigrams of distinct names."""

    def __init__(self, counts: np.ndarray):
        c3 = counts + 0.0
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1)) + 1
        p1 = c1 / c1.sum()
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        self.bits = -np.log2((c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5))

    @staticmethod
    def counted(names: list[str], into: np.ndarray) -> None:
        c = _codes(names)
        np.add.at(into, (c[:-2], c[1:-1], c[2:]), 1)

    def entropy(self, names: list[str]) -> float:
        c = _codes(names)
        return float(self.bits[c[:-2], c[1:-1], c[2:]].mean())


def sketch_of(code: str) -> list[int]:
    """The least hashes of the distinct lines that say something."""
    lines = {s for line in code.splitlines() if len(s := line.strip()) >= 25}
    return sorted(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) for s in lines)[:SKETCH]


_MEASURES = (
    "file_id int, repo int, ext string, idents string, folder string, name string, lang string, same_kind boolean, short double, numbered double, names int, "
    "literal double, notice boolean, declares boolean, tool_path boolean, third_path boolean, sketch array<long>"
)


def measure(path: str | None, code: str, ext: str) -> tuple:
    lang, text = bare(code, ext)
    ids = _ID.findall(text)
    n = max(len(ids), 1)
    distinct = sorted(set(ids))
    p = (path or "").replace("\\", "/").lower().split("/")
    folder = "/".join(p[-3:-1]) if len(p) >= 3 else ""
    numbered = sum(1 for i in ids if len(i) > 3 and any(c.isdigit() for c in i[2:])) / n
    counters = sum(1 for i in ids if re.fullmatch(r"[A-Za-z]+_*\d+", i)) / n
    literal = sum(map(len, _LITERAL.findall(code))) / max(len(code), 1)
    whole = "/".join(p)
    return (
        ext,
        " ".join(distinct) if ext in _PROGRAM or lang in _PROGRAM else "",
        folder,
        p[-1],
        lang,
        lang == ext or (lang in _PROGRAM and ext in _PROGRAM),
        sum(len(i) <= 2 for i in ids) / n,
        max(numbered, counters if len(distinct) > 12 else 0.0),
        len(distinct),
        literal,
        bool(_NOTICE.search(_HEAD.match(code).group())),
        bool(_DECLARES.search(text)) and not _DUMP.match(code),
        bool(re.search(r"(?:^|/)(?:generated(?:-sources|-src)?|src-gen|gen-src|autogen)/", whole)),
        bool(re.search(r"^(?:vendor|third_party|third-party|thirdparty|external|libs)/|(?:^|/)(?:node_modules|bower_components)/", whole)),
        sketch_of(code),
    )


def measures(files: DataFrame) -> DataFrame:
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.strip().split(" ")[0] for c in _MEASURES.split(",")]
        for b in batches:
            out = [(i, repo, *measure(path, code, ext)) for i, repo, path, ext, code in zip(b["file_id"], b["repo"], b["file_path"], b["ext"], b["file_code"])]
            yield pd.DataFrame(out, columns=cols).astype({"repo": "Int32"})

    rows = files.where(F.col("file_code").isNotNull()).select("file_id", "repo", "file_path", F.coalesce(extension(F.col("file_path")), F.lit("")).alias("ext"), "file_code")
    return rows.mapInPandas(one, _MEASURES)


def _grams(names: list[str]) -> np.ndarray:
    c = _codes(names)
    return (c[:-2] * _N + c[1:-1]) * _N + c[2:]


def _added(rows: DataFrame) -> DataFrame:
    """(key, at, n): sparse counts added up by key, one key at a time in sorted partitions."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, np.zeros(_N**3, np.int64)
        for b in batches:
            for k, g, n in zip(b["key"], b["at"], b["n"]):
                if k != key:
                    if key is not None:
                        yield from sparse({key: total})
                    key, total = k, np.zeros(_N**3, np.int64)
                total[np.asarray(g, np.int64)] += np.asarray(n, np.int64)
        if key is not None:
            yield from sparse({key: total})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(one, _SPARSE)


def _dense(at, n) -> np.ndarray:
    c = np.zeros(_N**3, np.int64)
    c[np.asarray(at, np.int64)] = np.asarray(n, np.int64)
    return c


def _models(counts: DataFrame) -> dict[str, Trigrams]:
    """The models of the languages, from their counts (a row a language)."""
    return {k: Trigrams(_dense(at, n).reshape(_N, _N, _N)) for k, at, n in gathered(counts)}


def name_entropies(m: DataFrame) -> DataFrame:
    """(file_id, lang, entropy): bits a character of each program's distinct names, by a model of the names of all files of its language.

    The names of all files are counted, and a second time without those of the strangest sixth of the
    first model, which may be machine-made.
    """
    named = m.where(F.col("lang").isin(*_PROGRAM) & (F.col("idents") != "")).select("file_id", "lang", "idents")
    sc = m.sparkSession.sparkContext

    def counted(models, limits) -> DataFrame:
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: dict[str, np.ndarray] = {}
            for b in batches:
                for lang, idents in zip(b["lang"], b["idents"]):
                    names = idents.split(" ")
                    if models is None or models.value[lang].entropy(names) <= limits[lang]:
                        np.add.at(counts.setdefault(lang, np.zeros(_N**3, np.int64)), _grams(names), 1)
            yield from sparse(counts)

        return _added(named.select("lang", "idents").mapInPandas(one, _SPARSE))

    def entropies(models) -> DataFrame:
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"file_id": b["file_id"], "lang": b["lang"], "entropy": [models.value[k].entropy(i.split(" ")) for k, i in zip(b["lang"], b["idents"])]}).astype({"entropy": "float64"})

        return named.mapInPandas(one, "file_id int, lang string, entropy double")

    first = sc.broadcast(_models(counted(None, None)))
    limits = {r["lang"]: r["limit"] for r in entropies(first).groupBy("lang").agg(F.percentile_approx("entropy", 0.84).alias("limit")).collect()}  # a row a language
    return entropies(sc.broadcast(_models(counted(first, limits))))


class _Counts:
    """Trigram counts that a file's own can be taken out of."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.context = counts, counts.reshape(_N * _N, _N).sum(axis=1)

    def p(self, asked: np.ndarray, own: np.ndarray, back: np.ndarray) -> np.ndarray:
        mine = np.array([(own == a).sum() for a in asked])
        around = np.array([(own // _N == a // _N).sum() for a in asked])
        return (self.counts[asked] - mine + 5 * back) / (self.context[asked // _N] - around + 5)


def name_counts(m: DataFrame) -> DataFrame:
    """(key, at, n): trigrams of the names of each repository (r), of each language's identifiers (i) and folders (f)."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for repo, ext, idents, folder in zip(b["repo"], b["ext"], b["idents"], b["folder"]):
                ids, fold = (_grams(x) if x else np.zeros(0, np.int64) for x in (idents.split(), [f for f in folder.split("/") if f]))
                for key, grams in ((f"r{repo}", ids), (f"r{repo}", fold), (f"i{ext}", ids), (f"f{ext}", fold)):
                    if key not in counts:
                        counts[key] = np.zeros(_N**3, np.int64)
                    np.add.at(counts[key], grams, 1)
            if len(counts) > 200:
                yield from sparse(counts)
                counts = {}
        yield from sparse(counts)

    return _added(m.select("repo", "ext", "idents", "folder").mapInPandas(one, _SPARSE))


def styles(m: DataFrame) -> DataFrame:
    """(file_id, style): bits a letter of the file's strangest folder name, by whichever knows it best of
    the models of its repository's names and of its language's identifiers and folders, without the file's own."""
    named = m.where(F.col("ext").isin(*_PROGRAM) & F.col("repo").isNotNull())
    counts = cut(name_counts(named))

    # a row a language and kind
    of_lang = {k: _dense(at, n) for k, at, n in gathered(counts.where("key not like 'r%'"))}
    shared = m.sparkSession.sparkContext.broadcast(of_lang)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs: dict[str, tuple] = {}
        for ext in {k[1:] for k in shared.value}:
            c2 = shared.value[f"i{ext}"].reshape(_N, _N, _N).sum(axis=0)
            c1 = c2.sum(axis=0) + 1
            p2 = (c2 + 5 * c1 / c1.sum()) / (c2.sum(axis=1, keepdims=True) + 5)
            langs[ext] = p2, _Counts(shared.value[f"i{ext}"]), _Counts(shared.value[f"f{ext}"])
        repo = None
        for b in batches:
            out = []
            for i, ext, idents, folder, at, n in zip(b["file_id"], b["ext"], b["idents"], b["folder"], b["at"], b["n"]):
                if at is not None:
                    repo = _Counts(_dense(at, n))
                    continue
                own_i = _grams(idents.split()) if idents else np.zeros(0, np.int64)
                own_f = _grams(folder.split("/"))
                p2, of_ids, of_folders = langs[ext]
                bits = 0.0
                for f in folder.split("/"):
                    if len(f) >= 3:
                        asked = _grams([f])[1:]
                        pi = of_ids.p(asked, own_i, p2[asked // _N % _N, asked % _N])
                        pf = of_folders.p(asked, own_f, pi)
                        pr = repo.p(asked, np.concatenate([own_i, own_f]), pi)
                        bits = max(bits, min(float(-np.log2(p).mean()) for p in (pi, pf, pr)))
                out.append((i, bits))
            yield pd.DataFrame(out, columns=["file_id", "style"]).astype({"file_id": "int32", "style": "float64"})

    pieces = named.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    files = named.where("folder <> ''").select("file_id", "repo", "ext", "idents", "folder").join(pieces, "repo")
    files = files.select(F.concat(F.lit("r"), "repo").alias("key"), F.pmod(F.xxhash64("file_id"), "pieces").cast("int").alias("piece"), "file_id", "ext", "idents", "folder")
    repos = counts.join(pieces.select(F.concat(F.lit("r"), "repo").alias("key"), "pieces"), "key").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    both = repos.unionByName(files, allowMissingColumns=True).repartition("key", "piece").sortWithinPartitions("key", "piece", F.col("file_id").asc_nulls_first())
    return both.select("file_id", "ext", "idents", "folder", "at", "n").mapInPandas(one, "file_id int, style double")


def common(m: DataFrame) -> DataFrame:
    """(h): lines under so many file names that they say nothing about where a file comes from."""
    lines = m.select("name", F.explode("sketch").alias("h"))
    return lines.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") > COMMON).select("h")


def strange(m: DataFrame, common: DataFrame) -> DataFrame:
    """(file_id): files in folders with foreign names, by these alone or with lines of other repositories beside them."""
    s = cut(styles(m))
    typical = s.join(m.select("file_id", "ext"), "file_id").groupBy("ext").agg(F.percentile_approx("style", 0.5).alias("typical"))
    known = m.join(s, "file_id").join(F.broadcast(typical), "ext").where("same_kind and names > 0")

    def above(bits: float, times: float):
        return (F.col("style") >= bits) & (F.col("style") >= times * F.col("typical"))

    near = known.where(above(*BESIDE) & ~above(*STRANGE)).select("file_id", F.explode("sketch").alias("h")).join(common, "h", "left_anti")
    lines = m.select("repo", F.explode("sketch").alias("h")).groupBy("h").agg((F.min("repo") < F.max("repo")).alias("copied"))
    overlap = near.join(lines, "h").groupBy("file_id").agg(F.avg(F.col("copied").cast("double")).alias("overlap"))
    return known.where(above(*STRANGE)).select("file_id").unionByName(overlap.where("overlap >= 0.7").select("file_id")).distinct()


def foreign(m: DataFrame, common: DataFrame) -> DataFrame:
    """(file_id): files whose folder and name are the same in other repositories, and whose lines are, too."""
    named = m.where(F.col("folder") != "").select("file_id", "repo", "folder", "name", "sketch")
    pairs = named.select("folder", "name", "repo").distinct()
    names = pairs.groupBy("folder", "name").agg(F.count(F.lit(1)).alias("r")).groupBy("folder").agg(F.sum("r").alias("pairs"), F.count(F.lit(1)).alias("n"))
    repos = pairs.select("folder", "repo").distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("repos"))
    style = names.join(repos, "folder").where("repos >= 2").where(F.col("pairs") / (F.col("n") * F.col("repos")) >= 0.15)
    cand = named.join(style.select("folder"), "folder")
    lines = cand.select("file_id", "repo", "folder", "name", F.explode("sketch").alias("h")).join(common, "h", "left_anti")
    known = lines.groupBy("folder", "name", "h").agg((F.min("repo") < F.max("repo")).alias("copied"))
    overlap = lines.join(known, ["folder", "name", "h"]).groupBy("file_id").agg(F.avg(F.col("copied").cast("double")).alias("overlap"))
    return overlap.where("overlap >= 0.7").select("file_id")


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo, lang, kind, rules): each file that is not hand-written, with what it is (by the first rule) and all rules that tell."""
    m = cut(measures(files).dropDuplicates(["file_id"]))
    bits = cut(name_entropies(m))
    plain = cut(common(m))
    typical = bits.groupBy("lang").agg(F.percentile_approx("entropy", 0.5).alias("typical"))
    far = foreign(m, plain).withColumn("foreign", F.lit(True))
    odd = strange(m, plain).withColumn("strange", F.lit(True))
    told = m.drop("idents", "sketch").join(bits.select("file_id", "entropy"), "file_id", "left")
    both = told.join(F.broadcast(typical), "lang", "left").join(far, "file_id", "left").join(odd, "file_id", "left")
    program, same = F.col("lang").isin(*_PROGRAM), F.col("same_kind")
    rules = {
        "copied lines": ("vendored", F.col("foreign")),
        "third-party folder": ("vendored", F.col("third_path") & same),
        "mangled names": ("minified", program & (F.col("entropy") >= MANGLED * F.col("typical")) & (F.col("short") >= 0.38) & (F.col("names") >= 12) & F.col("declares")),
        "notice": ("generated", F.col("notice") & same),
        "generator's folder": ("generated", F.col("tool_path") & same),
        "counted names": ("generated", (program | (F.col("lang") == "xml")) & (F.col("numbered") >= NUMBERED) & same & (F.col("declares") | (F.col("lang") == "xml"))),
        "hashes": ("generated", (F.col("lang") == "json") & (F.col("literal") >= 0.3) & same),
        "literals": ("data", program & (F.col("literal") >= 0.4) & (F.col("names") <= 30) & F.col("declares")),
        "foreign names": ("vendored", F.col("strange")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"))) for n, (k, c) in rules.items()]), lambda x: x.isNotNull())
    got = both.select("file_id", "repo", "lang", found.alias("found")).where(F.size("found") > 0)
    return got.select("file_id", "repo", "lang", F.element_at("found", 1)["kind"].alias("kind"), F.transform("found", lambda x: x["rule"]).alias("rules"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "code_file")).select("file_id")


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written by repository, language and kind."""
    return judged(table(spark, sf_dir, "code_file")).groupBy("repo", "lang", "kind").agg(F.count(F.lit(1)).alias("files"))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each rule finds, and how many it alone."""
    each = judged(table(spark, sf_dir, "code_file")).select(F.explode("rules").alias("rule"), (F.size("rules") == 1).alias("alone"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("files"), F.count_if("alone").alias("alone"))


QUERIES = {"p7_found": p7_found, "p7_kinds": p7_kinds, "p7_rules": p7_rules}
ORACLE: dict[str, str] = {}
