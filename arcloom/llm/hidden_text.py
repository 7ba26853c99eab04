"""Problem 3: natural language inside comments and literals of source files.

Comments and literals are taken out by the syntax of the content (``extract``), cut into
sentences, and broken into the subwords of a public tokenizer. A sentence goes to the class of
the highest posterior under smoothed unigram counts of subwords: one class for each language and
an explicit class for code. The counts come from a bounded, documented sample: about ``sample``
labelled documents and ``code_sample`` source files, by the hashes of their keys (the whole files'
code without comments and literals, and literals that are queries, are the code class). They are
counted in the executors. Classification covers every text of every file.

Defined results: null code has no text; a text counts for a language with at least four words or
eight Han or kana characters of that language in one comment or literal; names inside a sentence
do not count; unclosed comments and literals run to the end; equal posteriors go to the first
class in the order of ``CLASSES``; copies of a file give the same rows once for each file_id.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.extract import texts, without_texts
from arcloom.llm.languages import named_language
from arcloom.llm.prose import LANGS, bare, han_in, language_of_label, sentences
from arcloom.llm.sampling import TASKS, drawn, gathered, sparse
from arcloom.llm.syntax import extension
from arcloom.llm.tokens import TOKENIZERS
from arcloom.tables import table

SAMPLE = 4000
CODE_SAMPLE = 400
PLAIN = -30.0
CLASSES = (*LANGS, "code")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_QUERY = re.compile(r"^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE|AND|OR|ORDER BY|GROUP BY|LIMIT|JOIN|LEFT|SET|VALUES)\b")
_MARKS = re.compile(r"[;={}()<>\[\]|/\\_+*$%]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAGS = re.compile(r"(?m)^\s*[@:]\w+.*$|\{@\w+[^}]*\}|</?\w[^<>]*>")
_LOADED: dict[str, object] = {}
_ROWS = "file_id int, repo int, lang string, texts int, chars long, file_chars long"


def subwords(folder: str, name: str = "byte_bpe_multi_50k"):
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class Unigrams:
    """log P(subword | class), mixed with the pooled counts in a fixed share, so that a subword that
    a class does not know says the same about every class; the names in code are English words, so
    English knows a tenth of them. The prior of the code class is ``PLAIN``
    (a log ratio) for sentences without any of the marks code is made of."""

    def __init__(self, counts: np.ndarray):
        pooled = counts.sum(axis=0) + 0.1
        pooled /= pooled.sum()
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        share = counts / total
        share[0] = 0.9 * share[0] + 0.1 * share[-1]
        self.logp = np.log(0.85 * share + 0.15 * pooled).astype(np.float32)
        self.absent = counts.sum(axis=1) == 0

    def decide(self, ids: list[int], plain: bool = False, han: bool = True, cyrillic: bool = True) -> tuple[int, float]:
        """Class and posterior. A sentence without a script cannot be of the languages written in it."""
        s = self.logp[:, ids].sum(axis=1)
        s[self.absent] = -np.inf
        if not han:
            s[[CLASSES.index("zh"), CLASSES.index("ja")]] = -np.inf
        if not cyrillic:
            s[CLASSES.index("ru")] = -np.inf
        if plain:
            s[-1] += PLAIN
        best = int(s.argmax())
        return best, float(1 / np.exp(s - s[best]).sum())


def _class_of_document(text: str, label: str) -> list[tuple[int, str]]:
    c = CLASSES.index(language_of_label(label))
    return [(c, " " + bare(s)) for s in sentences(text)]


def _class_of_code(code: str, ext: str) -> list[tuple[int, str]]:
    plain = re.sub(r"\s+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", without_texts(code, ext))).lower()
    c = len(CLASSES) - 1
    return [(c, " " + plain)] + [(c, " " + bare(t)) for _, t in texts(code, ext)[1] if _QUERY.match(t)]


def _counts(rows: DataFrame, parts, folder: str) -> DataFrame:
    """(key, at, n): subword counts of ``parts(text, kind)`` of the rows (text, kind), a few rows a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = subwords(folder)
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for text, kind in zip(b["text"], b["kind"]):
                for c, t in parts(text, kind):
                    if c not in total:
                        total[c] = np.zeros(enc.n_vocab, np.int64)
                    np.add.at(total[c], enc.encode_ordinary(t), 1)
        yield from sparse(total)

    return rows.repartition(TASKS).mapInPandas(count, "key int, at array<int>, n array<long>")


def fit(docs: DataFrame, files: DataFrame, folder: str, sample: int = SAMPLE, code_sample: int = CODE_SAMPLE) -> Unigrams:
    """Counts of both samples, made in the executors; the driver adds up ``TASKS`` sparse rows a class."""
    labelled = docs.select("doc_id", "text", F.col("lang").alias("kind")).where(named_language(F.col("lang")).isNotNull())
    prose = drawn(labelled, "doc_id", sample).where("text is not null").select("text", "kind")
    # labels may be wrong: a class's counts that other classes explain far better are small, smoothing absorbs them
    coded = files.select("file_id", F.col("file_code").alias("text"), extension(F.col("file_path")).alias("kind"))
    code = drawn(coded, "file_id", code_sample).where("text is not null").dropDuplicates(["file_id"]).select("text", F.coalesce("kind", F.lit("")).alias("kind"))
    counts = np.zeros((len(CLASSES), subwords(folder).n_vocab), np.float64)
    for c, at, n in gathered(_counts(prose, _class_of_document, folder).unionByName(_counts(code, _class_of_code, folder))):
        counts[c, at] += n
    return Unigrams(counts)


def languages_in(text: str, model: Unigrams, enc, known: dict) -> dict[str, int]:
    """Characters of each language in one comment or literal that holds enough of it."""
    if len(text) < 8 or (len(text) < 400 and text.isascii() and len(_WORDS.findall(text)) < 4):
        return {}
    t = _TAGS.sub("\n", text)
    t = re.sub(r"(?<![.!?。！？:\n])[ \t]*\r?\n[ \t]*(?=\S)", " ", t)
    got: dict[str, list[int]] = {}
    for s in sentences(t, 2, 3):
        b = bare(s)
        plain = not _MARKS.search(s)
        cls = known.get((b, plain))
        if cls is None:
            if _QUERY.match(s):
                cls = "code"
            else:
                k, p = model.decide(enc.encode_ordinary(" " + b), plain, han_in(b) > 0, bool(_CYRILLIC.search(b)))
                cls = CLASSES[k] if plain or p >= 0.7 else "code"
            if len(known) > 200_000:
                known.clear()
            known[b, plain] = cls
        if cls != "code":
            g = got.setdefault(cls, [0, 0, 0])
            g[0] += len(_WORDS.findall(b))
            g[1] += han_in(b)
            g[2] += len(s)
    return {k: g[2] for k, g in got.items() if g[1] >= 8 or (k not in ("zh", "ja") and g[0] >= 4)}


def texts_of_files(docs: DataFrame, files: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(file_id, repo, lang, texts, chars, file_chars): the languages of every file, their texts and characters."""
    shared = files.sparkSession.sparkContext.broadcast(fit(docs, files, folder))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, known = subwords(folder), {}
        for b in batches:
            out = []
            for i, repo, ext, code in zip(b["file_id"], b["repo"], b["ext"], b["file_code"]):
                total: dict[str, list[int]] = {}
                for _, t in texts(code, ext)[1]:
                    for lang, n in languages_in(t, shared.value, enc, known).items():
                        x = total.setdefault(lang, [0, 0])
                        x[0] += 1
                        x[1] += n
                out += [(i, repo, lang, n, c, len(code)) for lang, (n, c) in total.items()]
            yield pd.DataFrame(out, columns=["file_id", "repo", "lang", "texts", "chars", "file_chars"]).astype({"repo": "Int32"})

    rows = files.where(F.col("file_code").isNotNull()).select("file_id", "repo", extension(F.col("file_path")).alias("ext"), "file_code")
    return rows.mapInPandas(found, _ROWS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_of_files(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_file")).select("file_id", "lang").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's texts in a file and its share of the file's characters."""
    got = texts_of_files(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_file"))
    one = got.groupBy("file_id", "lang").agg(F.first("repo").alias("repo"), F.first("texts").alias("texts"), F.first("chars").alias("chars"), F.first("file_chars").alias("n"))
    return one.select("file_id", "repo", "lang", "texts", "chars", F.round(F.col("chars") / F.col("n"), 4).alias("share"))


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares}
ORACLE: dict[str, str] = {}
