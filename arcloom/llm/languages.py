"""Problem 10: the language of every document and of every segment of a mixed one.

The classifier (``ecoc``) is fitted on a bounded sample of the documents whose label names a
language: about ``sample`` rows, by the hash of their key (default 6000; the bound does not grow
with the corpus). They are counted in the executors, and only counts of fixed size reach the
driver. Everything else covers every document and its whole text.

Defined results: null, empty and blank texts, and texts of code, traces, numbers or symbols only,
have no sentence and so no language; a document's languages are those of its full sentences, an
ambiguous sentence counts only where the document has no clear one; ties of the loss go to the
first codeword; repeated rows give the same result; without any labelled sentence nothing can be
fitted and the result is empty; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.ecoc import DIM, Ecoc, counted, model_from
from arcloom.llm.prose import LANGS, NAMES, bare, sentences
from arcloom.llm.sampling import TASKS, drawn, gathered, sparse
from arcloom.tables import cut, table

SAMPLE = 6000
_SEGMENT = "array<struct<lang:string,confidence:double,ambiguous:boolean,first:int,sentences:int,chars:int>>"


def named_language(label):
    """Column form of ``language_of_label``: the code, or null where the label names no language."""
    x = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(v) for code in LANGS for n in NAMES[code].split() for v in (n, code)])
    return F.coalesce(F.try_element_at(names, x), F.try_element_at(names, F.regexp_extract(x, r"^([^-_ ]*)", 1)))


def model_of(docs: DataFrame, sample: int = SAMPLE) -> Ecoc | None:
    """Fit on about ``sample`` of the labelled documents; their n-grams are counted in the executors, once for
    the first model and once without the sentences it contradicts."""
    labelled = docs.select("doc_id", F.array_position(F.array(*[F.lit(x) for x in LANGS]), named_language(F.col("lang"))).cast("int").alias("y"), "text").where("y > 0")
    rows = cut(drawn(labelled, "doc_id", sample).where("text is not null").repartition(TASKS, "doc_id"))
    model = None
    for _ in range(2):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(LANGS), DIM), np.int64)
            for b in batches:
                texts, y = [], []
                for t, k in zip(b["text"], b["y"]):
                    got = [bare(s) for s in sentences(t)]
                    texts += got
                    y += [k - 1] * len(got)
                total += counted(texts, np.array(y, np.int64), len(LANGS), shared.value)
            yield from sparse({k: c for k, c in enumerate(total) if c.any()})

        total = np.zeros((len(LANGS), DIM), np.int64)
        for k, at, n in gathered(rows.mapInPandas(count, "key int, at array<int>, n array<long>")):
            total[k, at] += n
        if not total.any():
            return model
        model = model_from(total, list(LANGS))
    return model


def segments_of(text: str | None, model: Ecoc) -> list[dict]:
    """Runs of neighbouring sentences of one language."""
    return _segments([text], model)[0]


def _segments(texts: list[str | None], model: Ecoc) -> list[list[dict]]:
    per = [sentences(t) if t else [] for t in texts]
    flat = [s for ss in per for s in ss]
    best, conf, vague = model.decide([bare(s) for s in flat])
    out, at = [], 0
    for ss in per:
        runs: list[dict] = []
        clear = {model.labels[best[k]] for k in range(at, at + len(ss)) if not vague[k]}
        for n, s in enumerate(ss):
            k, lang = at + n, model.labels[best[at + n]]
            if vague[k] and clear and lang not in clear and runs:
                lang = runs[-1]["lang"]
            if runs and runs[-1]["lang"] == lang:
                r = runs[-1]
                r["confidence"] += conf[k]
                r["ambiguous"] &= bool(vague[k])
                r["sentences"] += 1
                r["chars"] += len(s)
            else:
                runs.append({"lang": lang, "confidence": float(conf[k]), "ambiguous": bool(vague[k]), "first": n, "sentences": 1, "chars": len(s)})
        for r in runs:
            r["confidence"] = round(float(r["confidence"]) / r["sentences"], 4)
        out.append(runs)
        at += len(ss)
    return out


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, segments) of every document."""
    model = model_of(docs, sample)
    rows = docs.select("doc_id", named_language(F.col("lang")).alias("label"), "text")
    if model is None:
        return rows.select("doc_id", "label", F.array().cast(_SEGMENT).alias("segments"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_SEGMENT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for i in range(0, len(s), 256):
                out += _segments(list(s.iloc[i : i + 256]), shared.value)
            yield pd.Series(out)

    return rows.select("doc_id", "label", found("text").alias("segments"))


def wrong_labels(found: DataFrame) -> DataFrame:
    """(doc_id, lang): documents whose label is missing or wrong, or that mix languages, with each of their languages."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    bad = found.select("doc_id", "label", langs.alias("langs")).where((F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("label").isNull() | (F.col("label") != F.element_at("langs", 1)))))
    return bad.select("doc_id", F.explode("langs").alias("lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(languages(table(spark, sf_dir, "documents")))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = languages(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "label", F.posexplode("segments").alias("segment", "s")).select("doc_id", "label", "segment", "s.*")


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
ORACLE: dict[str, str] = {}
