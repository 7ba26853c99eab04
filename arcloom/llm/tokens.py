"""Encoding of a whole corpus with a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is halved recursively down to leaves, the leaves are encoded, and neighbours are joined up
the tree. The value of a node (``Encoded``) is a monoid: joining is associative and the empty
text is neutral. A join re-encodes only a window around the boundary:

* on the left, words (pre-tokens) that end at least ``LOOK`` characters before the boundary are
  final: the pre-token pattern looks at most two characters past the end of a word (for
  contractions such as ``'ll``), and word-internal merges never cross a word's ends;
* on the right, the window grows until one of its word ends coincides with a word end of the right
  half. Matching from a word's end depends only on the text after it, so from there on the right
  half's words, and their ids, are those of the joined text.

Texts longer than ``far_chars`` are cut into rows first and joined by the same monoid over a tree
of groups of two, so that one huge text is encoded by many tasks; shorter ones stay in one task.

Defined results: empty and null texts give the empty list; strings that look like special tokens
are ordinary text; every row keeps its key, repeated rows are encoded each; lone surrogates cannot
occur in Spark strings. Other columns are not touched.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.tables import cut

TOKENIZERS = "/opt/tokenizers"
#: Characters after a word's end that the pre-token pattern may look at, plus the one that ends it.
LOOK = 3
LEAF_CHARS = 512
FAR_CHARS = 1 << 18


@dataclass
class Encoded:
    """The ids of ``text``; ``ends`` are the character ends of its words, ``upto`` the ids up to each."""

    text: str
    ids: list[int]
    ends: list[int]
    upto: list[int]


EMPTY = Encoded("", [], [], [])
_LOADED: dict[str, object] = {}


def tokenizer(folder: str, name: str):
    """The tokenizer file ``name`` of ``folder``, loaded once a worker."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _LOADED:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def _encoded(text: str, e) -> Encoded:
    ids, words, spans = e.ids, e.word_ids, e.offsets
    ends, upto, last = [], [], None
    for k, w in enumerate(words):
        if w != last:
            if last is not None:
                ends.append(spans[k - 1][1])
                upto.append(k)
            last = w
    if ids:
        ends.append(len(text))
        upto.append(len(ids))
    return Encoded(text, ids, ends, upto)


def leaves(text: str, size: int) -> list[str]:
    """Halve ``text`` until no part has more than ``size`` characters."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    return leaves(text[:mid], size) + leaves(text[mid:], size)


def join(a: Encoded, b: Encoded, tok) -> Encoded:
    """The encoding of ``a.text + b.text``."""
    if not a.text or not b.text:
        return a if not b.text else b
    k = bisect.bisect_right(a.ends, len(a.text) - LOOK)
    start = a.ends[k - 1] if k else 0
    left = len(a.text) - start
    head, n, text = (a.upto[k - 1] if k else 0), 2, a.text + b.text
    while True:
        whole = n >= len(b.ends)
        window = a.text[start:] + (b.text if whole else b.text[: b.ends[n - 1]])
        w = _encoded(window, tok.encode(window, add_special_tokens=False))
        sure = len(window) if whole else len(window) - LOOK
        for e, count in zip(w.ends, w.upto):
            if e > sure:
                break
            at = e - left
            m = bisect.bisect_left(b.ends, at)
            if at == 0 or (at > 0 and m < len(b.ends) and b.ends[m] == at):
                skip = 0 if at == 0 else m + 1
                cut_ids = b.upto[skip - 1] if skip else 0
                keep = bisect.bisect_right(w.ends, e)
                return Encoded(
                    text,
                    a.ids[:head] + w.ids[:count] + b.ids[cut_ids:],
                    a.ends[:k] + [start + x for x in w.ends[:keep]] + [len(a.text) + x for x in b.ends[skip:]],
                    a.upto[:k] + [head + x for x in w.upto[:keep]] + [head + count - cut_ids + x for x in b.upto[skip:]],
                )
        n *= 2


def tree(parts: list[Encoded], tok) -> Encoded:
    """Join neighbours level by level."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], tok) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def encode_all(texts: list[str], tok, leaf: int) -> list[Encoded]:
    """All leaves of all texts are encoded in one call, then each text's tree is joined."""
    cuts = [leaves(t, leaf) for t in texts]
    flat = [x for c in cuts for x in c]
    found = [_encoded(x, e) for x, e in zip(flat, tok.encode_batch(flat, add_special_tokens=False))]
    out, at = [], 0
    for c in cuts:
        out.append(tree(found[at : at + len(c)], tok))
        at += len(c)
    return out


def _ids_udf(folder: str, name: str, leaf: int):
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(folder, name)
        for s in batches:
            out = []
            for i in range(0, len(s), 512):
                out += [e.ids for e in encode_all([t or "" for t in s.iloc[i : i + 512]], tok, leaf)]
            yield pd.Series(out)

    return ids


def encode(
    df: DataFrame, key: str, text: str = "text", *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf_chars: int = LEAF_CHARS, far_chars: int = FAR_CHARS
) -> DataFrame:
    """(key, ids) of every row of ``df``; ``key`` is unique."""
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    near = rows.where(F.col("t").isNull() | (F.length("t") <= far_chars)).select("k", _ids_udf(folder, name, leaf_chars)("t").alias("ids"))
    most = rows.agg(F.max(F.length("t"))).first()[0] or 0
    out = near if most <= far_chars else near.unionByName(_far(rows.where(F.length("t") > far_chars), most, folder, name, leaf_chars, far_chars))
    return out.select(F.col("k").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


_NODE = "k {k}, i long, text string, ids array<int>, ends array<int>, upto array<int>"


def _far(rows: DataFrame, most: int, folder: str, name: str, leaf: int, far: int) -> DataFrame:
    """Long texts: one row for each ``far`` characters, joined in groups of two until one is left."""
    parts = rows.select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / far)), lambda i: F.substring(F.col("t"), (i * far + 1).cast("int"), F.lit(far)))).alias("i", "text"))
    node = _NODE.format(k=rows.schema["k"].dataType.simpleString())

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(folder, name)
        for b in batches:
            e = encode_all(list(b["text"]), tok, leaf)
            yield pd.DataFrame({"k": b["k"], "i": b["i"], "text": [x.text for x in e], "ids": [x.ids for x in e], "ends": [x.ends for x in e], "upto": [x.upto for x in e]})

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(folder, name)
        for b in batches:
            out = []
            for k, i, both in zip(b["k"], b["i"], b["both"]):
                e = tree([Encoded(x["text"], list(x["ids"]), list(x["ends"]), list(x["upto"])) for x in both], tok)
                out.append((k, i, e.text, e.ids, e.ends, e.upto))
            yield pd.DataFrame(out, columns=["k", "i", "text", "ids", "ends", "upto"])

    level = parts.repartition("k", "i").mapInPandas(first, node)
    left = -(-most // far)
    while left > 1:
        both = level.groupBy("k", F.expr("i div 2").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("n"), "text", "ids", "ends", "upto"))).alias("both"))
        level = cut(both.mapInPandas(pair, node))
        left = -(-left // 2)
    return level.select("k", "ids")


def decode(df: DataFrame, key: str, ids: str = "ids", *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): the round trip. Bytes of neighbouring halves concatenate up the tree, so one call a row does."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(folder, name)
        for s in batches:
            yield pd.Series([tok.decode(list(x), skip_special_tokens=False) if x is not None else None for x in s])

    return df.select(F.col(f"`{key}`"), text(F.col(f"`{ids}`")).alias("text"))
