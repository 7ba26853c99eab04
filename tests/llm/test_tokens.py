import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tk.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")


def direct(text):
    return tk.tokenizer(tk.TOKENIZERS, "byte_bpe_50k").encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'sltrevmdaZ1é字🙂.,<|>\u3000\u0301endoftext")), max_size=80), st.integers(1, 9))
def test_tree_equals_the_whole(text, leaf):
    tok = tk.tokenizer(tk.TOKENIZERS, "byte_bpe_50k")
    assert tk.encode_all([text], tok, leaf)[0].ids == direct(text)


@settings(max_examples=100, deadline=None)
@given(*[st.text(alphabet=" 'sab1\n", max_size=12)] * 3)
def test_join_is_associative_and_empty_is_neutral(a, b, c):
    tok = tk.tokenizer(tk.TOKENIZERS, "byte_bpe_50k")
    x, y, z = (tk.encode_all([t], tok, 99)[0] for t in (a, b, c))
    left, right = tk.join(tk.join(x, y, tok), z, tok), tk.join(x, tk.join(y, z, tok), tok)
    assert left.ids == right.ids == direct(a + b + c)
    assert tk.join(tk.EMPTY, x, tok).ids == x.ids == tk.join(x, tk.EMPTY, tok).ids


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello world", "k"), (2, None, "t"), (3, "", "ids"), (4, "<|endoftext|>", "x"), (5, "hello world", "k"), (6, "   ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("k", F.lit(1)).withColumn("t", F.lit(2))
    got = {r["doc_id"]: r["ids"] for r in tk.encode(df, "doc_id").collect()}
    assert got == {i: direct(t or "") for i, t, _ in rows} and got[2] == [] and 50256 not in got[4]


def test_long_texts_go_through_the_distributed_tree(spark):
    texts = {1: "It's a long text, isn't it? 字🙂 " * 300, 2: "short", 3: "a" * 3000, 4: " " * 2500 + "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = tk.encode(df, "doc_id", leaf_chars=50, far_chars=700)
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {k: direct(v) for k, v in texts.items()}
    assert {r["doc_id"]: r["text"] for r in tk.decode(out, "doc_id").collect()} == texts


def test_empty_table(spark):
    assert tk.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0
