"""Columns that are named like those an operator adds neither stop it nor get lost."""

import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_bpe import REFERENCE, TOOL

import corpus_pipeline
from tarmac.llm import bpe, pagetext
from tarmac.llm.common import prepare

NAMES = ["_id", "_hash", "_hits", "_score", "_rejected", "_lang", "_margin", "_node", "_keys", "_set", "_fp", "_text", "_ids", "x0", "X1", "id", "a", "b", "key", "t", "h", "quality", "part"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, small, name):
    step = dict(corpus_pipeline.STAGES)[name]
    prepare(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))
    got = step(spark, more, small)
    assert got.columns == more.columns
    rows = got.collect()
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in step(spark, docs, small).collect())


def test_added_columns_replace_those_of_their_name(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, "some text", 5, 6, 7)], "doc_id long, text string, _ids int, _offsets int, _bytes int")
    out = bpe.decode(bpe.encode(df, bpe.multi_path()), bpe.multi_path())
    assert out.columns == ["doc_id", "text", "_ids", "_offsets", "_bytes"] and out.first()._bytes == b"some text"
    pages = spark.createDataFrame([(1, "<p>x</p>", 5)], "page_id long, html string, _text int")
    assert [tuple(r) for r in pagetext.extract(pages, None).collect()] == [(1, "")]


def test_long_slices_take_seconds():
    assert tiktoken
    rng = np.random.default_rng(1)
    for text in ("".join(rng.choice(list("abcdeins"), 60_000)), "ab" * 20_000, "a" * 5_001):
        start = time.time()
        got = np.frombuffer(next(iter(TOOL.encode([text]))), "<u4").tolist()
        assert time.time() - start < 10 and got == REFERENCE.encode_ordinary(text)
