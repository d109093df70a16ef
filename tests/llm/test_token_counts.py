"""Counts against the library."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from batchloom.llm import token_counts
from batchloom.llm.queries import tokenizer_path
from batchloom.llm.token_counts import BytePairCounter, count_tokens

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|>b<|endoftext|><|endoftext|>", " \n\n  x\t y  ", "日本語 text 'S's don't é́ 12 ½ ²", "x" * 5000 + "<|endoftext|", "ab " * 3000, "  a \u0085b​  \x1c \x1f", "\U0001f600  x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_odd_texts(library):
    counter = BytePairCounter(PATH)
    for text in ODD:
        assert counter.count(text) == expected(library, text), repr(text)


def test_random_texts_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBER", 50)
    counter, rng = BytePairCounter(PATH), random.Random(1)
    parts = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "'s", "1", "é", "***", ".", "\u0085", " ", "日", "tion", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == expected(library, text), repr(text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        n = expected(library, r["text"])
        assert got[r["doc_id"]] == (len(r["text"].encode()), n, n > 512)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")]
    got = sorted(map(str, map(tuple, count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=1).collect())))
    assert got == sorted(map(str, [(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True), (3, 3, 2, True), (3, 3, 2, True)]))
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
