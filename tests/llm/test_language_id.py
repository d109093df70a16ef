"""Segmentation sums against enumeration, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from batchloom.llm.language_id import FLOOR, Lattice, Pieces, identify, vocabulary
from batchloom.llm.queries import tokenizer_path

PIECES = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "aba": 5}


def every_way(word, p):
    """Sum over all segmentations, character by character where no piece fits."""
    if not word:
        return 1.0
    total = every_way(word[:-1], p) * FLOOR
    for k in range(1, len(word) + 1):
        if (i := PIECES.get(word[-k:])) is not None:
            total += every_way(word[:-k], p) * p[i]
    return total


def test_forward_and_expected_match_enumeration():
    words = ["a", "ab", "abab", "bbaba", "é", "aéb"]
    rng = np.random.default_rng(1)
    p = rng.random((6, 2))
    lattice = Lattice(words, Pieces(list(PIECES)))
    totals = lattice.totals(p)
    for w, row in zip(words, totals, strict=True):
        assert row == pytest.approx([every_way("▁" + w, p[:, k]) for k in range(2)])
    # The expected uses are the derivative of the log-likelihood by the log-probability.
    weight, q = np.arange(1.0, 7.0), p[:, 0]
    log = lambda x: float((weight * np.log(lattice.totals(x[:, None])[:, 0])).sum())
    expected = lattice.expected(q, weight)
    for i in range(6):
        up, down = q.copy(), q.copy()
        up[i] *= 1 + 1e-6
        down[i] *= 1 - 1e-6
        assert expected[i] == pytest.approx((log(up) - log(down)) / 2e-6, rel=1e-4, abs=1e-6)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = identify(spark, docs, tokenizer_path("piece_bpe_32k.model")).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)


def test_edge_rows(spark):
    rng = random.Random(2)
    known = [(i, " ".join(rng.choice(["the", "and", "house"] if i % 2 else ["der", "und", "haus"]) for _ in range(20)), "en" if i % 2 else "de", "x") for i in range(60)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 !!", "de", "x"), (None, "the house", None, "x"), (103, "日本" * 100, None, "x"), (104, "und der " * 5000, None, "x")]
    schema = "doc_id long, text string, lang string, score string"
    got = {r["doc_id"]: r for r in identify(spark, spark.createDataFrame(known + odd, schema), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert len(got) == 66
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"}
    assert (got[None]["lang_pred"], got[None]["held_out"], got[104]["lang_pred"]) == ("en", True, "de")
    assert got[103]["lang_pred"] in ("en", "de")
    nothing = spark.createDataFrame([(1, "the house", None, "x")], schema)
    assert [tuple(r)[2:] for r in identify(spark, nothing, tokenizer_path("piece_bpe_32k.model")).collect()] == [("und", 0.0)]
    assert identify(spark, nothing.limit(0), tokenizer_path("piece_bpe_32k.model")).collect() == []


def test_texts_without_letters(spark):
    """Numerals that are no decimal digits, and emoji, are no letters."""
    rows = [(i, "the house and the dog" if i % 2 else "das haus und der hund", "en" if i % 2 else "de", "") for i in range(40)]
    odd = ["½ ² ① Ⅷ", "123", "😀 🎉", "_ - _", "٣", "́"]
    got = identify(spark, spark.createDataFrame(rows + [(100 + i, t, "en", "") for i, t in enumerate(odd)], "doc_id long, text string, lang string, score string"), tokenizer_path("piece_bpe_32k.model"))
    assert {(r["lang_pred"], r["score"]) for r in got.where("doc_id >= 100").collect()} == {("und", 0.0)}


def test_sample_is_bounded(spark, monkeypatch):
    from batchloom.llm import language_id

    monkeypatch.setattr(language_id, "SAMPLE", 5)
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(learnt[0], f"same id {'abcdefgh'[i % 8]}", "en") for i in range(60)] + [(learnt[1], "same row", "en")] * 50
    rows += [(i, "ein satz", "de") for i in learnt[2:20]] + [(i, "une phrase", "fr") for i in learnt[20:30]] + [(i, "label", f"x{i}") for i in learnt[40:200]]
    found = language_id.sample_words(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"en", "de", "fr"}
    assert found["de"] == {"ein": 5, "satz": 5}
    assert found["en"].total() <= 15


def plain_model(sample, names):
    """Expectation maximisation over all segmentations, a word and a piece at a time."""
    pieces = {p: i for i, p in enumerate(names)}

    def edges(word):
        return [(a, b, pieces[word[a:b]]) for b in range(1, len(word) + 1) for a in range(max(0, b - 10), b) if word[a:b] in pieces]

    def sums(word, p):
        alpha, beta = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for b in range(1, len(word) + 1):
            alpha[b] = alpha[b - 1] * FLOOR + sum(alpha[a] * p[i] for a, e, i in edges(word) if e == b)
        for a in range(len(word) - 1, -1, -1):
            beta[a] = beta[a + 1] * FLOOR + sum(beta[e] * p[i] for s, e, i in edges(word) if s == a)
        return alpha, beta

    model = {}
    for lang, words in sample.items():
        p = [1 / len(names)] * len(names)
        for _ in range(3):
            uses = [0.05] * len(names)
            for w, n in words.items():
                w = "▁" + w
                alpha, beta = sums(w, p)
                for a, b, i in edges(w):
                    uses[i] += n * alpha[a] * p[i] * beta[b] / alpha[-1]
            total = sum(uses)
            p = [u / total for u in uses]
        model[lang] = p
    return lambda lang, word: math.log(sums("▁" + word, model[lang])[0][-1])


def test_predictions_match_plain_version(spark):
    """Every row of the query's result, by a plain model learnt from the same rows."""
    rng = random.Random(8)
    known = {"en": "the house and a dog went home", "de": "das haus und der hund ging heim", "fr": "la maison et le chien"}
    rows = []
    for i in range(50):
        lang = rng.choice(sorted(known))
        rows.append((i, " ".join(rng.choice(known[lang].split()) for _ in range(rng.choice([1, 2, 6]))) + rng.choice(["", " 12", "!"]), rng.choice([lang, lang, None])))
    rows += [(60, "dog hund chien", None), (61, "Ünïcode дом", None), (62, None, "en"), (63, "7", None)]
    names = vocabulary(tokenizer_path("piece_bpe_32k.model")).names
    sample = {}
    for i, t, lang in rows:
        if lang and t and zlib.crc32(str(i).encode()) % 5:
            sample.setdefault(lang, Counter()).update(regex.findall(r"\p{L}+", t.lower()))
    log = plain_model(sample, names)
    got = {r["doc_id"]: r for r in identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t, _ in rows:
        words = regex.findall(r"\p{L}+", (t or "").lower())
        totals = {k: sum(log(k, w) for w in words) for k in sorted(sample)}
        best = max(totals, key=totals.get) if words else "und"
        score = 1 / sum(math.exp(v - totals[best]) for v in totals.values()) if words else 0.0
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (zlib.crc32(str(i).encode()) % 5 == 0, best)
        assert got[i]["score"] == pytest.approx(score, rel=1e-6)
