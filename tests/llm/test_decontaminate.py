"""Greedy string tiling against a plain version, and planted passages."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from batchloom.llm.decontaminate import contaminated, greedy_tiles


def plain_tiles(item, text, least):
    """Repeatedly the longest common unmarked stretch, first in the item, then in the text."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not a[p + k] and not b[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return out
        a[p : p + k] = b[t : t + k] = [True] * k
        out.append((p, t, k))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_match_plain_version(seed):
    rng = random.Random(seed)
    item = [rng.randrange(rng.choice([3, 8, 60])) for _ in range(rng.choice([0, 4, 25, 60]))]
    text = [rng.randrange(8) for _ in range(10)]
    for _ in range(rng.choice([1, 4])):
        at = rng.randrange(len(item) or 1)
        text += item[at : at + rng.choice([4, 9, 45])] + [rng.randrange(70) for _ in range(3)]
    got, expected = greedy_tiles(item, text, 3), plain_tiles(item, text, 3)
    assert got == expected


def test_repetitive_long_text_stays_cheap():
    began = time.monotonic()
    assert greedy_tiles(np.zeros(500, int), np.zeros(200_000, int), 5) == [(0, 0, 500)]
    rng = np.random.default_rng(3)
    tiles = greedy_tiles(rng.integers(0, 2, 500), rng.integers(0, 2, 200_000), 5)
    # All stretches of five are left in the text, so no run of five is left in the item.
    left = [True] * 500
    for p, _, k in tiles:
        left[p : p + k] = [False] * k
    assert max(len(run) for run in "".join(" x"[x] for x in left).split(" ")) < 5
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("words", [1, 2])
def test_repetitive_tiles_match_plain_version(words):
    rng = random.Random(words)
    item, text = [rng.randrange(words) for _ in range(40)], [rng.randrange(words) for _ in range(150)]
    assert greedy_tiles(item, text, 5) == plain_tiles(item, text, 5)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def brute(docs, items, least=0.5):
    """All columns of all rows, by the plain tiler over whole texts."""
    out = []
    for doc, text in docs:
        t = words_of(text)
        for item, of in items:
            w = words_of(of)
            size = min(5, len(w))
            have = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
            if not w or not any(tuple(w[i : i + size]) in have for i in range(len(w) - size + 1)):
                continue
            tiles = plain_tiles(w, t, size)
            covered = sum(k for *_, k in tiles)
            if covered >= least * len(w):
                out.append((doc, item, len(w), covered, covered / len(w), len(tiles), max(k for *_, k in tiles)))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    from batchloom.llm.queries import op4_decontamination

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").collect() for n in ("documents", "benchmark"))
    got = sorted(map(tuple, op4_decontamination(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert got


def test_repeated_words_and_shared_seeds_match_brute_force(spark):
    """Items that share seeds with each other, items of one repeated word, and long repetitive texts."""
    rng = random.Random(12)
    items = [(1, "ha " * 30), (2, "ha " * 9 + "ho " * 9), (3, " ".join(rng.choice("abc") for _ in range(25))), (4, "a b"), (5, "ha ha ha"), (6, "a b c d e f g h i j k l m n"), (7, "e f g h i x y z a b c d e")]
    docs = [(i, " ".join(rng.choice(["ha", "ha", "ha", "ho", "a", "b", "c", "d e f g h i"]) for _ in range(rng.choice([0, 4, 30, 120])))) for i in range(40)] + [(99, "ha " * 3000)]
    got = contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_planted_passages(spark, monkeypatch):
    from batchloom.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "Only Three words"), (3, None), (4, ""), (None, "x1 x2 x3 x4 x5 x6"), (5, " ".join(f"q{i}" for i in range(30)))]
    noise = " ".join(f"n{i}" for i in range(50))
    docs = [
        (10, noise + " " + " ".join(words).upper() + "\n" + noise),
        (11, " ".join(words[20:]) + " " + noise + " " + " ".join(words[:20])),
        (12, " ".join(words[:19])),
        (13, "so ONLY three\twords here"),
        (14, "only three other words"),
        (15, noise),
        (16, None),
        (17, ""),
        (None, "x1 x2 x3 x4 x5 x6"),
        (10, "only three words"),
    ]
    docs = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    got = sorted((tuple(r) for r in contaminated(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == sorted(
        [(10, 1, 40, 40, 1.0, 1, 40), (11, 1, 40, 40, 1.0, 2, 20), (13, 2, 3, 3, 1.0, 1, 3), (10, 2, 3, 3, 1.0, 1, 3), (None, None, 6, 6, 1.0, 1, 6)], key=str
    )


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(spark, none, items).collect() == []
    assert contaminated(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
