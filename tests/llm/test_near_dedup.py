"""Near-duplicate groups against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest

from batchloom.llm.near_dedup import connected_components, near_duplicates

SCHEMA = "doc_id long, text string, sig string"


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 3 * len(sets[a]) <= 4 * len(sets[b]) and 3 * len(sets[b]) <= 4 * len(sets[a]):
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), i == find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 40, 120]))] for _ in range(12)]
    out = []
    for _ in range(90):
        doc = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            doc[rng.randrange(len(doc))] = rng.choice(words)
        out.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in doc))
    return [(i * 7 % 1009, t, "x") for i, t in enumerate([*out, "", None, "   ", "one", "ONE", "é É"])]


@pytest.mark.parametrize("seed", [1])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_clusters_of_many_cells(spark, monkeypatch):
    from batchloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CELL", 3)
    rows = corpus(3)
    got = near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)


def family(seed):
    """Pages that have two thirds of their words in common, and near copies of some of them."""
    rng = random.Random(seed)
    frame = [f"frame{i}" for i in range(80)]
    pages = [[*frame, *(f"p{i}w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 30])))] for i in range(50)]
    for i in range(25):
        copy = list(pages[i % 12])
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"changed{rng.random()}"
        pages.append(copy)
    rng.shuffle(pages)
    return [(i, " ".join(p), "") for i, p in enumerate(pages)]


@pytest.mark.parametrize("large", [4_096, 2])
def test_family_of_pages(spark, monkeypatch, large):
    """Buckets with many components; with a small ``LARGE``, split by rare shingles."""
    from batchloom.llm import common, near_dedup

    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "CELL", 20)
    monkeypatch.setattr(common, "LEAST_FREQUENT", 4)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    rows = family(large) + corpus(5)[:40]
    rows = [(i, t, "") for i, (_, t, _) in enumerate(rows)]
    got = near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_ids_with_several_texts(spark):
    """Their classes are one group; a long text is one set."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, ""), (5, a, ""), (3, b, ""), (5, b, ""), (7, c, ""), (8, c, ""), (8, None, ""), (9, " ".join(f"l{i}" for i in range(100_000)), "")]
    rows += [(10, rows[-1][1] + " more", "")]
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, 1, True), (5, 1, False), (3, 1, False), (5, 1, False), (7, 7, True), (8, 7, False), (8, 8, True), (9, 9, True), (10, 9, False)])


def test_recall_on_documents(spark):
    """All pairs of the 1,000 documents of the second smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in near_duplicates(spark, docs).collect()} == brute(rows)


def test_empty_null_and_repeated(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", ""), (1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, None, None)]
    got = sorted(map(tuple, near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)], key=str)


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(spark, links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
