"""Targets and taken words against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from batchloom.llm import mixing


def plain_targets(sizes):
    """Share by weight; cap at twice the size; reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        above = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def plain(rows, quality):
    sizes, by_source = defaultdict(int), defaultdict(list)
    for i, text, source, *_ in rows:
        size = len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
        sizes[source] += size
        q = quality.get(i, 1.0)
        u = (int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by_source[source].append((-math.log(u) / (q if q and q > 0 else 1.0), i, size))
    targets, out = plain_targets(sizes), []
    for source, docs in by_source.items():
        n, target = sizes[source], targets[source]
        epochs = math.floor(target / n) if n else 0
        left = math.floor(target - epochs * n)
        for _, i, size in sorted(docs, key=lambda d: d[0]):
            part = min(size, left)
            left -= part
            out.append((i, size, n, pytest.approx(target), epochs * size + part))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 400])), rng.choice(["a", "a", "a", "a", "b", "é", "Z", None]), "x") for i in range(n)]
    return [*rows, (900, None, "b", "x"), (901, "\t\n", "lonely", "x"), (None, "a  b c", "Z", "x")]


@pytest.mark.parametrize("per_range", [200_000, 7])
def test_matches_plain_version(spark, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    rows = corpus(per_range)
    quality = {1: 2.0, 2: 0.5, 3: 0.0, 4: -1.0, 5: 1.5}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(3)
    got = mixing.mix(spark, docs, spark.createDataFrame([*quality.items(), (6, None), (5, 1.5)], "doc_id long, quality double")).collect()
    expected = {r[0]: r for r in plain(rows, quality)}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == expected[r["doc_id"]]
    by_source = defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        by_source[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(by_source[source[r["doc_id"]]] - r["target"]) <= 1 for r in got)


def test_heavier_documents_come_first(spark):
    """Inclusion grows with quality: of two weights, the heavier is taken first far more often."""
    rows = [(i, "w", "b" if i % 2 else "a", "x") for i in range(4000)]
    quality = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 1.0) for i in range(4000)], "doc_id long, quality double")
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, y string"), quality, weights=(1,), share=0.5).collect()
    heavy, light = (sum(r["taken"] for r in got if (r["doc_id"] % 4 < 2) is side) for side in (True, False))
    # Half are taken: u^4 + u = 1 for the share left out, so 1 - 0.2754 of the heavy and 1 - 0.7245 of the light.
    assert heavy / 2000 == pytest.approx(0.7246, abs=0.04) and light / 2000 == pytest.approx(0.2755, abs=0.04)


@pytest.mark.parametrize("quality", [0.001, 500.0])
def test_ranges_are_even_for_any_quality(spark, monkeypatch, quality):
    """Keys far from those of weight 1, and one row repeated very often, are dealt like others."""
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 100)
    rows = [(i, "w w", "a") for i in range(1200)] + [(5000, "w w w", "a")] * 800
    weights = spark.createDataFrame([(i, quality) for i in range(1200)], "doc_id long, quality double")
    kept = []
    write = mixing.written
    monkeypatch.setattr(mixing, "written", lambda spark, df, name: kept.append((name, out := write(spark, df, name))) or out)
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), weights)
    sizes = [r["count"] for r in dict(kept)["mix-ranges"].groupBy("range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 400
    found = got.collect()
    total = sum(r["size"] for r in found)
    assert total == 4800 and sum(r["taken"] for r in found) == 7200 and {r["target"] for r in found} == {7200.0}
    assert sorted(map(tuple, found)) == sorted(map(tuple, got.collect()))


def test_very_many_sources(spark, monkeypatch):
    """A source per document: they take turns at the weights in order of their names."""
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 50)
    rows = [(i, "w " * (i % 7), f"site{i * 7919 % 1000:04}") for i in range(600)] + [(700, "w w", None)]
    got = {r["doc_id"]: tuple(r) for r in mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[r[0]] == r for r in plain(rows, {}))


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.mix(spark, docs).collect()))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(1, 2, 4, 2), (1, 2, 4, 4), (2, 0, 0, 0)]
    assert mixing.mix(spark, docs.limit(0)).collect() == []
