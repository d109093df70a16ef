"""Cross-site lines against exact counts."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from batchloom.llm import common as helpers
from batchloom.llm.line_dedup import remove_spread_lines

SCHEMA = "doc_id long, text string, source string, n_lines string, gone string, key string"


def brute(rows, least, keep_whole):
    sites = defaultdict(set)
    for _, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            if source is not None:
                sites[line.strip(" \t\r")].add(source)
    spread = {line for line, s in sites.items() if line and len(s) >= least}
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        full = [x for x in lines if x.strip(" \t\r")]
        left = [x for x in lines if x.strip(" \t\r") not in spread]
        n_left = sum(x.strip(" \t\r") != "" for x in left)
        cut = n_left < len(full) and (n_left > 0 or not keep_whole)
        out.append((i, "\n".join(left) if cut else text, len(full), len(full) - n_left if cut else 0))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keep_whole", "frequent"), [(False, 64), (True, 64), (False, 2)])
def test_matches_exact_counts(spark, monkeypatch, keep_whole, frequent):
    monkeypatch.setattr(helpers, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(helpers, "FEW_ROWS", 0 if frequent == 2 else 100_000)
    rng = random.Random(3)
    common = [f"line {k}" for k in range(14)]
    rows = []
    for i in range(150):
        site = rng.randrange(14)
        # Line k is on sites up to k, so the spreads lie on both sides of the threshold.
        lines = [rng.choice(common[site:]) + rng.choice(["", " ", "\t"]) for _ in range(rng.choice([0, 1, 4]))] + [f"own {i} {j}" for j in range(rng.choice([0, 2]))] + [""] * rng.choice([0, 1])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{site}", "x"))
    rows += [(200, None, "s1", "x"), (201, "line 13\nsolo", None, "x"), (202, "line 13", "s2", "x"), (None, "line 13\nmine", "s3", "x"), (3, rows[3][1], "s9", "x"), (203, "line 13\n" + "long " * 9000, "s1", "x")]
    got = remove_spread_lines(spark, spark.createDataFrame([(*r, "y", "z") for r in rows], SCHEMA).repartition(3), min_sites=6, keep_whole=keep_whole)
    assert got.columns == ["doc_id", "text", "source", "gone", "key", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == brute(rows, 6, keep_whole)


def test_long_text_of_many_lines(spark):
    """Tens of thousands of lines, half of them spread: the cost follows the text."""
    shared = [f"shared {k}" for k in range(20_000)]
    rows = [(i, "\n".join(shared), f"s{i}", "", "", "") for i in range(3)]
    long = "\n".join(x for k in range(20_000) for x in (f"own {k}", f" shared {k}\t"))
    rows += [(9, long, "s0", "", "", ""), (10, "word " * 200_000, "s1", "", "", "")]
    got = {r["doc_id"]: r for r in remove_spread_lines(spark, spark.createDataFrame(rows, SCHEMA), min_sites=3).collect()}
    assert got[9]["text"] == "\n".join(f"own {k}" for k in range(20_000))
    assert (got[9]["n_lines"], got[9]["n_removed"], got[0]["text"], got[0]["n_removed"]) == (40_000, 20_000, "", 20_000)
    assert got[10]["text"] == "word " * 200_000


def test_empty(spark):
    assert remove_spread_lines(spark, spark.createDataFrame([], SCHEMA)).collect() == []
