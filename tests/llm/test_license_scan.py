"""License windows against exact containment of every window, and edge rows."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest

from batchloom.llm import license_scan
from batchloom.llm.license_scan import TEMPLATES, anchors, scan_licenses, template

SCHEMA = "doc_id long, text string, license string"


def brute(rows, templates=TEMPLATES):
    """Every template against every window of its length, one at every step."""
    found: dict[tuple, dict] = {}
    for i, text in rows:
        words = tuple(w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w)
        for t in templates:
            for at in range(0, len(words), t.step):
                window = words[at : at + len(t.words) + t.step - 1]
                have = {window[j : j + t.size] for j in range(len(window) - t.size + 1)}
                c = len(have & set(t.shingles)) / len(t.shingles)
                if c >= t.least:
                    one = found.setdefault((i, t.license), {})
                    one[at + 1] = max(c, one.get(at + 1, 0))
    return {(i, name, max(v.values()), len(v), min(v)) for (i, name), v in found.items()}


def texts(seed, n=40):
    rng = random.Random(seed)
    full = [t for t in TEMPLATES if t.least < 1]
    for i in range(n):
        words = [rng.choice(["the", "license", "under", "licensed", "a", "code", "über"]) for _ in range(rng.choice([0, 5, 40]))]
        for _ in range(rng.choice([0, 1, 2])):
            notice = list(rng.choice(full if rng.random() < 0.4 else TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, len(notice) // 25])):
                notice[rng.randrange(len(notice))] = rng.choice(["CODE", "the"])
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        yield i, rng.choice([" ", "\n", " -- ", "."]).join(w.upper() if rng.random() < 0.2 else w for w in words)


def scanned(spark, rows, templates=TEMPLATES):
    got = scan_licenses(spark, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), templates).collect()
    assert len(got) == len({(r["doc_id"], r["license"]) for r in got})
    return {tuple(r) for r in got}


@pytest.mark.parametrize("chunk", [1_024, 64])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(license_scan, "CHUNK", chunk)
    rows = [*texts(chunk), (100, None), (101, ""), (102, "All rights"), (None, "ALL RIGHTS reserved."), (None, "x"), (103, "x " * 3000 + "All rights reserved."), (104, "?!")]
    rows += [rows[1], (104, " ".join(TEMPLATES[5].words[:140]))]
    assert scanned(spark, rows) == brute(rows)


def test_own_templates(spark):
    own = (template("A", "Use of this file is free for everybody", 0.75), template("B", "internal only", 1.0))
    rows = [(1, "use of this file is FREE, for everybody!"), (2, "strictly internal; only"), (3, "internal"), (4, "file is free for everybody")]
    assert scanned(spark, rows, own) == brute(rows, own) != set()


def test_notices_are_told_from_other_versions(spark):
    rows = [(1, "Distributed under the GNU General Public License, version 3."), (2, "licensed under CC BY-NC 4.0"), (3, "SPDX-License-Identifier: MPL-2.0"), (4, "Released under the MIT license")]
    assert {(r[0], r[1]) for r in scanned(spark, rows)} == {(1, "GPL-3.0"), (2, "CC-BY-NC-4.0"), (3, "MPL-2.0"), (4, "MIT")}


@pytest.mark.parametrize("rare", [True, False])
def test_anchors_reach_every_window_that_counts(rare):
    often = Counter(w for t in TEMPLATES for w in set(t.words))
    chosen = anchors(TEMPLATES, often, rare)
    for t in TEMPLATES:
        without = sum(not any(w in s for w in chosen) for s in t.shingles)
        assert without / len(t.shingles) < t.least


def test_long_text_costs_in_proportion(spark):
    """A text of a million words with an anchor at every tenth of them."""
    began = time.monotonic()
    rows = [(1, "one two three four five six seven eight nine licensed " * 100_000 + "Released under the MIT License.")]
    assert {r[:2] for r in scanned(spark, rows)} == {(1, "MIT")}
    assert time.monotonic() - began < 120


def test_empty(spark):
    assert scan_licenses(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
