"""Archives against the rows they were made of, and the loser tree against sorting."""

from __future__ import annotations

import hashlib
import random

from batchloom.llm import warc

SCHEMA = "page_id long, url string, html string, offset string"


def test_loser_tree_sorts():
    rng = random.Random(4)
    for k in [0, 1, 2, 3, 7, 16, 40]:
        runs = [sorted((rng.randrange(50),) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
        assert list(warc.merged(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("http://www.A.example.com:80/Fr?x=1#t") == "com,example,a)/fr?x=1"
    assert warc.url_key(None) == "-"
    assert warc.url_key("http://[bad") == "http://[bad"


def test_round_trip_and_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    big, small = "é" * 700, "short"
    rows = [(i, f"http://h{i % 7}.example.com/{(i * 37) % 11}", big if i % 3 == 0 else f"{i}" * 600 if i % 3 == 1 else small, "x") for i in range(120)]
    rows += [(500, None, None, "x"), (501, "http://x/\r\nWARC-Type: bad", "", "x"), (None, "http://x/", big, "x"), (117, "http://again/", big, "x")]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    expected = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in rows if p is not None and (h or "").encode() == raw]
        revisit = len(raw) >= 1000 and max(same) != page
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    in_order(got)
    assert len({r["range"] for r in got}) > 1


def in_order(got):
    """Ranks count from 1, follow range and position, and put keys, times and pages in order, missing pages first."""
    got = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [(r["range"], r["position"]) for r in got] == sorted((r["range"], r["position"]) for r in got)
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)


def test_any_page_id(spark):
    """Ids of 64 bits, as hashes are, and one missing id in many rows."""
    ids = [2**63 - 1, -(2**63), 10**15, -(10**11), 3 * 10**11, 0, -1]
    rows = [(i, "http://x/", "a" * 2000, "") for i in ids] + [(None, "http://x/", f"{k % 3}" * 1500, "") for k in range(30)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None) == sorted((i, "response" if i == max(ids) else "revisit", None if i == max(ids) else max(ids)) for i in ids)
    assert sum(r["page_id"] is None and r["record_type"] == "response" for r in got) == 30
    in_order(got)


def test_nulls_in_order_across_ranges(spark, monkeypatch):
    """Rows of one key and time, some without an id, on both sides of a range's border."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    monkeypatch.setattr(warc, "EPOCH_SECONDS", 1)
    rows = [(None if i % 3 else i, "http://one/", "x" * i, "") for i in range(90)]
    in_order(warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


def test_long_page_and_many_copies(spark, monkeypatch):
    from batchloom.llm import common

    monkeypatch.setattr(common, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    rows = [(i, f"http://h/{i}", "copy " * 300, "") for i in range(50)] + [(100, "http://long/", "é" * 3_000_000, ""), (101, "http://empty/", None, "")]
    got = {r["page_id"]: r for r in warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert len(got) == len(rows)
    assert [got[i]["refers_to"] for i in range(50)] == [49] * 49 + [None]
    assert (got[100]["payload_bytes"], got[101]["payload_bytes"]) == (6_000_000, 0)
    assert got[100]["payload_digest"] == hashlib.sha1("é".encode() * 3_000_000).hexdigest()


def test_empty(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], SCHEMA)).collect() == []
