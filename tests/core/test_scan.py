"""Scan planning by row groups."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from hypothesis import given
from hypothesis import strategies as st

import batchloom
from batchloom import Profile, TaskPool
from batchloom.plans.settings import Settings
from batchloom.sources import scan as sc
from batchloom.sources.readers import read_row_groups, work_table

ON = Settings(True, True)


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"value": pa.array(range(10), pa.int64()), "b": [str(i) for i in range(10)], "s": [{"p": i, "q": "x" * 50} for i in range(10)]}), path, row_group_size=2)
    return path


@pytest.mark.parametrize(
    "path, good",
    [("/a/b", True), ("file:///a", True), ("file://localhost/a", True), ("file://host/a", False), ("s3://bucket/x", True), ("s3a://bucket/x", True), ("s3:///x", False), ("s3://u:p@bucket/x", False), ("s3://b/x?y=1", False), ("hdfs://n/x", False), (3, False)],
)
def test_ambient_paths(path, good):
    assert sc.is_ambient(path) is good


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({"block_fn": len}, "read_options"),
        ({"shuffle": "files"}, "read_options"),
        ({"predicate": "value > 1"}, "predicate"),
        ({"renames": {"value": "v"}}, "projection"),
        ({"columns": []}, "projection"),
        ({"columns": ["value", "value"]}, "projection"),
        ({"columns": ["none"]}, "missing_column"),
        ({"paths": ["hdfs://n/x"]}, "filesystem"),
        ({"paths": ["s3://user:secret@bucket/x"]}, "filesystem"),
        ({"paths": ["/no/such/file"]}, "source_unavailable"),
        ({"paths": ["/data/day=1/x.parquet"]}, "partition_columns"),
    ],
)
def test_declined_scans(spark, file, changes, reason):
    with pytest.raises(sc.ScanDeclined) as e:
        sc.describe(**({"spark": spark, "paths": [file], "columns": ["value"]} | changes))
    assert e.value.reason == reason


def test_duplicate_paths(spark, file):
    with pytest.raises(sc.ScanDeclined) as e:
        sc.describe(spark, [file, file])
    assert e.value.reason == "fragments"


def test_hive_folders_are_declined(spark, tmp_path):
    os.makedirs(tmp_path / "t" / "day=1")
    pq.write_table(pa.table({"value": [1]}), str(tmp_path / "t" / "day=1" / "x.parquet"))
    with pytest.raises(sc.ScanDeclined) as e:
        sc.describe(spark, [tmp_path / "t"], ["value"])
    assert e.value.reason == "partition_columns"


def test_folders_and_many_files(spark, tmp_path):
    """Files are listed by Spark, footers read in its tasks, and each task reads what it was dealt."""
    for i in range(5):
        pq.write_table(pa.table({"value": pa.array(range(10 * i, 10 * i + 10), pa.int64())}), str(tmp_path / f"part {i}.parquet"), row_group_size=3)
    (tmp_path / "_SUCCESS").write_text("")
    assert sorted(r[0] for r in read_row_groups(spark, tmp_path, tasks=3, use=ON).df.collect()) == list(range(50))
    loads = work_table(spark, [tmp_path], ["value"], 3).take_all()
    assert sorted(r["rows"] for r in loads) == [16, 17, 17] and sum(r["row_groups"] for r in loads) == 20
    placed = read_row_groups(spark, tmp_path, tasks=3, use=ON).df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in placed) == sorted(r["rows"] for r in loads)


def test_object_store_paths_are_opened_by_arrow(monkeypatch):
    asked = []
    monkeypatch.setattr(sc.pyarrow.fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: asked.append(uri) or (None, uri)))
    sc.opened("s3a://bucket/x.parquet")
    assert asked == ["s3://bucket/x.parquet"]
    assert sc.opened("file:/a%20b")[1] == "/a b" and sc.opened("/a%20b")[1] == "/a%20b"


def test_footers_count_projected_leaves(spark, file):
    one, nested, all_ = (sc.read_footers(sc.describe(spark, [file], c)) for c in (["value"], ["s"], None))
    assert [g.rows for g in one] == [2] * 5
    assert sum(g.unpacked for g in one) < sum(g.unpacked for g in nested) < sum(g.unpacked for g in all_)


def test_changed_file_is_declined_and_never_read(spark, file):
    scan = sc.describe(spark, [file], ["value"])
    plan = sc.plan_work(sc.read_footers(scan), 2)
    listed = scan.files.collect()
    with open(file, "ab") as f:
        f.write(b"more")
    with pytest.raises(sc.ScanDeclined) as e:
        sc.read_footers(sc.Scan(spark.createDataFrame(listed, "path string, size long"), scan.columns, scan.schema))
    assert e.value.reason == "listed_size_changed"
    work = pa.RecordBatch.from_pylist([{"task": 0, "path": p, "size": s, "marker": m, "numbers": n} for p, s, m, n in plan.shares[0].files()])
    with pytest.raises(sc.SourceChanged, match="changed"):
        list(sc.read_work(scan.columns, scan.schema)([work]))
    os.remove(file)
    with pytest.raises(sc.SourceChanged, match="gone"):
        list(sc.read_work(scan.columns, scan.schema)([work]))


def test_damaged_file_declines_the_scan(spark, file, tmp_path):
    (tmp_path / "z.parquet").write_bytes(b"PAR1 this is no Parquet file PAR1")
    with pytest.raises(sc.ScanDeclined) as e:
        sc.read_footers(sc.describe(spark, [file, tmp_path / "z.parquet"], ["value"]))
    assert e.value.reason == "footer_io"


def test_retry(spark, file, monkeypatch):
    scan, calls = sc.describe(spark, [file]), []

    def failing(_):
        calls.append(1)
        return spark.createDataFrame([("p", None, None, None, None, None, None, "footer_io", "slow down please")], sc.FOOTER)

    monkeypatch.setattr(sc, "footer_rows", failing)
    monkeypatch.setattr(sc.time, "sleep", lambda _: None)
    for retried, n in (((), 1), (("slow down",), 3)):
        calls.clear()
        with pytest.raises(sc.ScanDeclined) as e:
            sc.read_footers(scan, retried)
        assert e.value.reason == "footer_io" and len(calls) == n


groups = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30), st.integers(1, 9), st.integers(0, 50), st.integers(0, 50)), max_size=25, unique_by=lambda g: g[:2])


@given(groups, st.integers(1, 9))
def test_work_plan(rows, tasks):
    planned = [sc.RowGroup(p, n, 1, "m", r, c, u) for p, n, r, c, u in rows]
    plan = sc.plan_work(planned, tasks)
    assert plan == sc.plan_work(planned[::-1], tasks)
    assert sorted((p, n) for s in plan.shares for p, _, _, ns in s.files() for n in ns) == sorted((p, n) for p, n, *_ in rows)
    assert len(plan.shares) == min(tasks, len(rows))
    loads = [s.total("unpacked") for s in plan.shares]
    assert sum(loads) == sum(u for *_, u in rows)
    if plan.shares:
        assert max(loads) - min(loads) <= max(u for *_, u in rows)
        assert all(ns == sorted(set(ns)) for s in plan.shares for *_, ns in s.files())
    else:
        assert plan.scheme == "parquet-read-v1:empty"


def test_no_tasks():
    with pytest.raises(sc.ScanDeclined):
        sc.plan_work([], 0)


def test_exact_read(spark, file):
    frame = read_row_groups(spark, file, ["b", "value"], tasks=3, use=ON)
    assert "3 tasks by row groups" in frame.source
    assert frame.num_blocks() == 3
    assert sorted(frame.df.collect()) == [(str(i), i) for i in range(10)]


def test_first_region_reads(spark, file):
    """One pass for read and maps; a read with a profile of its own, or a plain map, keeps them apart."""
    read = lambda **k: read_row_groups(spark, file, ["value"], tasks=2, use=ON, **k)
    double = lambda f, **k: f.map_batches(lambda b: b.append_column("d", b["value"]), schema="value long, d long", **k)
    passes = lambda f: f.df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert passes(double(read())) == 1 and "in the first region's tasks" in double(read()).explain()
    assert passes(double(read(profile=Profile(cpus=2.0)))) == 2
    assert passes(double(read(), compute=TaskPool())) == 2
    for frame in (double(read()), double(read(), compute=TaskPool())):
        assert sorted(r["d"] for r in frame.df.collect()) == list(range(10))
    assert double(read()).bundle(100).df.count() == 10


@pytest.mark.parametrize("options, reason", [({"preserve_order": True}, "preserve_order"), ({"split": 2}, "additional_split_factor"), ({"predicate": 1}, "predicate"), ({"use": Settings()}, "not enabled")])
def test_fallback_to_spark(spark, file, options, reason):
    frame = read_row_groups(spark, file, ["value"], **({"use": ON} | options))
    assert reason in frame.source
    assert sorted(r[0] for r in frame.df.collect()) == list(range(10))


def test_ordered_read_is_declined_before_any_access(spark, monkeypatch, file):
    from batchloom.sources import readers

    monkeypatch.setattr(readers, "describe", lambda *a, **k: pytest.fail("accessed"))
    assert "preserve_order" in read_row_groups(spark, file, preserve_order=True, use=ON).source


def test_projection_reaches_the_reader(spark, file):
    plan = batchloom.read_parquet(spark, file, ["value"]).filter("value > 3").df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:bigint>" in plan and "GreaterThan(value,3)" in plan
