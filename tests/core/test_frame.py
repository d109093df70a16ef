"""Frames end to end on Spark."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import batchloom
from batchloom import TaskPool, WorkerPool, from_items, from_range
from batchloom.functions import AddFeature, add_to, key_sum, multiply_by, nothing
from batchloom.plans.settings import Settings
from batchloom.streaming import streamed

ON = Settings(True, True)


def placed(frame):
    return frame.df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.fixture
def values(spark):
    return replace(from_items(spark, [{"value": i} for i in range(1, 5)], "value long", 2), settings=ON)


def plus(frame, n=1, **kwargs):
    return frame.map_batches(add_to, schema="value long", fn_args=("value", n), **kwargs)


def test_enable_and_disable(spark):
    assert not batchloom.is_enabled(spark)
    before = from_range(spark, 3)
    try:
        batchloom.enable(spark, fusion=False)
        assert batchloom.settings(spark) == Settings(True, False)
        assert from_range(spark, 3).settings.enabled and not before.settings.enabled
        batchloom.enable(spark)
        assert batchloom.settings(spark) == ON
        with pytest.raises(TypeError):
            batchloom.enable(spark, fusion=1)
    finally:
        batchloom.disable(spark)
    assert not batchloom.is_enabled(spark)
    assert batchloom.compatibility(spark).compatible


def test_incompatible_spark_changes_nothing(spark, monkeypatch):
    from batchloom.plans import settings

    monkeypatch.setattr(settings.pyspark, "__version__", "3.5.0")
    assert settings.compatibility(spark).missing == ("version_4",)
    with pytest.raises(RuntimeError):
        batchloom.enable(spark)
    assert not batchloom.is_enabled(spark)


def test_map_and_schema_that_is_seen(values):
    frame = values.map_batches(lambda b: b.append_column("plus_one", pc.add(b.column("value"), 1)), batch_size=2)
    assert sorted((r["value"], r["plus_one"]) for r in frame.take_all()) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    with pytest.raises(ValueError, match="give schema"):
        values.filter("false").map_batches(lambda b: b)


def test_fused_and_unfused_agree(values):
    chain = lambda f: plus(plus(plus(f), 2, batch_size=1), 3)
    fused, unfused, plain = (chain(replace(values, settings=s)) for s in (ON, Settings(True, False), Settings()))
    assert [placed(f) for f in (fused, unfused, plain)] == [1, 3, 3]
    assert len({tuple(sorted(r["value"] for r in f.take_all())) for f in (fused, unfused, plain)}) == 1


def test_stages_around_a_task_pool(spark):
    frame = replace(from_range(spark, 8, 4), settings=ON)
    frame = frame.map_batches(add_to, schema="id long", fn_args=("id", 1), batch_size=2).map_batches(multiply_by, schema="id long", fn_args=("id", 2), compute=TaskPool())
    assert sorted(r["id"] for r in frame.map_batches(add_to, schema="id long", fn_args=("id", 2)).take_all()) == [2 * i + 4 for i in range(8)]
    assert placed(frame) == 2


def test_typed_empties(values):
    frame = values.map_batches(nothing, schema="value long").map_batches(lambda b: 1 / 0, schema="derived long")
    assert frame.to_arrow().schema.names == ["derived"] and frame.count() == 0
    assert frame.df.schema.simpleString() == "struct<derived:bigint>"


def test_classes_and_errors(values):
    frame = values.map_batches(AddFeature, schema="value long, feature long", fn_constructor_args=("value",), fn_constructor_kwargs={"multiplier": 3})
    assert sorted(r["feature"] for r in frame.take_all()) == [3, 6, 9, 12]
    with pytest.raises(Exception, match="the batch function failed"):
        values.map_batches(lambda b: 1 / 0, schema="value long").count()


def test_fallbacks_run_and_are_explained(values):
    frame = values.map_batches(lambda b: {"value": b["value"] + 1}, schema="value long", batch_format="numpy")
    frame = plus(plus(frame), compute=WorkerPool(max_size=1))
    assert sorted(r["value"] for r in frame.take_all()) == [4, 5, 6, 7]
    text = frame.explain()
    assert "regions: enabled" in text and "reason=batch format 'numpy' is not native" in text and "standalone" in text and "pool differs" in text
    assert "stage 0 to 1 [add_to > add_to]: fused" in plus(plus(values)).explain()
    assert "all stages run on plain Spark" in batchloom.explain(replace(values, settings=Settings()))
    with pytest.raises(TypeError):
        batchloom.explain(values.df)
    with pytest.raises(ValueError):
        values.map_batches(len, batch_format="other")


def test_grouped_pipeline(spark):
    rows = [{"key": k, "value": v} for k, vs in ((0, [1, 2, 3]), (1, [4, 5, 6])) for v in vs]
    frame = replace(from_items(spark, rows, "key long, value long", 2), settings=ON)
    frame = frame.map_batches(add_to, schema="key long, value long", fn_args=("value", 1)).group_by("key").map_groups(key_sum, "key long, total long", fn_args=("key", "value"))
    frame = frame.map_batches(add_to, schema="key long, total long", fn_args=("total", 100))
    assert sorted((r["key"], r["total"]) for r in frame.take_all()) == [(0, 109), (1, 118)]


def test_aggregates(spark):
    frame = from_items(spark, [{"k": 1, "v": 2}, {"k": 1, "v": None}, {"k": None, "v": 5}], "k long, v long")
    got = frame.group_by("k").aggregate(n=("count", "v"), s=("sum", "v"), lo=("min", "v"), hi=("max", "v"), m=("avg", "v")).take_all()
    assert sorted(map(str, got)) == sorted(map(str, [{"k": 1, "n": 1, "s": 2, "lo": 2, "hi": 2, "m": 2.0}, {"k": None, "n": 1, "s": 5, "lo": 5, "hi": 5, "m": 5.0}]))
    assert frame.filter("false").aggregate(n=("count", "v"), s=("sum", "v")).take_all() == [{"n": 0, "s": None}]
    with pytest.raises(ValueError):
        frame.aggregate(x=("median", "v"))
    grouped = frame.group_by("k").map_groups(lambda g: g.assign(v=0)[["k", "v"]].head(1), "k long, v long", batch_format="pandas")
    assert sorted((str(r["k"]) for r in grouped.take_all())) == ["1", "None"] or grouped.count() == 2


def test_shuffle_puts_a_key_in_one_partition(spark):
    from pyspark.sql import functions as F

    df = from_range(spark, 200, 4).with_column("k", F.col("id") % 7).shuffle_by("k", num_partitions=5).df
    assert df.rdd.getNumPartitions() == 5
    assert df.select("k", F.spark_partition_id().alias("p")).distinct().count() == 7


def test_blocks_and_actions(spark, values):
    assert values.split_blocks(3).num_blocks() == 6 and values.split_blocks(1) is values
    with pytest.raises(ValueError):
        values.split_blocks(0)
    kept = plus(values).materialize()
    assert kept.count() == 4 and kept.to_arrow().num_rows == 4
    kept.df.unpersist()
    assert [t.num_rows for t in values.iter_batches(3)] == [3, 1]
    stats = plus(plus(values)).stats()
    assert (stats["rows"], stats["blocks"], stats["regions"]) == (4, 2, 1)
    assert from_range(spark, 10, 4).num_blocks() == 4
    assert values.map_batches(lambda b: b, schema="value long", limit=1).count() == 2


def test_bundles_run_no_map(spark, values):
    """The rows that go into the maps are counted, not those that come out."""
    frame = from_range(spark, 100, 8).map_batches(lambda b: 1 / 0, schema="id long").bundle(50)
    assert frame.num_blocks() == 2


def test_planning_runs_nothing_upstream(spark):
    """Counting partitions beyond an exchange starts no job."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    assert from_range(spark, 100, 4).shuffle_by("id", num_partitions=6).map_batches(lambda b: 1 / 0, schema="id long").num_blocks() == 6
    assert store.jobsList(None).size() == before


def test_spilled_bytes_are_in_stats(spark):
    stats = from_range(spark, 1000, 2).stats()
    assert stats["spilled_bytes"] == 0 and stats["rows"] == 1000


def test_rules_of_a_frame(spark, values):
    """Rules belong to a frame and those made from it, count once, and are checked."""
    def halve(stages):
        return stages[::2]

    frame = plus(plus(values)).with_rule(halve).with_rule(halve)
    assert frame.rules == (halve,) and [d.last for d in frame.decisions] == [0]
    assert sorted(r["value"] for r in frame.take_all()) == sorted(r["value"] + 1 for r in values.take_all())
    assert frame.filter("true").rules == (halve,) and plus(plus(values)).decisions[0].last == 1
    with pytest.raises(TypeError):
        values.with_rule("no function")
    with pytest.raises(TypeError):
        frame.with_rule(lambda stages: ["no map"]).decisions  # noqa: B018


def test_accumulators(spark):
    class Mean(batchloom.Accumulator):
        fields, result, empty = "n long, total double", "double", -1.0

        def start(self, values):
            some = values.drop_null().to_pylist()
            return len(some), float(sum(some))

        def merge(self, states):
            return sum(s[0] for s in states), sum(s[1] for s in states)

        def finish(self, state):
            return state[1] / state[0] if state[0] else None

    rows = [(k, v) for k, v in zip([1, 2, None, 1, 2, 2, 3, None], [1, 2, 3, None, 4, 6, None, 5], strict=True)]
    frame = replace(from_range(spark, 1), base=spark.createDataFrame(rows, "k long, v long").repartition(3))
    expected = {1: 1.0, 2: 4.0, 3: None, None: 4.0}
    assert {r["k"]: r["m"] for r in frame.group_by("k").aggregate(m=(Mean(), "v")).take_all()} == expected
    assert {r["k"]: (r["m"], r["k2"]) for r in frame.group_by("k").aggregate(m=(Mean(), "v"), k2=(Mean(), "k")).take_all()} == {k: (m, k) for k, m in expected.items()}
    assert frame.aggregate(m=(Mean(), "v")).take_all() == [{"m": 3.5}]
    assert frame.filter("false").aggregate(m=(Mean(), "v")).take_all() == [{"m": -1.0}]
    assert frame.filter("false").group_by("k").aggregate(m=(Mean(), "v")).take_all() == []
    with pytest.raises(ValueError, match="apart"):
        frame.aggregate(m=(Mean(), "v"), n=("count", "v"))


def test_accumulators_of_many_keys(spark):
    """Tasks pass on what they hold when there are many keys."""
    from batchloom.functions import BitXor

    frame = from_range(spark, 120_000, 2).with_column("k", F.col("id") % 60_000)
    found = frame.group_by("k").aggregate(x=(BitXor(), "id")).df
    assert found.count() == 60_000 and found.where("x <> (k ^ (k + 60000))").isEmpty()


def test_resource_profiles_are_declined_locally(values):
    assert "resource profiles need a cluster" in plus(values, num_gpus=1).explain()
    assert plus(values, num_gpus=1).count() == 4


def test_stream(spark, values, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"value": pa.array([1, 2, 3], pa.int64())}), str(tmp_path / "x.parquet"))
    stream = spark.readStream.schema("value long").parquet(str(tmp_path))
    run = streamed(plus(plus(values)), stream).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("streamed").collect()) == [3, 4, 5]
    with pytest.raises(ValueError):
        streamed(values, values.base)


def test_gangs_start_whole_or_not_at_all(spark, values):
    frame = plus(plus(values, gang=True), gang=True)
    assert [d.how for d in frame.decisions] == ["fused"] and sorted(r["value"] for r in frame.take_all()) == [3, 4, 5, 6]
    assert "gang differs" in plus(plus(values, gang=True)).explain()
    many = replace(from_range(spark, 100, 64), settings=ON)
    with pytest.raises(ValueError, match="needs as many slots"):
        many.map_batches(lambda b: b, schema="id long", gang=True).count()


def test_bundles(spark):
    frame = from_range(spark, 100, 8)
    assert [frame.bundle(n).num_blocks() for n in (1, 25, 1000)] == [8, 4, 1]
    with pytest.raises(ValueError):
        frame.bundle(0)
