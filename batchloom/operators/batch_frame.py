"""``BatchFrame``: a Spark DataFrame plus batch maps that have not been placed yet."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from batchloom.operators.aggregates import aggregated
from batchloom.operators.worker import MapConfig, as_table, chained, rebatched
from batchloom.plans.eligibility import FORMATS, MapStage, resource_profile
from batchloom.plans.regions import Decision, decide
from batchloom.plans.settings import Settings, settings
from batchloom.plans.specs import Profile, WorkerPool

Schema = str | StructType | pa.Schema
Rule = Callable[[tuple[MapStage, ...]], tuple[MapStage, ...]]
INFER_ROWS = 32


def _arrow_schema(schema: Schema) -> pa.Schema:
    if isinstance(schema, pa.Schema):
        return schema
    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


@dataclass(frozen=True)
class Read:
    """Turns rows of work into the rows that the work names, in the task that has them."""

    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: pa.Schema
    rows: int
    profile: Profile | None = None


def planned_partitions(df: DataFrame) -> int:
    """Partitions of the plan as it starts; nothing is run for it, and adaptive execution may merge some later."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    return plan.execute().getNumPartitions()


@dataclass(frozen=True)
class BatchFrame:
    """Immutable. Maps are recorded; ``df`` places them, and any relational call goes through ``df``.

    Where there is a ``read``, ``base`` has the work that it reads, and the first region of maps reads in its own task.
    ``rules`` are this frame's own: each gets the recorded maps before they are placed, and gives those to place.
    """

    base: DataFrame
    stages: tuple[MapStage, ...] = ()
    settings: Settings = field(default_factory=Settings)
    source: Any = None
    read: Read | None = None
    rules: tuple[Rule, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, source: Any = None) -> BatchFrame:
        return cls(df, (), settings(df.sparkSession), source)

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    # ---- batch maps ---------------------------------------------------------------------------------------

    def map_batches(
        self,
        fn: Callable[..., Any],
        *,
        schema: Schema | None = None,
        batch_size: int | None = 4096,
        batch_format: str = "pyarrow",
        zero_copy_batch: bool = False,
        fn_args: tuple = (),
        fn_kwargs: Mapping[str, Any] | None = None,
        fn_constructor_args: tuple = (),
        fn_constructor_kwargs: Mapping[str, Any] | None = None,
        compute: Any = None,
        options_fn: Any = None,
        limit: int | None = None,
        raise_original: bool = False,
        **options: Any,
    ) -> BatchFrame:
        """Apply a function, or objects of a class made once per worker, to batches of ``batch_size`` rows.

        ``schema`` is what comes out. Without it a job runs now: the maps so far on a few rows, and then ``fn`` on these,
        on the driver; so give it where that is dear or ``fn`` has effects. Batches never cross partitions.
        """
        if batch_format not in FORMATS:
            raise ValueError(f"batch_format is one of {', '.join(FORMATS)}")
        pairs = lambda m: tuple((m or {}).items())
        config = functools.partial(
            MapConfig,
            fn=fn,
            batch_size=batch_size,
            batch_format=batch_format,
            key=(uuid.uuid4().hex, len(self.stages)),
            zero_copy=zero_copy_batch,
            args=tuple(fn_args),
            kwargs=pairs(fn_kwargs),
            constructor_args=tuple(fn_constructor_args),
            constructor_kwargs=pairs(fn_constructor_kwargs),
            raise_original=raise_original,
        )
        known = _arrow_schema(schema) if schema is not None else self._seen_schema(config)
        label = getattr(fn, "__name__", type(fn).__name__)
        stage = MapStage(config(schema=known), compute or WorkerPool(), options, options_fn, limit, label)
        return replace(self, stages=(*self.stages, stage))

    def _seen_schema(self, config: Callable[..., MapConfig]) -> pa.Schema:
        """The columns that the function returns for the first rows."""
        sample = self.df.limit(INFER_ROWS).toArrow()
        if not sample.num_rows:
            raise ValueError("the input is empty, so the output columns can't be seen; give schema=")
        from batchloom.operators.worker import _function, _given
        from types import GeneratorType

        probe = config(schema=pa.schema([]))
        result = _function(probe)(_given(sample, probe.batch_format, False), *probe.args, **dict(probe.kwargs))
        first = next(result, None) if isinstance(result, GeneratorType) else result
        if first is None:
            raise ValueError("the function gave nothing for the first rows; give schema=")
        if isinstance(first, pa.RecordBatch):
            return first.schema.remove_metadata()
        if isinstance(first, pa.Table):
            return first.schema.remove_metadata()
        if isinstance(first, dict):
            return pa.table({k: pa.array(v) for k, v in first.items()}).schema
        return pa.Table.from_pandas(first, preserve_index=False).schema.remove_metadata()

    # ---- placing ------------------------------------------------------------------------------------------

    def with_rule(self, rule: Rule) -> BatchFrame:
        """Another rule for this frame and those made from it; each counts once, in the order given."""
        if not callable(rule):
            raise TypeError("a rule is a function from maps to maps")
        return self if rule in self.rules else replace(self, rules=(*self.rules, rule))

    @functools.cached_property
    def placed(self) -> tuple[MapStage, ...]:
        """The maps as the frame's rules leave them."""
        stages = functools.reduce(lambda stages, rule: tuple(rule(stages)), self.rules, self.stages)
        if not all(isinstance(s, MapStage) for s in stages):
            raise TypeError("a rule gave something that is no map")
        return stages

    @functools.cached_property
    def decisions(self) -> list[Decision]:
        return decide(self.placed, self.spark.sparkContext.defaultParallelism, self.settings.enabled, self.settings.fusion)

    @functools.cached_property
    def df(self) -> DataFrame:
        """The frame on Spark: one ``mapInArrow`` for each decision; a read goes into the first, if it is a region."""
        out, read = self.base, self.read
        if read is not None and not self.reads_in_region:
            out, read = self._ran(out, read.run, read.schema, read.profile), None
        for d in self.decisions:
            stages = self.placed[d.first : d.last + 1]
            configs = tuple(s.config for s in stages)

            def run(batches: Iterator[pa.RecordBatch], configs=configs, limit=stages[0].limit, read=read) -> Iterator[pa.RecordBatch]:
                if read is not None:
                    batches = read.run(batches)
                if limit is not None:
                    batches = _limited(batches, limit)
                return chained(configs, batches)

            out, read = self._ran(out, run, configs[-1].schema, d.spec.profile if d.spec else None), None
        return out

    @property
    def reads_in_region(self) -> bool:
        """Whether the first region reads: there is one, and the read asks for nothing else; a gang is not for reading."""
        if self.read is None or not self.decisions or not self.settings.fusion or self.decisions[0].spec is None:
            return False
        profile = self.decisions[0].spec.profile
        return self.read.profile in (None, profile) and not (profile and profile.gang)

    def _ran(self, df: DataFrame, run: Callable, schema: pa.Schema, wanted: Profile | None) -> DataFrame:
        gang = wanted is not None and wanted.gang
        if gang:
            self._check_gang(df)
        profile, _ = resource_profile(self.spark, wanted)
        return df.mapInArrow(run, from_arrow_schema(schema), barrier=gang, profile=profile)

    def _check_gang(self, df: DataFrame) -> None:
        """A gang needs a slot for every partition at once; refuse before it starts what can't get them."""
        blocks, slots = planned_partitions(df), self.spark.sparkContext.defaultParallelism
        if blocks > slots:
            raise ValueError(f"a gang of {blocks} partitions needs as many slots; there are {slots}")

    def _over(self, df: DataFrame) -> BatchFrame:
        return BatchFrame(df, (), self.settings, None, None, self.rules)

    # ---- relational calls, by Catalyst --------------------------------------------------------------------

    def select(self, *columns: Any) -> BatchFrame:
        return self._over(self.df.select(*columns))

    def filter(self, condition: Column | str) -> BatchFrame:
        return self._over(self.df.filter(condition))

    def with_column(self, name: str, value: Column) -> BatchFrame:
        return self._over(self.df.withColumn(name, value))

    def rename(self, names: Mapping[str, str]) -> BatchFrame:
        return self._over(self.df.withColumnsRenamed(dict(names)))

    def join(self, other: BatchFrame | DataFrame, on: Any, how: str = "inner") -> BatchFrame:
        return self._over(self.df.join(other.df if isinstance(other, BatchFrame) else other, on, how))

    def repartition(self, n: int) -> BatchFrame:
        """``n`` output partitions, by a round-robin exchange."""
        return self._over(self.df.repartition(n))

    def split_blocks(self, factor: int) -> BatchFrame:
        """``factor`` times as many partitions."""
        if factor < 1:
            raise ValueError("the factor is at least 1")
        return self if factor == 1 else self.repartition(factor * self.num_blocks())

    def bundle(self, min_rows: int) -> BatchFrame:
        """Fewer partitions, of about ``min_rows`` rows or more each, without an exchange.

        What counts are the rows that go into the maps recorded so far, so no map runs to count them; Spark counts a Parquet
        scan from its footers.
        """
        if min_rows < 1:
            raise ValueError("min_rows is at least 1")
        rows = self.read.rows if self.read is not None else self.base.count()
        return replace(self, base=self.base.coalesce(max(1, min(planned_partitions(self.base), rows // min_rows))))

    def coalesce(self, n: int) -> BatchFrame:
        return self._over(self.df.coalesce(n))

    def shuffle_by(self, *keys: str, num_partitions: int | None = None) -> BatchFrame:
        """All rows of a key in one partition: a hash exchange, of the session's shuffle partitions by default."""
        return self._over(self.df.repartition(num_partitions, *keys) if num_partitions else self.df.repartition(*keys))

    def group_by(self, *keys: str) -> Groups:
        return Groups(self, keys)

    def aggregate(self, **aggregates: Any) -> BatchFrame:
        """One row over everything; on no rows, counts are 0, accumulators have their ``empty`` and the rest is null."""
        return self._over(aggregated(self.df, (), aggregates))

    # ---- actions ------------------------------------------------------------------------------------------

    def count(self) -> int:
        return self.df.count()

    def take_all(self) -> list[dict[str, Any]]:
        """All rows as dicts, in no particular order; for small results."""
        return [r.asDict() for r in self.df.collect()]

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def materialize(self) -> BatchFrame:
        """Run now and keep the partitions, spilling to disk; Spark makes lost ones again."""
        kept = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return self._over(kept)

    def iter_batches(self, batch_size: int | None = 4096) -> Iterator[pa.Table]:
        """Batches to the driver, a partition at a time."""
        packed = self.df.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True)
        return rebatched((pa.ipc.open_stream(row[0]).read_all() for row in packed), batch_size)

    def num_blocks(self) -> int:
        """Partitions as planned; nothing is run for it."""
        return planned_partitions(self.df)

    def stats(self) -> dict[str, Any]:
        """Runs the frame: rows, partitions, Spark's estimate of bytes, and what this run spilled to disk."""
        before = _spilled(self.spark)
        rows = self.count()
        return {
            "rows": rows,
            "blocks": self.num_blocks(),
            "stages": len(self.placed),
            "regions": sum(d.how == "fused" for d in self.decisions),
            "estimated_bytes": int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())),
            "spilled_bytes": _spilled(self.spark) - before,
        }

    def explain(self) -> str:
        from batchloom.plans.explain import explain

        return explain(self)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of bytes."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def _limited(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if most <= 0:
            return
        yield batch.slice(0, most)
        most -= batch.num_rows


def _spilled(spark: SparkSession) -> int:
    """Bytes that this application's stages have spilled to disk so far, from Spark's status store."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


@dataclass(frozen=True)
class Groups:
    """Rows by key."""

    frame: BatchFrame
    keys: tuple[str, ...]

    def _grouped(self) -> GroupedData:
        return self.frame.df.groupBy(*self.keys)

    def aggregate(self, **aggregates: Any) -> BatchFrame:
        """``name=("sum", "column")`` or ``name=(an Accumulator, "column")``: partial in each task, then an exchange, then the rest."""
        return self.frame._over(aggregated(self.frame.df, self.keys, aggregates))

    def map_groups(self, fn: Callable[..., Any], schema: Schema, batch_format: str = "pyarrow", fn_args: tuple = (), fn_kwargs: Mapping[str, Any] | None = None) -> BatchFrame:
        """One call per key with all its rows; a null key is a key. A group has to fit in a worker."""
        arrow = _arrow_schema(schema)
        kwargs = dict(fn_kwargs or {})

        def run(table):
            given = table.to_pandas() if batch_format == "pandas" else table
            return as_table(fn(given, *fn_args, **kwargs), arrow)

        return self.frame._over(self._grouped().applyInArrow(run, from_arrow_schema(arrow)))
