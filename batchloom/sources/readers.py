"""Where frames come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from batchloom.operators.batch_frame import BatchFrame, Read
from batchloom.plans.settings import Settings, settings
from batchloom.plans.specs import Profile
from batchloom.sources.scan import ScanDeclined, describe, loads, plan_work, read_footers, read_work, work_rows


def read_parquet(
    spark: SparkSession, paths: str | Path | Sequence[str | Path], columns: Sequence[str] | None = None, override_num_blocks: int | None = None
) -> BatchFrame:
    """Spark's own scan; ``columns`` reach the reader. ``columns`` matters before maps, as Spark can't see into them."""
    many = [paths] if isinstance(paths, (str, Path)) else list(paths)
    df = spark.read.parquet(*map(str, many))
    if columns is not None:
        df = df.select(*columns)
    if override_num_blocks is not None:
        df = df.repartition(override_num_blocks)
    return BatchFrame.of(df, "Spark's Parquet scan")


def from_items(spark: SparkSession, items: Sequence[Mapping[str, Any]], schema: str | StructType | None = None, override_num_blocks: int | None = None) -> BatchFrame:
    """Rows from the driver."""
    if schema is None:
        schema = from_arrow_schema(pa.Table.from_pylist([dict(i) for i in items]).schema)
    df = spark.createDataFrame([dict(i) for i in items], schema)
    return BatchFrame.of(df.repartition(override_num_blocks) if override_num_blocks else df, "rows")


def from_range(spark: SparkSession, n: int, override_num_blocks: int | None = None) -> BatchFrame:
    """Whole numbers below ``n`` as ``id``."""
    return BatchFrame.of(spark.range(0, n, 1, override_num_blocks), "range")


def read_row_groups(
    spark: SparkSession,
    paths: str | Path | Sequence[str | Path],
    columns: Sequence[str] | None = None,
    tasks: int | None = None,
    preserve_order: bool = False,
    split: int = 1,
    use: Settings | None = None,
    profile: Profile | None = None,
    retried: Sequence[str] = (),
    **options: Any,
) -> BatchFrame:
    """A scan with exact control of row groups; where that is declined, Spark's own scan, with the reason.

    Maps that follow are read into by the same task. ``profile`` says how that task is sized; without one, it is sized as the
    first region of maps asks.
    """
    many = [paths] if isinstance(paths, (str, Path)) else list(paths)
    use = use or settings(spark)
    try:
        if not use.enabled:
            raise ScanDeclined("regions are not enabled")
        if preserve_order:
            raise ScanDeclined("preserve_order", "row groups are dealt by size")
        if split > 1:
            raise ScanDeclined("additional_split_factor", str(split))
        scan = describe(spark, many, columns, **options)
        plan = plan_work(read_footers(scan, retried), tasks or spark.sparkContext.defaultParallelism)
    except ScanDeclined as e:
        frame = read_parquet(spark, many, columns)
        if split > 1:
            frame = frame.split_blocks(split)
        return BatchFrame(frame.base, (), use, f"Spark's Parquet scan, reason={e}")
    read = Read(read_work(scan.columns, scan.schema), scan.schema, sum(s.total("rows") for s in plan.shares), profile)
    return BatchFrame(work_rows(spark, plan), (), use, f"{len(plan.shares)} tasks by row groups, {plan.scheme}", read)


def work_table(spark: SparkSession, paths: Sequence[str | Path], columns: Sequence[str] | None, tasks: int) -> BatchFrame:
    """The plan of a scan as rows: task, files, row groups, rows and bytes."""
    plan = plan_work(read_footers(describe(spark, paths, columns)), tasks)
    rows = [tuple(load.values()) for load in loads(plan)]
    return BatchFrame.of(spark.createDataFrame(rows, "task int, files int, row_groups int, rows long, packed long, unpacked long"), "work plan")
