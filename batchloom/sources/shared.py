"""The folder that driver and executors share, and what is written there on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: more bytes than a table has, so the writer never ends a row group by its size.
WHOLE = 1 << 40


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written stages: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a fresh local folder (tests); a cluster raises, as its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="batchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def one_row_group(df: DataFrame, name: str) -> Iterator[str]:
    """The folder of a copy of all rows as one file of one row group, deleted on leaving.

    One task writes it, and holds it encoded until the row group ends. If that exceeds the task's heap, the writer ends the row
    group early or the task fails.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    try:
        df.coalesce(1).write.options(**{"parquet.block.size": WHOLE, "maxRecordsPerFile": 0, "compression": "zstd"}).parquet(path)
        yield path
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
