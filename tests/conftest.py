"""One local Spark session for all tests."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.fixture
def agrees(spark, duck):
    """Whether a registered query and its SQL give the same rows, columns by name."""

    def check(query, sql):
        df = query(spark, SF)
        got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())

    return check
