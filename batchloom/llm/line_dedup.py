"""Cross-site line removal by distinct-site spread, with DataFrame functions only.

Every trimmed, non-empty line has a HyperLogLog sketch of the sites it occurs on; sketches are built per task
and merged by aggregation. Lines whose estimate is clearly at or above ``min_sites`` are boilerplate, lines
near the threshold are counted exactly, and boilerplate lines leave every document.

A document made wholly of such lines loses all of them, unless ``keep_whole`` is set: it is then taken for a copy of
something that many sites carry, not a page with boilerplate around it, and left to near-duplicate removal.

A line that very many rows have is dealt over several tasks. A row's removed lines are known by position, and what is
left is put together from the stretches between them, so the cost is in proportion to the text.

Edge cases: a null text has no lines and stays null; a text that loses every line becomes empty; empty lines stay and are not counted; a null site counts
as none; repeated rows, ties and extra columns need no care; a very long line is one key; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import spread_join, written

MIN_SITES = 10
LG_K = 12


def trimmed(line: Column) -> Column:
    """A line without blanks around it (space, tab, carriage return)."""
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """A row per line that is not blank: the given columns, its position from 0 on and its key."""
    lines = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*lines.columns[:-1], trimmed(F.col("line")).alias("line")).where("line <> ''").withColumn("key", F.md5(F.col("line").cast("binary"))).drop("line")


def spread_lines(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """Keys of the lines that occur on at least ``min_sites`` distinct sites, and how many rows they have in all."""
    lines = _lines(docs, F.col(site_col).cast("string").alias("site")).drop("pos")
    # A line without a site doesn't add to its sketch, but is one of its rows.
    sketches = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n_rows"))
    found = sketches.select("key", F.hll_sketch_estimate("sketch").alias("sites"), "n_rows")
    # Four standard errors on either side count as near the threshold.
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    found = written(spark, found.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = found.where(F.col("sites") <= min_sites + margin).select("key", "n_rows")
    total = found.agg(F.sum("n_rows")).first()[0] or 0
    pairs = spread_join(lines.where("site IS NOT NULL"), near, ["key"], "site", total).distinct()
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("key").join(near, "key")
    return found.where(F.col("sites") > min_sites + margin).select("key", "n_rows").unionByName(exact)


def remove_spread_lines(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", keep_whole: bool = False) -> DataFrame:
    """``docs`` with cleaned ``text`` and two more columns, ``n_lines`` and ``n_removed``."""
    spread = written(spark, spread_lines(spark, docs, min_sites, site_col), "line-boilerplate")
    lines = _lines(docs, F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"))
    hits = spread_join(lines, spread, ["key"], "__h", spread.agg(F.sum("n_rows")).first()[0] or 0)
    hits = hits.groupBy("__d", "__h").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*[F.col(c) for c in kept]).withColumn("__th", F.xxhash64("text"))
    out = out.join(hits, out["doc_id"].eqNullSafe(hits["__d"]) & (out["__th"] == hits["__h"]), "left")
    out = out.withColumn("__lines", F.split("text", "\n"))
    full = F.coalesce(F.size(F.filter("__lines", lambda x: trimmed(x) != "")), F.lit(0))
    out = out.withColumn("__n", F.when(F.col("text").isNull(), 0).otherwise(full)).withColumn("__cut", F.coalesce(F.size("__gone"), F.lit(0)))
    if keep_whole:
        out = out.withColumn("__cut", F.when(F.col("__cut") < F.col("__n"), F.col("__cut")).otherwise(0))
    before = F.concat(F.array(F.lit(-1)), "__gone")
    after = F.concat("__gone", F.array(F.size("__lines")))
    stay = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("__lines", a + 2, b - a - 1)))
    text = F.when(F.col("__cut") > 0, F.array_join(stay, "\n")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in kept]
    return out.select(*columns, F.col("__n").cast("long").alias("n_lines"), F.col("__cut").cast("long").alias("n_removed"))
