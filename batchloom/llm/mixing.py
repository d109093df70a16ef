"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key ``-ln(u) / quality`` from a hash of its id. A source whose target is
at least its size is first taken in complete epochs; what is left of the target is then filled in key order,
by prefix sums of sizes, and the document at the border gives just the words that are still wanted.

Prefix sums do not gather a source in one task: rows are dealt to ranges of (source, key) by sampled quantiles, so
ranges are about equal whatever the weights are; the totals of a source's ranges are summed first, and only the rows
of one range meet in a window. There may be very many sources: they are numbered in ranges, too, and the
level to which weights fill their targets is found by repeated sums over all of them, a number each time.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; a null id draws the
key of the string ``null``; rows that repeat are separate documents, however many, ties fall by id and text hash; quality
that is null, not a number or not positive counts as 1; an empty table gives an empty table; when all sizes are
0 all targets are 0; a long text is one document; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 200_000


def uniform(id_col: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def _ranges(spark: SparkSession, n: int) -> int:
    """How many ranges ``n`` rows are dealt to."""
    return max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // ROWS_PER_RANGE))


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source its size and target: shares by weight, none above ``most`` times its size, the excess reshared.

    Sources take turns at the weights in order of their names. Resharing until none is above its cap is filling to a
    level: the level is what is left of the budget after the caps that it reaches, over the weights of the others.
    """
    per = written(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sources")
    n, total = per.agg(F.count("*"), F.sum("source_size")).first()
    by_name = [F.col("source").isNull(), F.col("source")]
    dealt = per.repartitionByRange(_ranges(spark, n), *by_name).withColumn("range", F.spark_partition_id())
    dealt = written(spark, dealt, "mix-names")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by_name))
    turn = (F.col("place") + F.col("earlier") - 1) % len(weights)
    numbered = dealt.withColumn("place", place).join(earlier, "range")
    numbered = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    numbered = written(spark, numbered.select("source", "source_size", "n_rows", "weight", (F.col("source_size") * F.lit(float(most))).alias("cap")), "mix-weights")
    level = float("inf")
    open_ = numbered.agg(F.sum("weight")).first()[0]
    budget = float(total or 0) * share
    used = 0.0
    while open_:
        level = (budget - used) / open_
        filled, rest = numbered.agg(F.sum(F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap"))), F.sum(F.when(F.col("cap") > F.lit(level) * F.col("weight"), F.col("weight")))).first()
        # Caps that are reached stay reached, as the level only rises.
        if rest == open_:
            break
        used, open_ = filled, rest
    return numbered.select("source", "source_size", "n_rows", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """How many words of every document the mix takes, repeats counted.

    ``quality`` (doc_id, quality) gives the sampling weight; documents without one weigh 1.
    """
    rows = docs.select(
        F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.avg(F.col("quality").cast("double")).alias("q"))
        rows = rows.join(best, rows["doc_id"] == best["q_id"], "left").drop("q_id")
    else:
        rows = rows.withColumn("q", F.lit(None).cast("double"))
    weight = F.when((F.col("q") > 0) & ~F.isnan("q"), F.col("q")).otherwise(F.lit(1.0))
    # Equal rows are told apart by a number, so that they can be dealt like others.
    rows = rows.withColumn("key", -F.ln(uniform(F.col("doc_id"))) / weight).drop("q").withColumn("number", F.monotonically_increasing_id())
    rows = written(spark, rows, "mix-sizes")
    n = rows.count()
    targets = source_targets(spark, rows, weights, share, most)

    order = ["key", "doc_id", "th", "size", "number"]
    rows = rows.repartitionByRange(_ranges(spark, n), F.col("source").isNull(), "source", *order).withColumn("range", F.spark_partition_id())
    rows = written(spark, rows, "mix-ranges").withColumn("s", F.struct("source"))
    totals = rows.groupBy("s", "range").agg(F.sum("size").alias("range_size"), F.count("*").alias("n_rows"))
    earlier = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    # A range of a source is a bounded number of rows, so these joins and windows have no frequent keys.
    known = totals.join(targets.select(F.struct("source").alias("s"), "source_size", "target"), "s").select("s", "range", "before", "source_size", "target")
    inside = Window.partitionBy("s", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(known, ["s", "range"])
    reached = F.col("before") + F.col("inside") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    wanted = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - F.col("reached")))
    return (
        rows.withColumn("reached", reached)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("wanted", wanted.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )
