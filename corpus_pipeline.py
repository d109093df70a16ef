"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing, in this order.

Every stage works on all that its predecessor kept; all but the last return the columns of ``documents``, whatever other
columns there are. A stage's table is deleted once the next one is written; the last one stays for the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from batchloom.llm.common import drop_stages, stages_so_far, written
from batchloom.llm.queries import document_quality, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without letters, or undecided, go.

    A null or empty text goes; ``lang``, ``source`` and ``doc_id`` don't decide, so they may be null; a long text is scored
    as a whole; equally likely languages give a score of 0.5 or less with others, and 0.5 is enough; repeated rows stay
    repeated; an empty table, or one without any ``lang`` to learn from, gives an empty table.
    """
    return language_id.keep_identified(spark, docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites carry; ``n_chars`` follows the text, and no document goes.

    Documents wholly of such lines stay whole, as near-dedup needs their texts to find the copies. A null text stays null,
    with null ``n_chars``; an empty text stays empty; a null ``source`` is no site; rows with a null ``doc_id`` are
    cleaned like others; a long text is many lines; repeated rows are cleaned alike; an empty table gives an empty table.
    """
    out = line_dedup.remove_spread_lines(spark, docs.select(*COLUMNS), keep_whole=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Rows that are equal in id and text are one document, and one of them stays (that with the smallest ``lang``, ``source`` and
    ``n_chars``, nulls first). Of different texts with the group's smallest id all stay. Null and empty texts link with
    nothing, and rows without an id link with nothing, so they stay, one of equal ones; a long text is one set; an empty
    table gives an empty table.
    """
    docs = docs.select(*COLUMNS)
    out = near_dedup.near_duplicates(spark, docs).where("kept").select(F.col("doc_id").alias("k")).distinct()
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["k"]), "left_semi")
    # Rows are compared by hashes of id and text; the rest of the smallest of equal rows is all that is kept of them.
    ids = kept.select("doc_id", F.sha2("text", 256).alias("h"), F.struct("lang", "source", "n_chars").alias("rest"))
    repeated = ids.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts, and items, match nothing; a document without an id goes if any such document contains an item;
    a long text is one sequence; repeated rows go or stay together; an empty table gives an empty table, and an empty
    benchmark keeps all.
    """
    found = decontaminate.contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select(F.col("doc_id").alias("k")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["k"]), "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the training mix takes.

    A null text has size 0; a null source is the last source; a null id has a key of its own; a document without a label, or
    with a null one, weighs 1; a long text is one document; repeated rows are separate documents; an empty table gives an
    empty table.
    """
    return mixing.mix(spark, docs, document_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near", near), ("decontaminated", decontaminated), ("mixture", mixture)]

#: Language models, components of similar texts and tilings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), stages_so_far()
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What the stage read and wrote on its way is not needed any more.
        drop_stages(spark, since, (f"pipeline-{name}",))
    return docs
