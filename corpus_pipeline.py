"""The corpus pipeline: rules, near copies, repeated passages, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.llm import mixing, near, packing, quality, queries, substrings
from talusgrid.llm.common import clear, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id."""
    return near.keep_first(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeated windows cover go; a document without words left, too."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS))
    return cut.where("rs_words > rs_removed").select(
        "doc_id",
        F.col("rs_text").alias("text"),
        "lang",
        "source",
        F.length("rs_text").cast("long").alias("n_chars"),
    )


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, rare sources' more often, up to the limit."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return packing.pack(docs, queries.vocabulary(queries.WORD_VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed_sources),
    ("packing", packed),
]

#: Near copies, repeated windows and best fit are beyond SQL; tests/llm/test_pipeline.py
#: holds each stage, and run, against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    What a stage wrote on its way is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = written()
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, since, keep=1)
    return packed(spark, docs, sf_dir)
