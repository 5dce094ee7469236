"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, then the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_lm
from filmloom.llm.tables import table
from filmloom.plans.storage import write_through


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    judged = quality_lm.classify(docs.withColumnsRenamed({c: f"__own_{c}" for c in _ADDED if c in docs.columns}), table(spark, sf_dir, "labels"))
    return judged.filter("kept").drop(*_ADDED).withColumnsRenamed({f"__own_{c}": c for c in _ADDED})


_ADDED = ("perplexity", "threshold", "kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document that loses all its text stays, as an empty one."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; rows without a doc_id stay."""
    kept = minhash_dedup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, F.col("doc_id").cast("bigint") == F.col("__kept"), "left_semi")
    return named.unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each draw, with its shard, pass and position."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
]

#: The quality model and the comparison of near duplicates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
