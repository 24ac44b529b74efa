"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on what its predecessor kept.

Every stage but the last returns the columns of its input.  Rows with null keys or texts pass through each stage as its
operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import decontaminate, pieces, pii, quality, simhash
from silt.llm.common import delete, made_here, saved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.dedupe(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with placeholders for personal data; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece ids in place of texts, and how many."""
    return pieces.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and read again, and what led to it is deleted."""
    docs, read = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with made_here() as made:
            docs = saved(stage(spark, docs, sf_dir), name)
        done, read = [*read, *made[:-1]], made[-1:]
        delete(spark, done)
    return docs
