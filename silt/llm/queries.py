"""The queries of the text operators, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silt.llm import archives, chat, decontaminate, manifest, mixing, parsing, periods, pieces, pii, quality, repeats, scoring, simhash
from silt.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.report(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.report(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, table(spark, sf_dir, "conversations"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_fingerprints": op5_fingerprints,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_repeats": repeats.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op7_warc": archives.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
    "op11_runs": periods.ORACLE_SQL,
    "op12_manifest": manifest.ORACLE_SQL,
}
