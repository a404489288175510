"""The training-data queries: one thin query per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm import bpe, contamination, html, licenses, lmscore, neardup, pii, quality, sharding, sql, substrings
from quantaloom.runtime import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_trained_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op8_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.decide(table(spark, sf_dir, "documents"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents"), target)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
