"""The queries of this subpackage, by name: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import bpe, chat, decontaminate, fingerprint, licenses, maxent, neardup, pii, substrings, toxicity
from tablewarden.llm.common import source


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.digest(source(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(source(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(source(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(source(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(source(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(source(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(source(spark, sf_dir, "conversations")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(source(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent": op1_maxent,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_license_scan": op5_license_scan,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op8_chat_format": chat.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
}
