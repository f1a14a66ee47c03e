"""The corpus pipeline: named stages over ``documents``, each written as Parquet and read again before the next.

All stages but the last keep the columns of ``documents``; each works on all that its predecessor kept:
toxic documents go, one document of each near-duplicate group stays (five-word shingles, similarity 0.8),
documents with a benchmark passage go, personal data is masked, and the last stage encodes and decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import bpe, decontaminate, neardup, pii, toxicity
from tablewarden.llm.common import source, written
from tablewarden.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.rejected(docs, source(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, source(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", tokenize),
]
#: Learning and merging by rank are beyond SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
