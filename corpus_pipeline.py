"""The corpus pipeline: quality rules, near duplicates, decontamination, PII, mixing.

Each stage takes all that its predecessor kept, and all but the last return the columns of documents. The
last returns the mix: for each document how many words its source gives, aims at, and takes from it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table, and extra columns of any name, which it
passes on; what each of them means for a stage is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sedra.llm import decontaminate, mixing, near_copies, pii, quality, simhash
from sedra.llm.common import remove, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much go. Null, empty and short texts fail; repeated rows are judged each."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: five words, a similarity of 0.8.

    Of repeated rows one stays, of equal ids the one with the smallest text hash; a row without an id stays only where its group has no id.
    """
    return simhash.keep_one(docs, groups=near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none; texts that share an id, or have none, are judged each."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to surrogates, and n_chars follows. Null texts stay null; equal entities get equal surrogates in all rows."""
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes from each document. Texts without words give nothing; a null source is one of its own; repeated rows get a row each."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("mixing", mix),
]

#: No stage but the last two can be said in SQL (fingerprint components, template windows).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet and read as the next one's docs."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)  # read for the last time
        docs, before = spark.read.parquet(path), path
    return docs
