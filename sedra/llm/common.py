"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import remove, shared_dir, ship  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc32_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def texts(batch: pa.RecordBatch, column: str) -> list:
    """The column as a list of str or None."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
