"""Readers and writers. Every schema is explicit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import ship

ARTICLES = ["chapter_number", "chapter_title", "article_number", "article_title", "content", "doc_short", "source_doc"]
PAIRS = "query string, positive_chunk_id string, extra_positive_ids array<string>, manual_negative_ids array<string>"


def read_articles(spark: SparkSession, path: str, source_doc: str | None = None, doc_short: str | None = None, only: str | None = None) -> DataFrame:
    """Article rows of a CSV file, with doc_seq, their order in the file.

    The file can begin with a byte order mark and have line breaks inside quotes. Where it has no columns
    doc_short and source_doc, the arguments stand for them. only: a doc_short to keep.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if lost := set(ARTICLES[:5]) - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(lost)}")
    df = raw.withColumn("doc_seq", F.monotonically_increasing_id())
    if not {"doc_short", "source_doc"} <= set(raw.columns):
        df = df.withColumn("doc_short", F.lit(doc_short)).withColumn("source_doc", F.lit(source_doc))
    df = df.select("doc_seq", *[F.col(c).cast("string") for c in ARTICLES])
    return df.where(F.col("doc_short") == only) if only else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return df.sparkSession.read.text(path).count()


def read_yaml(path: str, spark: SparkSession | None = None) -> dict:
    """Configuration, on the driver; with a session, from any store that Spark reads."""
    if spark is not None:
        return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs; missing arrays are empty."""
    df = read_jsonl(spark, path, PAIRS)
    return df.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("extra_positive_ids", "manual_negative_ids")})


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks by chunk_id, or id; of repeated keys the last stays, by file, place of the split in it, and line; rows without a key go."""
    df = read_jsonl(spark, path, schema)
    key = F.coalesce(*[F.col(c) for c in ("chunk_id", "id") if c in df.columns])
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = df.select(key.alias("key"), at.alias("at"), F.struct(*df.columns).alias("row")).where("key is not null")
    last = rows.groupBy("key").agg(F.max_by("row", "at").alias("row"))
    return last.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "chunk_id"], F.col("key").alias("chunk_id")).select("chunk_id", *[c for c in df.columns if c != "chunk_id"])


def read_binary_pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """(path, page_num, text): the pages that a parser, run on the executors, finds in each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.path, i, t) for r in f.itertuples() for i, t in enumerate(parser(bytes(r.content)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_num", "text"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string")


def full_texts(pages: DataFrame) -> DataFrame:
    """(path, text): the pages of a file, cleaned, a blank line between them."""
    from ..operators.chunk import clean_page

    parts = F.sort_array(F.collect_list(F.struct("page_num", clean_page(F.col("text")).alias("text"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def read_tables(spark: SparkSession, path: str, parser: Callable[[bytes], list[tuple[int, list[list[str]]]]], doc_short: str, pattern: str = "*.pdf") -> DataFrame:
    """(table_id, page_num, rows): tables that a parser finds as (page, rows); ids number all of a page's tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                n: dict[int, int] = {}
                for page, rows in parser(bytes(r.content)):
                    n[page] = n.get(page, 0) + 1
                    out.append((f"{doc_short}__page{page}__t{n[page]}", page, rows))
            yield pd.DataFrame(out, columns=["table_id", "page_num", "rows"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("content").mapInPandas(run, "table_id string, page_num int, rows array<array<string>>")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def ragas_rows(cases: DataFrame) -> DataFrame:
    """Judged cases for a CSV: the number of contexts in their place."""
    return cases.withColumn("n_contexts", F.size("contexts")).drop("contexts")


def mined_rows(mined: DataFrame) -> DataFrame:
    """Mined examples for a dump: without the negatives' texts."""
    return mined.drop("negatives", "hard_negative_texts")


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON text, nested structs and arrays included, nulls kept."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Rows of such texts again."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")
