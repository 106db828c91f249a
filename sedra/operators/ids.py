"""Repeated ids, conversations, and small roll-ups."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disambiguate(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """The nth row of an id, in the given order, gets the suffix __occ<n> from the second on."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    name = F.col(id_col).cast("string")
    return df.withColumn(id_col, F.when(n > 1, F.concat(name, F.lit("__occ"), n.cast("string"))).otherwise(name))


def title(first_query: Column, fallback: str = "Cuộc hội thoại mới", length: int = 35) -> Column:
    """The first characters of a query, with dots where more follow, on one line."""
    text = F.coalesce(first_query, F.lit(""))
    short = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).when(text == "", fallback).otherwise(text)
    return F.trim(F.translate(short, "\n", " "))


class Sessions:
    """Conversations as an append-only log of Parquet files, a folder for each user.

    Rows: conversation_id, title, ts, messages array<struct<role, content>>, version, gone. Saving and deleting append a row in
    one committed write, so a reader never sees half of a change and a failure loses nothing; of a conversation's rows the one of
    the highest version counts.
    """

    SCHEMA = "conversation_id string, title string, ts string, messages array<struct<role:string,content:string>>, version long, gone boolean"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _read(self, user: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/user={user}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], self.SCHEMA)
        last = rows.groupBy("conversation_id").agg(F.max_by(F.struct("title", "ts", "messages", "gone"), "version").alias("r"))
        return last.select("conversation_id", "r.*").where(~F.col("gone")).drop("gone")

    def _append(self, user: str, rows: DataFrame) -> None:
        rows.withColumn("version", F.lit(time.time_ns())).select("conversation_id", "title", "ts", "messages", "version", "gone").write.mode("append").parquet(f"{self.path}/user={user}")

    def save(self, user: str, conversation: str, title_text: str, ts: str, messages: list[tuple[str, str]]) -> None:
        self._append(user, self.spark.createDataFrame([(conversation, title_text, ts, messages, 0, False)], self.SCHEMA))

    def save_all(self, user: str, rows: DataFrame) -> None:
        """rows: conversation_id, title, ts, messages; without passing through the driver."""
        self._append(user, rows.withColumn("gone", F.lit(False)))

    def load(self, user: str, conversation: str):
        row = self._read(user).where(F.col("conversation_id") == conversation).first()
        if row is None:
            raise FileNotFoundError(f"{user} has no conversation {conversation}")
        return row

    def list(self, user: str) -> DataFrame:
        """Newest first."""
        return self._read(user).select("conversation_id", "title", "ts").orderBy(F.desc("ts"), "conversation_id")

    def delete(self, user: str, conversation: str) -> None:
        self._append(user, self.spark.createDataFrame([(conversation, None, None, None, 0, True)], self.SCHEMA))
