"""Reciprocal rank fusion and what surrounds it. Ranked lists are rows (query, list_id, doc, rank[, score])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import staged


def _weight(weights: Sequence[float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_id") + 1)


def check_weights(n_lists: int, weights: Sequence[float] | None) -> None:
    if weights is not None and len(weights) != n_lists:
        raise ValueError(f"{len(weights)} weights for {n_lists} lists")


def rrf(lists: DataFrame, k: int = 60, weights: Sequence[float] | None = None, n_lists: int | None = None) -> DataFrame:
    """(query, doc, rrf_score, rank): the sum of weight / (k + rank) over the lists; ties keep first-seen order."""
    if n_lists is not None:
        check_weights(n_lists, weights)
    part = _weight(weights) / (F.lit(float(k)) + F.col("rank"))
    fused = lists.groupBy("query", "doc").agg(F.sum(part).alias("raw"), F.min(F.struct("list_id", "rank")).alias("seen"))
    fused = fused.withColumn("rrf_score", F.round("raw", 12))
    w = Window.partitionBy("query").orderBy(F.desc("rrf_score"), "seen")
    return fused.withColumn("rank", F.row_number().over(w)).select("query", "doc", "rrf_score", "rank")


def explain(lists: DataFrame, names: Sequence[str], k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """(query, doc, <name>_rank, <name>_contribution, ..., total): rank infinite and contribution 0 where a list lacks it."""
    check_weights(len(names), weights)
    part = _weight(weights) / (F.lit(float(k)) + F.col("rank"))
    cols = []
    for i, name in enumerate(names):
        here = F.col("list_id") == i
        cols.append(F.coalesce(F.min(F.when(here, F.col("rank").cast("double"))), F.lit(float("inf"))).alias(f"{name}_rank"))
        cols.append(F.coalesce(F.sum(F.when(here, part)), F.lit(0.0)).alias(f"{name}_contribution"))
    return lists.groupBy("query", "doc").agg(*cols, F.sum(part).alias("total"))


def provenance(fused: DataFrame, bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """fused with bm25_rank, dense_rank and retrievers: bm25, dense or both."""
    a = bm25.select("query", "doc", F.col("rank").alias("bm25_rank"))
    b = dense.select("query", "doc", F.col("rank").alias("dense_rank"))
    out = fused.join(a, ["query", "doc"], "left").join(b, ["query", "doc"], "left")
    both = F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull()
    return out.withColumn("retrievers", F.when(both, "both").when(F.col("bm25_rank").isNotNull(), "bm25").when(F.col("dense_rank").isNotNull(), "dense"))


def hydrate(fused: DataFrame, chunks: DataFrame, k: int, key: str = "doc") -> DataFrame:
    """The first k of each query with their chunk's columns; ids without a chunk are skipped, so fewer can come out."""
    return fused.where(F.col("rank") <= k).join(chunks, key)


def hybrid(bm25: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """Two ranked lists (query, doc, rank) fused, cut at k, with provenance. An arm may be an empty table. Both are read twice, and staged."""
    bm25, dense = (staged(x.select("query", "doc", "rank")) for x in (bm25, dense))
    lists = bm25.select("query", "doc", "rank").withColumn("list_id", F.lit(0)).unionByName(dense.select("query", "doc", "rank").withColumn("list_id", F.lit(1)))
    return provenance(rrf(lists, rrf_k, weights, 2).where(F.col("rank") <= k), bm25, dense)


def merge_subqueries(hits: DataFrame) -> DataFrame:
    """hits (query, sub, doc, rank, rrf_score) as (query, doc, sub, rrf_score, rank): the first sub-query's occurrence
    of a document stays, then the best score leads; ties in the order they came."""
    first = Window.partitionBy("query", "doc").orderBy("sub", "rank")
    once = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("query").orderBy(F.desc("rrf_score"), "sub", "rank")
    return once.withColumn("place", F.row_number().over(order)).select("query", "doc", "sub", "rrf_score", F.col("place").alias("rank"))
