"""Reranking and context selection over candidates (query, doc, rank, ..., columns of the hit)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 where either is empty or null."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def overlap(asked: Column, doc: Column) -> Column:
    """The share of the asked tokens, as a set, that the document has."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, doc)) / F.size(F.array_distinct(asked))).otherwise(0.0)


def rerank(candidates: DataFrame, predictor: Callable[[], Column] | Column | None, top_k: int = 3, on_error: str = "raise") -> DataFrame:
    """Candidates with cross_encoder_score, pre_rerank_rank and their new rank, the top_k best of each query.

    predictor: a column, or a function that gives one, of the score; a model's pandas UDF must be marked
    nondeterministic, or each later use of the score runs it again. None keeps the order, with all zeros.
    on_error="input_order": a score that is null gives way to n, n - 1, ... in the order that came in.
    """
    score = F.lit(0.0) if predictor is None else predictor() if callable(predictor) else predictor
    scored = candidates.withColumn("cross_encoder_score", score.cast("double")).withColumn("pre_rerank_rank", F.col("rank").cast("int"))
    if on_error == "input_order":
        n = F.count("*").over(Window.partitionBy("query"))
        failed = F.max(F.col("cross_encoder_score").isNull()).over(Window.partitionBy("query"))
        scored = scored.withColumn("cross_encoder_score", F.when(failed, (n - F.col("pre_rerank_rank") + 1).cast("double")).otherwise(F.col("cross_encoder_score")))
    w = Window.partitionBy("query").orderBy(F.desc("cross_encoder_score"), "pre_rerank_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def low_confidence_fallback(candidates: DataFrame, reranked: DataFrame, keep: int = 2, floor: float = 0.1) -> DataFrame:
    """reranked's first `keep` rows; where their best score is under floor, the first `keep` candidates with rrf_score for their score."""
    best = reranked.groupBy("query").agg(F.max("cross_encoder_score").alias("best"))
    good = reranked.where(F.col("rank") <= keep).join(best.where(F.col("best") >= floor).select("query"), "query", "left_semi")
    poor = candidates.where(F.col("rank") <= keep).join(best.where(F.col("best") < floor).select("query"), "query", "left_semi")
    poor = poor.withColumn("pre_rerank_rank", F.col("rank").cast("int")).withColumn("cross_encoder_score", F.coalesce(F.col("rrf_score"), F.lit(1.0)))
    return good.unionByName(poor.select(*good.columns))


def merge_intents(tops: DataFrame, final_top_k: int = 3) -> DataFrame:
    """tops (query, intent, doc, rank, cross_encoder_score) as (query, doc, intent, cross_encoder_score, guaranteed, position).

    Every intent's first document stays, in the order of intents, however many there are; then the best
    others by score until there are final_top_k + 2. A document counts once.
    """
    firsts = tops.withColumn("first", (F.col("rank") == 1).cast("int"))
    lead = Window.partitionBy("query", "doc").orderBy(F.desc("first"), F.when(F.col("first") == 1, F.col("intent")), F.desc("cross_encoder_score"), "intent", "rank")
    once = firsts.withColumn("n", F.row_number().over(lead)).where("n = 1").drop("n")
    order = Window.partitionBy("query").orderBy(F.desc("first"), F.when(F.col("first") == 1, F.col("intent")), F.desc("cross_encoder_score"), "intent", "rank")
    placed = once.withColumn("position", F.row_number().over(order))
    return placed.where((F.col("first") == 1) | (F.col("position") <= final_top_k + 2)).select("query", "doc", "intent", "cross_encoder_score", (F.col("first") == 1).alias("guaranteed"), "position")


def gate(sources: DataFrame, queries: DataFrame, threshold: float | None) -> DataFrame:
    """(query, n_sources, top_score, refused): refused without sources, or if the first one's score is under the threshold."""
    first = sources.groupBy("query").agg(F.count("*").alias("n"), F.min_by("cross_encoder_score", "rank").alias("top_score"))
    out = queries.select("query").join(first, "query", "left")
    low = F.lit(False) if threshold is None else F.coalesce(F.col("top_score") < threshold, F.lit(False))
    return out.select("query", F.coalesce("n", F.lit(0)).alias("n_sources"), "top_score", (F.col("n").isNull() | low).alias("refused"))


def ranking_loss(scores: Column, scale: float = 20.0) -> Column:
    """-log softmax of the first of an array of scores, the positive's, after scaling."""
    z = F.transform(scores, lambda s: s * F.lit(scale))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - z[0]
