"""Hard negatives for training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rerank import jaccard


def hard_negatives(pairs: DataFrame, hits: DataFrame, chunks: DataFrame, per_positive: int = 5, near: float = 0.85, fill: bool = True, seed: int = 42) -> DataFrame:
    """(pair, positive, neg, source, place): up to per_positive negatives of each pair whose positive is a chunk.

    pairs (pair, positive, extra array, manual array); hits (pair, doc, rank) from lexical search; chunks (doc,
    terms). In order: manual ones that are chunks, as they come; hits that are no positive and whose tokens are
    not nearly the positive's; then others in the order of md5(seed, pair, id), drawn for each pair from all
    chunks by md5(seed, pair, draw). Pairs without any negative do not come out.
    """
    known = pairs.join(chunks.select(F.col("doc").alias("positive"), F.col("terms").alias("positive_terms")), "positive")
    manual = known.select("pair", "positive", F.posexplode("manual").alias("order", "neg")).join(chunks.select(F.col("doc").alias("neg")), "neg")
    manual = manual.select("pair", "positive", "neg", F.lit(0).alias("tier"), F.col("order").cast("long"), F.lit("manual").alias("source"))
    barred = known.select("pair", F.explode(F.concat(F.array("positive"), F.coalesce("extra", F.array().cast(known.schema["extra"].dataType)))).alias("neg"))
    allowed = hits.select("pair", F.col("doc").alias("neg"), "rank").join(barred, ["pair", "neg"], "left_anti")
    mined = allowed.join(known.select("pair", "positive", "positive_terms"), "pair").join(chunks.select(F.col("doc").alias("neg"), "terms"), "neg")
    mined = mined.where(jaccard(F.col("positive_terms"), F.col("terms")) < near)
    mined = mined.select("pair", "positive", "neg", F.lit(1).alias("tier"), F.col("rank").cast("long").alias("order"), F.lit("bm25").alias("source"))
    every = manual.unionByName(mined)
    if fill:
        # A pair bars its positives, its manual negatives and its hits; so many extra make sure that enough are left.
        barred_most = known.agg(F.coalesce(F.max(F.size("extra") + F.size("manual")), F.lit(0))).first()[0]
        # Chunks get dense positions by md5 of their id, in buckets that are numbered apart and then put after each other.
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc").cast("string")))
        bucketed = chunks.select(F.col("doc").alias("neg"), digest.alias("digest"), F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("bucket"))
        sizes = dict(tuple(r) for r in bucketed.groupBy("bucket").count().collect())
        starts, total = [], 0
        for bucket in range(16**3):
            starts.append(total)
            total += sizes.get(bucket, 0)
        start = chunks.sparkSession.createDataFrame(list(enumerate(starts)), "bucket int, start long")
        numbered = bucketed.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "neg")) - 1)
        numbered = numbered.join(F.broadcast(start), "bucket").select("neg", (F.col("start") + F.col("k")).alias("at"))
        # One draw from each of n equal stretches of the corpus: no chunk twice, and any chunk for any pair.
        n = max(1, min(total, 2 * per_positive + 1 + barred_most))
        low, high = F.expr(f"j * {total}L div {n}"), F.expr(f"(j + 1) * {total}L div {n}")
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("long")
        draws = known.select("pair", "positive", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select("pair", "positive", (low + draw % (high - low)).alias("at"))
        others = draws.join(numbered, "at").drop("at").join(barred, ["pair", "neg"], "left_anti")
        key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair").cast("string"), F.col("neg").cast("string"))), 1, 12), 16, 10).cast("long")
        every = every.unionByName(others.select("pair", "positive", "neg", F.lit(2).alias("tier"), key.alias("order"), F.lit("random").alias("source")))
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("pair", "neg").orderBy("tier", "order"))).where("n = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy("tier", "order", "neg")))
    return placed.where(F.col("place") <= per_positive).select("pair", "positive", "neg", "source", "place")
