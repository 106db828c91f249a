"""Exact nearest neighbours of a batch of query vectors, by blocks of queries.

Each partition multiplies its vectors with a block of queries and keeps its k best for each; the partitions'
rows meet in one per-query top-k. The queries are a stated set: blocks of `block` go to the executors one
after the other, so the broadcast has a fixed bound, and no pair of vectors becomes a row before it is among
a partition's best.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stages import ship, staged

METRICS = ("cosine", "ip", "l2")

#: Scores, and numbers of vectors, that a Python worker holds at once; queries of a block that it takes at once.
SCORES_AT_ONCE, NUMBERS_AT_ONCE, QUERIES_AT_ONCE = 500_000, 1_000_000, 256


def similarity(metric: str, distance: Column) -> Column:
    """A store's distance as a similarity."""
    return 1.0 - distance if metric == "cosine" else -distance


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A row for each query, a column for each vector; for cosine both are of unit length."""
    if metric == "l2":
        return -np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2.0 * q @ x.T))
    return q @ x.T


def _best(metric: str, k: int, names: list, matrix):
    """Of each partition the k best vectors for each query. matrix: a broadcast of the queries' vectors."""

    def run(batches):
        asked = _unit(matrix.value) if metric == "cosine" else matrix.value
        best: dict = {}
        # The last of a query's k best so far: what scores less by more than the rounding is not looked at again.
        floor = np.full(len(names), -np.inf)
        rows_at_once = max(1, min(SCORES_AT_ONCE // min(len(names), QUERIES_AT_ONCE), NUMBERS_AT_ONCE // max(1, asked.shape[1])))
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(start, rows_at_once)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = _unit(x) if metric == "cosine" else x
                for first in range(0, len(names), QUERIES_AT_ONCE):
                    for j, scores in enumerate(_scores(metric, x, asked[first : first + QUERIES_AT_ONCE]), first):
                        at = np.flatnonzero(scores >= floor[j] - max(1e-6, 1e-12 * abs(floor[j])))
                        if not len(at):
                            continue
                        i, v = ids[at], np.round(scores[at], 6) + 0.0  # no negative zeros
                        if len(v) > k:
                            at = np.flatnonzero(v >= np.partition(v, -k)[-k])
                            i, v = i[at], v[at]
                        if j in best:
                            i, v = np.concatenate([best[j][0], i]), np.concatenate([best[j][1], v])
                        order = np.lexsort((i, -v))[:k]
                        best[j] = i[order], v[order]
                        if len(order) == k:
                            floor[j] = v[order[-1]]
        for j, (i, v) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[j]] * len(i)), pa.array(i), pa.array(v)], ["query", "id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query", query_vec: str = "embedding", keep: Column | None = None, block: int = 4096) -> DataFrame:
    """(query, id, rank, score): the k most similar vectors, by score rounded to 6 places and then id.

    keep: a filter on vectors' columns, applied before the search. Null vectors are no one's neighbours.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    rows = vectors if keep is None else vectors.where(keep)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    kinds = asked.schema["query"].dataType, rows.schema["id"].dataType
    out = T.StructType([T.StructField("query", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])

    # Blocks by a hash of the query: half full on average, so that hardly any exceeds `block`; those that do are cut on the driver.
    asked = staged(asked)
    n, lists = asked.count(), []
    n_blocks = 1 if n <= block else -(-2 * n // block)
    for i in range(n_blocks if n else 0):
        got = asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == i).select("query", "v").collect()
        for at in range(0, len(got), block):
            some = got[at : at + block]
            matrix = spark.sparkContext.broadcast(np.array([r.v for r in some], np.float64))
            lists.append(rows.mapInArrow(_best(metric, k, [r["query"] for r in some], matrix), out))
    if not lists:
        return spark.createDataFrame([], T.StructType([*out.fields[:2], T.StructField("rank", T.IntegerType()), out.fields[2]]))
    every = reduce(DataFrame.unionByName, lists)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank", "score")


def upsert(current: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """new, and what current has besides; of repeated keys in new one row stays."""
    new = new.dropDuplicates([key])
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def add(current: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Both; a key that exists already is an error when the rows are read."""
    counted = current.unionByName(new).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    checked = F.assert_true(F.col("__n") == 1, F.lit(f"{key} exists already"))
    return counted.where(checked.isNull()).drop("__n")


class VectorTable:
    """Vectors kept as Parquet, in numbered versions: a reader never sees half of a change."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path, key

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))

    def read(self) -> DataFrame | None:
        have = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={have[-1]}") if have else None

    def _write(self, df: DataFrame) -> None:
        """The next version; what a failed write left there goes."""
        df.write.mode("overwrite").parquet(f"{self.path}/v={(self._versions() or [0])[-1] + 1}")

    def upsert(self, new: DataFrame) -> None:
        have = self.read()
        self._write(new.dropDuplicates([self.key]) if have is None else upsert(have, new, self.key))

    def add(self, new: DataFrame) -> None:
        have = self.read()
        self._write(add(new.limit(0) if have is None else have, new, self.key))

    def count(self) -> int:
        """0 where nothing is kept."""
        have = self.read()
        return 0 if have is None else have.count()

    def reset(self) -> None:
        """An empty version, if there is any."""
        if (have := self.read()) is not None:
            self._write(have.limit(0))
