"""What both vector searches share: usable vectors, copies of a vector as one, and the final ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 100


def usable(vectors: DataFrame, key: Column) -> DataFrame:
    """vec_id, key: rows with an id and a vector of finite components that is not empty."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """key, ids: the keep smallest ids of each distinct vector.

    More than keep ids of one vector can never be among keep results, so a vector that a third of all rows share costs no more
    than any other: Spark cuts each task's rows to keep before the shuffle.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    return rows.distinct().withColumn("__n", first).where(F.col("__n") <= keep).groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def queries_of(rows: DataFrame) -> DataFrame:
    """query_id, key: rows whose id is divisible by QUERY_EVERY, each once."""
    return rows.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), "key").distinct()


def ranked(queries: DataFrame, found: DataFrame, k: int, best: Column) -> DataFrame:
    """query_id, rank, vec_id, score from found (key, vec_id, score), without a query's own id."""
    w = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return queries.join(found, "key").where("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(keys, dtype=np.int64) -> np.ndarray:
    return np.array([np.asarray(x, dtype) for x in keys], dtype).reshape(len(keys), -1)
