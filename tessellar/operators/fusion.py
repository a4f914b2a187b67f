"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(hits: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Hits with their 1-based rank; ``hits`` is a limited list, small by construction."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def fuse(knn: DataFrame, fts: DataFrame, k: int, weight_vec: float = 1.0, weight_fts: float = 1.0, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score, normalized_score, vec_rank, fts_rank, source) of two rank lists (id, rank); ties by id."""
    a = knn.select("id", F.col("rank").alias("vec_rank"))
    b = fts.select("id", F.col("rank").alias("fts_rank"))
    both = a.join(b, "id", "full_outer")
    score = F.coalesce(F.lit(weight_vec) / (rrf_k + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(F.lit(weight_fts) / (rrf_k + F.col("fts_rank")), F.lit(0.0))
    source = F.when(F.col("vec_rank").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vec_rank").isNotNull(), "knn").otherwise("fts")
    top = max_score(weight_vec, weight_fts, rrf_k=rrf_k)
    return both.select("id", score.alias("score"), (score / top).alias("normalized_score"), "vec_rank", "fts_rank", source.alias("source")).orderBy(F.desc("score"), "id").limit(k)


def max_score(*weights: float, rrf_k: int = RRF_K) -> float:
    return sum(w / (rrf_k + 1) for w in weights) or 1.0


def fuse_lists(lists: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score) of any number of weighted lists (id, rank, weight)."""
    return lists.groupBy("id").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("score"))
