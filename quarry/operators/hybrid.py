"""Weighted reciprocal rank fusion of a vector and a text ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, SHORT = 60, 100
VECTOR_WEIGHT, VECTOR_WEIGHT_ALONE, BOTH, VECTOR_ONLY = 0.3, 0.7, 1.5, 0.5


def _ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Ranks of a handful of rows that a limit has left; so one task is enough."""
    return rows.select("chunk_id", F.row_number().over(Window.orderBy(order, "chunk_id")).cast("bigint").alias(name))


def fuse(near: DataFrame, found: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """``(chunk_id, score, v_rank, f_rank)`` from the 3k nearest (chunk_id, content, distance) and the 2k best of full text (chunk_id, bm25).

    Contents under 100 characters drop out of the vector side before it is
    ranked.  The text side weighs 0.7, or 0.3 if it is empty; being on both
    sides counts 1.5 times, being on the vector side alone half, unless the
    text side is empty.
    """
    v = _ranked(near.filter(F.length("content") >= SHORT), "distance", "v_rank")
    f = _ranked(found, "bm25", "f_rank")
    some = F.broadcast(f.agg((F.count("*") > 0).alias("some")))
    w = F.when(F.col("some"), VECTOR_WEIGHT).otherwise(VECTOR_WEIGHT_ALONE)
    v_part = F.when(F.col("v_rank").isNotNull(), w / (rrf_k + F.col("v_rank"))).otherwise(0.0)
    f_part = F.when(F.col("f_rank").isNotNull(), (1 - w) / (rrf_k + F.col("f_rank"))).otherwise(0.0)
    boost = F.when(F.col("v_rank").isNotNull() & F.col("f_rank").isNotNull(), BOTH).when(F.col("f_rank").isNull() & F.col("some"), VECTOR_ONLY).otherwise(1.0)
    both = v.join(f, "chunk_id", "full_outer").crossJoin(some).select("chunk_id", ((v_part + f_part) * boost).alias("score"), "v_rank", "f_rank")
    return both.orderBy(F.desc("score"), F.asc_nulls_last("v_rank"), "f_rank").limit(k)
