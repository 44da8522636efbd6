"""Incremental builds: what changed, what must be embedded, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, change)``: new, changed, unchanged or removed, by content hash, in one join."""
    old = tracked.select("path", F.col("content_hash").alias("old_hash"))
    new = current.select("path", F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def cache_misses(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``(content_hash, content)``: what the cache lacks for the model, each hash once."""
    known = cache.filter(F.col("model") == model).select("content_hash")
    return chunks.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` in place of those that share their keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def retained(logs: DataFrame, now, days: int = 7, time: str = "modified", name: str = "name", kept_prefix: str = "reported-") -> DataFrame:
    """Logs of at most ``days`` days, and all whose names begin with the prefix."""
    return logs.filter((F.col(time) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")) | F.startswith(F.col(name), F.lit(kept_prefix)))
