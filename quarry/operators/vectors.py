"""Exact nearest neighbours and the vector index's result shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot-product")
DEFAULT_K, MOST_K, MOST_K_WITH_VALUES = 5, 100, 50
#: Up to this dimension sums are written out, which stays in generated code.
UNROLLED = 256


def dot(v: Column, q: Sequence[float]) -> Column:
    q = [float(x) for x in q]
    if len(q) <= UNROLLED:
        out = F.lit(0.0)
        for i, x in enumerate(q):
            out = out + F.get(v, F.lit(i)).cast("double") * F.lit(x)
        return out
    return F.aggregate(F.zip_with(v, F.array(*map(F.lit, q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def squared(v: Column, dim: int) -> Column:
    if dim <= UNROLLED:
        out = F.lit(0.0)
        for i in range(dim):
            x = F.get(v, F.lit(i)).cast("double")
            out = out + x * x
        return out
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2(v: Column, q: Sequence[float]) -> Column:
    if len(q) <= UNROLLED:
        out = F.lit(0.0)
        for i, x in enumerate(q):
            d = F.get(v, F.lit(i)).cast("double") - F.lit(float(x))
            out = out + d * d
        return F.sqrt(out)
    return F.sqrt(F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in q)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def distance(v: Column, q: Sequence[float], metric: str) -> Column:
    """Smaller is nearer.  Dot product is computed as cosine; a zero vector has no cosine, hence no distance."""
    if metric == "euclidean":
        return l2(v, q)
    norm = sum(float(x) ** 2 for x in q) ** 0.5
    return 1 - F.try_divide(dot(v, q), F.sqrt(squared(v, len(q))) * F.lit(norm))


def score(distance: Column, metric: str) -> Column:
    return distance if metric == "euclidean" else 1 - distance / 2


def check_k(k: int | None, values: bool = False, metadata: str | bool = "none") -> int:
    k = DEFAULT_K if k is None else k
    if k < 1:
        raise ValueError("topK must be at least 1")
    most = MOST_K_WITH_VALUES if values or metadata in ("all", True) else MOST_K
    if k > most:
        raise ValueError(f"topK must be at most {most} here")
    return k


def nearest(vectors: DataFrame, q: Sequence[float], k: int, metric: str = "euclidean", id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """All columns and ``distance``; ties by id.  Vectors without a distance come last."""
    return vectors.withColumn("distance", distance(F.col(vector_col), q, metric)).orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def query(vectors: DataFrame, q: Sequence[float], k: int | None = None, metric: str = "cosine", namespace: str | None = None, where: Column | None = None, return_values: bool = False, return_metadata: str | bool = "none") -> DataFrame:
    """``(id, score, namespace)`` and what is asked for.

    The max(5 k, 100) nearest of all vectors are found first and filtered
    afterwards, so a filter can leave fewer than k although more would match.
    """
    k = check_k(k, return_values, return_metadata)
    out = nearest(vectors, q, max(5 * k, 100), metric)
    if namespace is not None:
        out = out.filter(F.col("namespace") == namespace)
    if where is not None:
        out = out.filter(where)
    out = out.orderBy(F.asc_nulls_last("distance"), "id").limit(k)
    more = ["values"] * return_values + ["metadata"] * (return_metadata not in ("none", False, None))
    return out.select("id", score(F.col("distance"), metric).alias("score"), "namespace", *more)


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "values", digits: int | None = None, block: int = 10_000) -> DataFrame:
    """``(query_id, id, distance)``: the k nearest by L2, then id, of every row of ``queries`` (query_id, values), a stated set.

    With ``digits``, distances that round alike are equally near.  Queries are
    sent to the executors in blocks; each task keeps its k best for each, and k
    a query and task are ranked.
    """
    from itertools import batched

    parts = [_block_nearest(vectors, queries, rows, k, id_col, vector_col, digits) for rows in batched(queries.select("query_id", "values").toLocalIterator(), block)]
    out = parts[0] if parts else _block_nearest(vectors, queries, (), k, id_col, vector_col, digits)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_nearest(vectors: DataFrame, queries: DataFrame, rows: Sequence, k: int, id_col: str, vector_col: str, digits: int | None) -> DataFrame:
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["values"] for r in rows], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, (matrix**2).sum(1) if len(rows) else None))
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())

    def best(batches):
        ids, q, qq = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            xx, own, n = (x**2).sum(1), pdf["id"].to_numpy(), min(k, x.shape[0])
            for s in range(0, len(ids), 500):
                d = np.sqrt(np.maximum(0, qq[s : s + 500, None] - 2 * q[s : s + 500] @ x.T + xx))
                d_ = d if digits is None else np.round(d, digits)
                most = np.partition(d_, n - 1, 1)[:, n - 1]
                top = []
                for i in range(len(d)):
                    tied = np.flatnonzero(d_[i] <= most[i])
                    top.append(tied[np.lexsort((own[tied], d_[i][tied]))[:n]])
                top = np.stack(top)
                yield pd.DataFrame({"query_id": np.repeat(ids[s : s + 500], n), "id": own[top.ravel()], "distance": np.take_along_axis(d, top, 1).ravel()})

    near = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance" if digits is None else F.round("distance", digits), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
