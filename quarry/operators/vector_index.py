"""A vector index in a folder: versioned Parquet and a pointer file; one writer at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors as V
from .filters import compile_filter

SCHEMA = "id string, values array<float>, namespace string, metadata string"
MOST_METADATA_INDEXES = 10


@dataclass(frozen=True)
class Mutation:
    mutation_id: str
    count: int
    ids: tuple[str, ...]


def last_wins(rows: DataFrame, position: str = "pos") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(position)))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def first_wins(rows: DataFrame, position: str = "pos") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(position))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def page(vectors: DataFrame, count: int | None = None, cursor: str | None = None) -> DataFrame:
    """Ids after the cursor, in order, one more than asked for if there are more; count is 100 by default, 1 to 1000."""
    n = min(max(100 if count is None else count, 1), 1000)
    rows = vectors.select("id") if cursor is None else vectors.filter(F.col("id") > cursor).select("id")
    return rows.orderBy("id").limit(n + 1)


class VectorIndex:
    """Opens the index in ``folder``, or makes it; other dimensions or another metric than it has are an error."""

    def __init__(self, spark: SparkSession, folder: str, dimensions: int | None = None, metric: str = "cosine", embedder: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._meta = self._load()
        if self._meta is None:
            if not dimensions or metric not in V.METRICS:
                raise ValueError("a new index needs dimensions and a known metric")
            self._meta = {"dimensions": dimensions, "metric": metric, "version": None, "last_mutation": None, "metadata_indexes": {}}
            self._save()
        elif dimensions not in (None, self._meta["dimensions"]) or metric != self._meta["metric"]:
            raise ValueError(f"the index has {self._meta['dimensions']} dimensions and metric {self._meta['metric']}")

    def _load(self) -> dict | None:
        rows = [r.value for r in self.spark.read.text(f"{self.folder}/index.json", wholetext=True).collect()] if self._fs.exists(self._path(f"{self.folder}/index.json")) else []
        return json.loads(rows[0]) if rows else None

    def _save(self) -> None:
        out = self._fs.create(self._path(f"{self.folder}/index.json.tmp"), True)
        out.write(bytearray(json.dumps(self._meta, indent=2).encode()))
        out.close()
        self._fs.delete(self._path(f"{self.folder}/index.json"), False)
        self._fs.rename(self._path(f"{self.folder}/index.json.tmp"), self._path(f"{self.folder}/index.json"))

    @property
    def vectors(self) -> DataFrame:
        if self._meta["version"] is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{self._meta['version']}")

    def _commit(self, table: DataFrame, ids: Sequence[str]) -> Mutation:
        old, mutation = self._meta.get("previous"), str(uuid.uuid4())  # the version in force stays for those that read it
        version = f"v-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{version}")
        self._meta |= {"version": version, "previous": self._meta["version"], "last_mutation": mutation}
        self._save()
        if old:
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)
        return Mutation(mutation, len(ids), tuple(ids))

    def _frame(self, rows: DataFrame) -> DataFrame:
        """A batch as a table of the index's columns (``pos`` tells which of repeated ids comes first; without it, any); one row that isn't valid rejects all of it."""
        rows = rows.select("id", F.col("values").cast("array<float>").alias("values"), *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("namespace", "metadata")), F.col("pos").cast("bigint") if "pos" in rows.columns else F.monotonically_increasing_id().alias("pos"))
        wrong = (F.coalesce("id", F.lit("")) == "") | F.col("values").isNull() | (F.size("values") != self._meta["dimensions"])
        if (bad := rows.filter(wrong).select("id", F.size("values").alias("n")).first()) is not None:
            raise ValueError(f"vector {bad['id']} has {bad['n']} dimensions, not {self._meta['dimensions']}, or has no id")
        return rows

    def load(self, rows: DataFrame, replace: bool = True) -> int:
        """``upsert`` (or ``insert``) of a table of any size, ``(id, values[, namespace, metadata, pos])``; how many rows of it are in the index then.  No row comes to the driver."""
        new = self._frame(rows)
        new = last_wins(new) if replace else first_wins(new).join(self.vectors.select("id"), "id", "left_anti")
        new, old = new.drop("pos"), self.vectors
        version = f"{self.folder}/batch-{uuid.uuid4().hex}"
        new.write.parquet(version)
        new = self.spark.read.schema(SCHEMA).parquet(version)
        self._commit((old.join(new.select("id"), "id", "left_anti") if replace else old).unionByName(new.select(old.columns)), [])
        n = new.count()
        self._fs.delete(self._path(version), True)
        return n

    def _rows(self, rows: Sequence[dict]) -> DataFrame:
        """A batch a caller holds; any row that isn't valid rejects all of it."""
        rows = [dict(r) for r in rows]
        texts = [r for r in rows if r.get("values") is None and r.get("text") is not None]
        if texts:
            if self.embedder is None:
                raise ValueError("texts need an embedder")
            for r, v in zip(texts, self.embedder([r["text"] for r in texts])):
                r["values"] = v
        for r in rows:
            if not r.get("id") or r.get("values") is None:
                raise ValueError("a vector needs an id and values")
            if len(r["values"]) != self._meta["dimensions"]:
                raise ValueError(f"vector {r['id']} has {len(r['values'])} dimensions, not {self._meta['dimensions']}")
        data = [(k, r["id"], [float(x) for x in r["values"]], r.get("namespace"), None if r.get("metadata") is None else json.dumps(r["metadata"])) for k, r in enumerate(rows)]
        return self.spark.createDataFrame(data, "pos bigint, " + SCHEMA)

    def insert(self, rows: Sequence[dict]) -> Mutation:
        """Ids that exist, or come again in the batch, are skipped; only the new ones are returned."""
        new = first_wins(self._rows(rows)).join(self.vectors.select("id"), "id", "left_anti")
        ids = [r["id"] for r in new.orderBy("pos").select("id").collect()]
        return self._commit(self.vectors.unionByName(new.drop("pos")), ids)

    def upsert(self, rows: Sequence[dict]) -> Mutation:
        """Rows replace those with the same id as a whole; of repeated ids the last wins, though all are returned."""
        new = last_wins(self._rows(rows)).drop("pos")
        return self._commit(self.vectors.join(new.select("id"), "id", "left_anti").unionByName(new), [r["id"] for r in rows])

    def delete_by_ids(self, ids: Sequence[str]) -> Mutation:
        gone = [r["id"] for r in self.vectors.filter(F.col("id").isin(list(ids))).select("id").collect()]
        return self._commit(self.vectors.filter(~F.col("id").isin(list(ids))), gone)

    def get_by_ids(self, ids: Sequence[str]) -> DataFrame:
        return self.vectors.filter(F.col("id").isin(list(ids)))

    def query(self, vector: Sequence[float] | str, top_k: int | None = None, namespace: str | None = None, filter: dict | None = None, return_values: bool = False, return_metadata: str | bool = "none") -> DataFrame:
        if isinstance(vector, str):
            if self.embedder is None:
                raise ValueError("a text query needs an embedder")
            vector = self.embedder([vector])[0]
        V.check_k(top_k, return_values, return_metadata)
        if len(vector) != self._meta["dimensions"]:
            raise ValueError(f"the query has {len(vector)} dimensions, not {self._meta['dimensions']}")
        return V.query(self.vectors, vector, top_k, self._meta["metric"], namespace, compile_filter(filter), return_values, return_metadata)

    def query_by_id(self, id: str, **options) -> DataFrame:
        found = self.vectors.filter(F.col("id") == id).select("values").first()
        if found is None:
            return self.query([0.0] * self._meta["dimensions"], **options).limit(0)
        return self.query(found["values"], **options)

    def list_vectors(self, count: int | None = None, cursor: str | None = None) -> dict:
        n = min(max(100 if count is None else count, 1), 1000)
        ids = [r["id"] for r in page(self.vectors, n, cursor).collect()]
        more = len(ids) > n
        return {"ids": ids[:n], "is_truncated": more, "cursor": ids[n - 1] if more else None}

    def describe(self) -> dict:
        return {"dimensions": self._meta["dimensions"], "metric": self._meta["metric"], "vectors_count": self.vectors.count(), "processed_up_to_mutation": self._meta["last_mutation"]}

    def create_metadata_index(self, name: str, kind: str) -> None:
        own = self._meta["metadata_indexes"]
        if kind not in ("string", "number", "boolean"):
            raise ValueError("an index is of strings, numbers or booleans")
        if name not in own and len(own) >= MOST_METADATA_INDEXES:
            raise ValueError(f"at most {MOST_METADATA_INDEXES} metadata indexes")
        own[name] = kind
        self._save()

    def delete_metadata_index(self, name: str) -> None:
        self._meta["metadata_indexes"].pop(name, None)
        self._save()

    def list_metadata_indexes(self) -> list[tuple[str, str]]:
        return sorted(self._meta["metadata_indexes"].items())
