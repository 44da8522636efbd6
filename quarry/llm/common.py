"""Shared folder, written tables and Arrow helpers of the operators in this package."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast; beyond it the join shuffles.
BROADCAST = 32 << 20
#: Paths in the shared folder that this driver made and has not deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a run inside one process gets a temporary one that goes
    with it; on a cluster that is an error, since executors share no other folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", named)
    return named if "://" in named or named.startswith("file:") else "file://" + named


def unique() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = posixpath.join(shared_dir(spark), f"{name}-{unique()}")
    _made.append(path)
    return path


@contextmanager
def scratch_deleted(spark: SparkSession):
    """Deletes at its end what was put into the shared folder meanwhile; nothing lazy may still read it then."""
    begun = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in begun]:
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def hinted(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``df`` to be broadcast if its rows take at most ``limit`` bytes, counted here; best on a written table."""
    sized = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes]
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        raise TypeError("the size of nested columns is not known")
    size = df.agg(F.sum(sum(sized, F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    remove(df.sparkSession, df.written_path)


def remove(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """File system and path of a URI, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class TaskFile:
    """A binary file in the shared folder that appears under its name only once it is whole."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext

        task = TaskContext.get()
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.uri, self.path = posixpath.join(folder, name), posixpath.join(root, name)
        self.temporary = posixpath.join(root, f".{name}.{task.taskAttemptId()}.tmp")
        self.out, self.size = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches, column: int = 1, limit: int = 8 << 20):
    """Record batches cut so that a block's texts take about ``limit`` bytes (one longer text makes a block)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def merge_blocks(batches, column: int = 1, limit: int = 8 << 20):
    """``blocks``, with small batches put together first."""
    held, size = [], 0
    for block in blocks(batches, column, limit):
        held.append(block)
        size += block.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
