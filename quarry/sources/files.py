"""Files of a folder, and vectors in lines of JSON."""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("md", "txt", "pdf", "docx", "xml")
#: Folders that are left out, besides those that begin with a dot or end with .assets (fixed values).
SKIPPED = ("node_modules", "dist")
#: Bytes of files that one task reads, about.
TASK = 64 << 20


def _store(folder: str):
    """File system and path of a folder, on the driver or an executor."""
    from pyarrow import fs

    scheme = urlsplit(folder).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + folder.split(":", 1)[-1].lstrip("/") if scheme else folder
    return fs.FileSystem.from_uri(folder)


def find_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content, modified)`` of files of the known kinds below the folder, by relative path.

    Left out are folders that begin with a dot or end with ``.assets``, and
    ``node_modules`` and ``dist``.  Names that begin with ``_`` count as others
    do, which Spark's own readers hide; so the driver lists the names, and tasks
    read the files.  The folder is local (shared by all executors on a cluster)
    or in a store that Arrow opens by its URI.  No folder: no files.
    """
    from pyarrow import fs

    store, root = _store(folder.rstrip("/"))
    root = root.rstrip("/")
    found = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        *folders, name = info.path[len(root) :].strip("/").split("/")
        hidden = any(f.startswith(".") or f.endswith(".assets") or f in SKIPPED for f in folders)
        if info.type == fs.FileType.File and not hidden and "." in name[1:] and name.rpartition(".")[2].lower() in KINDS:
            found.append(("/".join([*folders, name]), info.size, info.mtime))
    tasks = max(1, min(len(found), -(-sum(size for _, size, _ in found) // TASK), 10_000))
    paths = spark.createDataFrame(found, "path string, size bigint, modified timestamp").repartition(max(tasks, min(len(found), 8))).select("path", "modified")

    def read(batches):
        own, top = _store(folder.rstrip("/"))
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                with own.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary()), batch.column("modified").slice(k, 1)], names=["path", "content", "modified"])

    return paths.mapInArrow(read, "path string, content binary, modified timestamp")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors, a JSON object a line; blank lines are skipped, a line that isn't valid fails the read, whose error shows the file and the line's beginning."""
    schema = "id string, values array<float>, namespace string, metadata string, text string, bad string"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    rows = lines.select("value", "file", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("v"))
    shown = F.concat(F.col("file"), F.lit(": malformed line: "), F.substring("value", 1, 200))
    return rows.filter(F.when(F.col("v.bad").isNotNull(), F.raise_error(shown).cast("boolean")).otherwise(True)).select("v.*").drop("bad")
