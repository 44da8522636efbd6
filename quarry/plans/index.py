"""A document index in a folder: built, brought up to date, and opened.

Every build writes its tables under a new version and its manifest last, so a
build that stops half-way leaves the version before it in force, and readers of
that one aren't disturbed.  All of it is read and written by Spark, so the
folder may be in any store.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext
from ..operators.chunking import chunk_sections
from ..sources.files import find_files
from ..sources.parsers import included, parse_files
from . import build as plans
from . import config as C

TABLES = ("chunks", "tracking", "postings", "lines")
COLUMNS = ("chunk_id", "doc_id", "path", "url", "title", "section", "tags", "date", "headings", "idx", "content", "token_count", "content_hash", "embedding")
DIMENSION = 64


class Index:
    """The tables of the version in force."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder, manifest

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self.manifest['version']}")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def has_lines(self) -> bool:
        return bool(self.manifest.get("content_copy"))

    def statistics(self) -> DataFrame:
        return self.spark.createDataFrame([(self.manifest["statistics"]["n_docs"], self.manifest["statistics"]["avg_len"])], "n_docs bigint, avg_len double")


def _read(reader, path: str):
    """What the reader finds under the path, or None if nothing is there."""
    try:
        return reader(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def opened(spark: SparkSession, folder: str) -> Index | None:
    """The index in the folder, or None if no build has been completed there."""
    found = _read(spark.read.text, f"{folder}/manifest/*")
    manifests = [json.loads(r.value) for r in found.collect()] if found is not None else []  # a line a build
    return Index(spark, folder, max(manifests, key=lambda m: m["version"])) if manifests else None


def state(spark: SparkSession, folder: str) -> str:
    """``complete`` if there is an index, ``partial`` if a first build stopped half-way (its vectors are used again), else ``none``."""
    if opened(spark, folder):
        return "complete"
    return "none" if _read(spark.read.parquet, f"{folder}/tracking/v*") is None else "partial"


CACHE = "model string, content_hash string, embedding array<float>"


def _cached(spark: SparkSession, folder: str, model: str, dimension: int) -> DataFrame:
    """The vectors kept for a model, over all builds and versions."""
    found = _read(spark.read.schema(CACHE).parquet, f"{folder}/cache/{C.model_folder(model)}-{dimension}/*")
    return spark.createDataFrame([], CACHE) if found is None else found.filter(F.col("model") == model)


def _embedded(chunks: DataFrame, folder: str, embed: Callable[[Column], Column], model: str, dimension: int, report: Callable[[str], None]) -> DataFrame:
    """Chunks with their vectors.

    Texts that the model's cache lacks are embedded, each once, and added to it
    before anything else is written; so neither a build that stops later, nor a
    clean one, nor a turn to another model and back embeds a text again.
    """
    spark, began = chunks.sparkSession, time.monotonic()
    missing = plans.cache_misses(chunks, _cached(spark, folder, model, dimension), model)
    new = missing.select(F.lit(model).alias("model"), "content_hash", embed(F.col("content")).cast("array<float>").alias("embedding"))
    path = f"{folder}/cache/{C.model_folder(model)}-{dimension}/{uuid.uuid4().hex}"
    new.write.parquet(path)
    n, seconds = spark.read.schema(CACHE).parquet(path).count(), time.monotonic() - began
    report(f"{n} texts embedded in {seconds:.0f} s, {n / max(seconds, 1e-3):.1f} a second")
    known = _cached(spark, folder, model, dimension).groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
    return chunks.join(known, "content_hash")


def _chunks(sections: DataFrame, changed: DataFrame, config: dict) -> DataFrame:
    """Chunks of the sections, with ids and document columns."""
    keys = ["path"]
    parts = chunk_sections(sections.filter("content IS NOT NULL"), keys, most=config["chunking"]["maxTokens"], overlap=config["chunking"]["overlap"])
    heads = sections.select("path", "section_no", "title", "tags", "date", F.col("heading_path").alias("headings"))
    rows = parts.join(heads, ["path", "section_no"]).join(changed.select("path", F.col("content_hash").alias("file_hash")), "path")
    root = (config.get("content") or {}).get("urlRoot", "")
    doc = T.doc_id(F.col("path"), F.col("file_hash"))
    return rows.select(
        T.chunk_id(doc, F.col("headings"), F.col("idx"), F.col("content_hash")).alias("chunk_id"), doc.alias("doc_id"), "path", T.url(F.col("path"), root).alias("url"),
        "title", T.section(F.col("path"), root).alias("section"), "tags", "date", "headings", "idx", "content", "token_count", "content_hash",
    )


def build(
    spark: SparkSession, content: str, folder: str, config: dict | None = None, embed: Callable[[Column], Column] | None = None, model: str = "mock", dimension: int = DIMENSION,
    active: dict[str, str] | None = None, drafts: bool = False, clean: bool = False, content_copy: bool = False, pdf_lines=None,
    report: Callable[[str], None] = lambda line: None,
) -> Index:
    """The index of the files in ``content``; only files that are new or changed are parsed and embedded again.

    ``embed`` maps the Column of texts to that of vectors (by default the
    deterministic test vectors).  Vectors are kept by model and hash of the
    text, over all builds; equal texts are embedded once.  Documents that have become drafts,
    empty or filtered lose their chunks.  With another model the build begins
    anew; other options hold for the files parsed now, so change them with ``clean``.
    ``report`` gets a line for each step that is done.
    """
    config = C.merge(config or {})
    embed = embed or (lambda c: T.mock_embedding(c, dimension))
    before = None if clean else opened(spark, folder)
    if before and before.manifest["embedding"] != {"model_id": model, "dimension": dimension, "provider": C.provider(model)}:
        before = None
    last = opened(spark, folder)
    version = last.manifest["version"] + 1 if last else 1
    where = {name: f"{folder}/{name}/v{version}" for name in TABLES}

    found = find_files(spark, content).withColumn("content_hash", T.content_hash(F.col("content")))
    found.select("path", "content_hash", "modified").write.mode("overwrite").parquet(where["tracking"])
    tracking = spark.read.parquet(where["tracking"])
    if before:
        changes = plans.diff(before.table("tracking"), tracking)
        changed = tracking.join(changes.filter("change IN ('new', 'changed')"), "path", "left_semi")
        kept = before.chunks.join(changes.filter("change <> 'unchanged'"), "path", "left_anti")
        report(", ".join(f"{r['count']} {r.change}" for r in changes.groupBy("change").count().orderBy("change").collect()) or "no files")
    else:
        changed, kept = tracking, None
        report(f"{tracking.count()} files, all new")

    files = find_files(spark, content).join(changed, "path", "left_semi")
    parsed = parse_files(files, C.rules(config), config.get("substitutions"), pdf_lines)
    keep = included(F.col("front"), config.get("filters"), active)
    staged = f"{folder}/staged/v{version}"
    parsed.filter(keep if drafts else keep & ~F.col("draft")).write.mode("overwrite").parquet(f"{staged}/sections")
    _chunks(spark.read.parquet(f"{staged}/sections"), changed, config).write.mode("overwrite").parquet(f"{staged}/chunks")

    new = _embedded(spark.read.parquet(f"{staged}/chunks"), folder, embed, model, dimension, report)
    (new if kept is None else kept.unionByName(new)).select(*COLUMNS).write.mode("overwrite").parquet(where["chunks"])

    chunks = spark.read.parquet(where["chunks"])
    index = fulltext.indexed(chunks)
    fulltext.postings(index).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(where["postings"])
    if content_copy:
        text = find_files(spark, content).filter(F.lower("path").endswith(".md")).select("path", F.col("content").cast("string").alias("text"))
        from ..operators.documents import lines

        lines(text).write.mode("overwrite").parquet(where["lines"])
    n = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs")).first()
    s = fulltext.statistics(index).first()
    manifest = C.manifest(config, model, dimension, n.docs, n.chunks, active, content_copy, version)
    report(f"{n.docs} documents with {n.chunks} chunks")
    manifest["statistics"] = {"n_docs": s.n_docs, "avg_len": s.avg_len or 0.0}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest/v{version}")
    return Index(spark, folder, manifest)
