"""Literal search, listing, reading, links, grep and result lists over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, slugify


def literal_search(chunks: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Chunks that contain the text (ASCII case aside) and how often, overlaps not counted; most first."""
    if not text.strip():
        return chunks.select("chunk_id", F.lit(0).cast("bigint").alias("match_count")).limit(0)
    low, q = ascii_lower(F.col("content")), "".join(c.lower() if c.isascii() else c for c in text)
    n = F.expr("1") if not q else ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("bigint")
    return chunks.filter(F.contains(low, F.lit(q))).select("chunk_id", n.alias("match_count")).orderBy(F.desc("match_count"), "chunk_id").limit(k)


def _like(text: str) -> str:
    return text.replace("\\", "\\\\")


def document_chunks(chunks: DataFrame, wanted: str, order: str = "chunk_id") -> DataFrame:
    """Chunks of the document with this id, or whose url holds it; ``%`` and ``_`` in it are wildcards."""
    bare = wanted.removesuffix(".md").strip("/")
    url = ascii_lower(F.col("url"))
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    hit = (F.col("doc_id") == wanted) | (F.col("url") == wanted) | url.like(f"%{_like(low(wanted))}%") | url.like(f"%{_like(low(bare))}%")
    return chunks.filter(hit).orderBy(order)


def list_documents(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min("url").alias("url"), F.min("title").alias("title"), F.count("*").alias("chunk_count")).orderBy("title", "doc_id")


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunk_count"), F.countDistinct("doc_id").alias("doc_count"))


def related_documents(chunks: DataFrame, path: str, k: int = 5) -> DataFrame:
    """Documents with a Markdown link to the last part of the path."""
    name = path.split("/")[-1].removesuffix(".md") or path
    low = "".join(c.lower() if c.isascii() else c for c in name)
    content = ascii_lower(F.col("content"))
    hit = content.like(f"%](" + _like(low) + "%") | content.like("%](../" + _like(low) + "%")
    return chunks.filter(hit).select("doc_id", "url", "title").distinct().orderBy("title", "doc_id").limit(k)


def lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, line_no, line)``, numbered from 1."""
    return files.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def grep(line_table: DataFrame, pattern: str, files: int = 10, per_file: int = 3) -> DataFrame:
    """Files with matching lines, most first: the first ``10 * files`` lines (by path and number), their number per file, and some of them."""
    first = line_table.filter(F.col("line").rlike("(?i)" + pattern)).orderBy("path", "line_no").limit(10 * files)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    by = first.withColumn("r", rank).groupBy("path").agg(F.count("*").alias("matches"), F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.when(F.col("r") <= per_file, F.struct("line_no", F.substring("line", 1, 200).alias("line"))))).alias("snippets"))
    return by.orderBy(F.desc("matches"), "path").limit(files)


def grep_capped(line_table: DataFrame, pattern: str, per_file: int) -> DataFrame:
    """Matching lines, case-sensitive, at most ``per_file`` of each file."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return line_table.filter(F.col("line").rlike(pattern)).withColumn("rank", rank).filter(F.col("rank") <= per_file).drop("rank")


def citations(results: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Each key once, numbered from 1 in the order of its first appearance."""
    first = results.groupBy(key).agg(F.min(order).alias("first_seq"))
    return first.withColumn("citation", F.row_number().over(Window.orderBy("first_seq", key)).cast("bigint"))


def render(chunks: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """A document's chunks put together again, in the order of their ids."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), separator).alias("content"), F.count("*").alias("chunk_count"))


def reading(chunks: DataFrame) -> DataFrame:
    """``(doc_id, content, contents)``: a document as a page, its chunks in the order of their ids.

    A chunk's headings stand before it from where its path leaves that of the
    chunk before; a path that only gets shorter has none.  ``contents`` has each
    heading once, without markup, and its anchor.
    """
    path = F.coalesce("headings", F.array().cast("array<string>"))
    rows = chunks.select("doc_id", "chunk_id", "content", path.alias("path"))
    prev = F.coalesce(F.lag("path").over(Window.partitionBy("doc_id").orderBy("chunk_id")), F.array().cast("array<string>"))
    rows = rows.withColumn("prev", prev)
    shared = F.least(F.size("path"), F.size("prev"))
    differs = F.array_position(F.zip_with(F.slice("path", F.lit(1), shared), F.slice("prev", F.lit(1), shared), lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
    rows = rows.withColumn("from", F.when(differs > 0, differs - 1).otherwise(F.size("prev")))
    heads = F.filter(F.transform("path", lambda h, i: F.when(i >= F.col("from"), F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h))), lambda h: h.isNotNull())
    blocks = rows.select("doc_id", "chunk_id", "path", F.array_join(F.concat(heads, F.array("content")), "\n\n").alias("block"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "block", "path")))
    pages = blocks.groupBy("doc_id").agg(parts.alias("parts"))
    plain = F.array_distinct(F.transform(F.flatten(F.transform("parts", lambda p: p["path"])), lambda h: F.regexp_replace(h, "<[^>]*>", "")))
    contents = F.transform(plain, lambda h: F.struct(h.alias("title"), slugify(h).alias("anchor")))
    return pages.select("doc_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n").alias("content"), contents.alias("contents"))
