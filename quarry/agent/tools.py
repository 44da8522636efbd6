"""The named tools of an index: arguments are checked, results are text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..functions import text as T
from ..operators import fulltext, hybrid, vectors
from ..plans.index import Index

NOTHING = "No results found."


@dataclass(frozen=True)
class Argument:
    """Integers have bounds; an argument without a default must be given."""

    kind: type
    default: object = None
    low: int | None = None
    high: int | None = None

    def check(self, name: str, value):
        if value is None:
            if self.default is None:
                raise ValueError(f"{name} is missing")
            return self.default
        if not isinstance(value, self.kind) or (self.kind is int and isinstance(value, bool)):
            raise ValueError(f"{name} must be of type {self.kind.__name__}")
        if self.low is not None and not self.low <= value <= self.high:
            raise ValueError(f"{name} must be from {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class Result:
    text: str
    is_error: bool = False
    chunks: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    arguments: dict[str, Argument]
    run: Callable[..., Result]

    def __call__(self, **given) -> Result:
        try:
            if unknown := set(given) - set(self.arguments):
                raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
            return self.run(**{n: a.check(n, given.get(n)) for n, a in self.arguments.items()})
        except ValueError as e:
            return Result(f"{self.name}: {e}", True)


class Searches:
    """The retrieval operators over one index; each returns a handful of rows."""

    def __init__(self, index: Index, embed: Callable[[str], list[float]] | None = None):
        self.index, self.embed = index, embed

    def _full(self, ranked: DataFrame, order: Callable[[DataFrame], list]) -> list[dict]:
        """Ranked rows (few, by their limit) with their chunks."""
        rows = self.index.chunks.drop("embedding").join(F.broadcast(ranked), "chunk_id")
        return [r.asDict() for r in rows.orderBy(*order(rows)).collect()]

    def _text(self, query: str, k: int) -> DataFrame:
        return fulltext.search(self.index.table("postings"), self.index.statistics(), query, k)

    def full_text(self, query: str, k: int = 10) -> list[dict]:
        ranked = self._badged(self._text(query, k).select("chunk_id", (-F.col("bm25")).alias("score")), "fts")
        return self._full(ranked, lambda r: [F.desc("score"), "chunk_id"])

    def literal(self, query: str, k: int = 10) -> list[dict]:
        ranked = D.literal_search(self.index.chunks, query, k).withColumn("score", F.col("match_count").cast("double"))
        ranked = self._badged(ranked, "literal")
        return self._full(ranked, lambda r: [F.desc("score"), "chunk_id"])

    def vector(self, query: str, k: int = 10) -> list[dict]:
        near = vectors.nearest(self.index.chunks, self._vector(query), k, id_col="chunk_id", vector_col="embedding")
        return self._full(near.select("chunk_id", "distance", (1 - F.col("distance")).alias("score")), lambda r: ["distance", "chunk_id"])

    def hybrid(self, query: str, k: int = 10) -> list[dict]:
        near = vectors.nearest(self.index.chunks.select("chunk_id", "content", "embedding"), self._vector(query), 3 * k, id_col="chunk_id", vector_col="embedding")
        fused = hybrid.fuse(near.select("chunk_id", "content", "distance"), self._text(query, 2 * k), k)
        fused = fused.withColumn("badge", T.method_badge("hybrid", F.col("score"), F.col("f_rank"), F.col("v_rank")))
        return self._full(fused, lambda r: [F.desc("score"), F.asc_nulls_last("v_rank"), "f_rank"])

    @staticmethod
    def _badged(ranked: DataFrame, method: str) -> DataFrame:
        """A handful of ranked rows with how they were found."""
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
        return ranked.withColumn("badge", T.method_badge(method, F.col("score"), rank))

    def _vector(self, query: str) -> list[float]:
        if self.embed is None:
            raise ValueError("there is no embedder")
        return self.embed(query)


def query_index(index: Index, embed: Callable[[str], list[float]], query: str, k: int = 10) -> list[dict]:
    """The k best chunks of the hybrid search, their contents cut to 200 characters."""
    keep = ("chunk_id", "doc_id", "url", "title", "headings", "content", "score", "v_rank", "f_rank")
    rows = Searches(index, embed).hybrid(query, k)
    return [{n: r[n] for n in keep} | {"content": r["content"][:200] + "..." * (len(r["content"]) > 200)} for r in rows]


def joined_url(base: str | None, url: str | None) -> str:
    return f"{base}{url.removeprefix('/')}" if base and url else url or ""


def format_chunks(rows: list[dict], base: str | None = None) -> str:
    """Results as text, numbered from 1; lines that would be blank are left out."""
    out = []
    for n, r in enumerate(rows, 1):
        score = "" if r.get("score") is None else f" (score: {r['score']:.4f})"
        section = " > ".join(r.get("headings") or [])
        lines = [f"--- Result {n}{score} ---", f"Title: {r.get('title') or 'Untitled'}", section and f"Section: {section}", f"URL: {joined_url(base, r.get('url'))}", f"Doc ID: {r['doc_id']}", r.get("content")]
        out.append("\n".join(x for x in lines if x))
    return "\n\n".join(out) or NOTHING


def registry(index: Index, embed: Callable[[str], list[float]] | None = None, rebuild: Callable[..., str] | None = None) -> dict[str, Tool]:
    """Tools by name.

    Without ``embed`` there is no hybrid search, without copied lines no grep,
    and without ``rebuild(clean, root, copy_content)`` no building.
    """
    searches, base = Searches(index, embed), index.manifest.get("base_url")

    def found(search):
        def run(query: str, k: int) -> Result:
            rows = search(query, k)
            return Result(format_chunks(rows, base), chunks=rows)

        return run

    def read_document(doc_id: str) -> Result:
        rows = [r.asDict() for r in D.document_chunks(index.chunks.drop("embedding"), doc_id).collect()]
        if not rows:
            return Result(f"No document found matching: {doc_id}", True)
        head = f"# {rows[0]['title']}\nURL: {joined_url(base, rows[0]['url'])}\nChunks: {len(rows)}\n\n"
        return Result(head + "\n\n---\n\n".join(r["content"] for r in rows), chunks=rows)

    def find_related(path: str, limit: int) -> Result:
        rows = D.related_documents(index.chunks, path, limit).collect()
        text = "\n".join(f"{n}. {r.title}\n   URL: {joined_url(base, r.url)}\n   Doc ID: {r.doc_id}" for n, r in enumerate(rows, 1))
        return Result(text or f"No documents found linking to: {path}")

    def list_documents() -> Result:
        rows = D.list_documents(index.chunks).collect()
        return Result(f"{len(rows)} documents indexed:\n\n" + "\n".join(f"{r.title} ({r.chunk_count} chunks)\n  URL: {joined_url(base, r.url)}" for r in rows))

    def search_grep(pattern: str, max_results: int) -> Result:
        rows = D.grep_capped(index.table("lines"), pattern, max_results).orderBy("path", "line_no").collect()
        return Result("\n".join(f"{r.path}:{r.line_no}:{r.line}" for r in rows) or "No grep matches found.")

    k, query = Argument(int, 10, 1, 50), Argument(str)
    search = {"query": query, "k": k}
    tools = [
        Tool("search_fts", "Chunks by full text; best for one to four key words.", search, found(searches.full_text)),
        Tool("search_literal", "Chunks that contain an exact string; best for codes and special characters.", search, found(searches.literal)),
        Tool("read_document", "All chunks of a document, by its id or url.", {"doc_id": Argument(str)}, read_document),
        Tool("find_related", "Documents that link to a document.", {"path": Argument(str), "limit": Argument(int, 5, 1, 20)}, find_related),
        Tool("list_documents", "All documents with their urls and numbers of chunks.", {}, list_documents),
    ]
    if embed:
        tools.insert(0, Tool("search_hybrid", "Chunks by vectors and full text together; best for questions.", search, found(searches.hybrid)))
    if index.has_lines:
        tools.append(Tool("search_grep", "Lines of the files that match a regular expression.", {"pattern": Argument(str), "max_results": Argument(int, 20, 1, 50)}, search_grep))
    if rebuild:
        options = {"root": Argument(str, ""), "copy_content": Argument(bool, False)}
        for name, clean, text in (("build_index", False, "Take in files that are new or changed."), ("rebuild_index", True, "Build the index anew.")):
            tools.append(Tool(name, text, options, lambda root, copy_content, clean=clean: Result(rebuild(clean=clean, root=root or None, copy_content=copy_content))))
    return {t.name: t for t in tools}
