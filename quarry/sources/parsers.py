"""Sections of files of every known kind, in one pass over the files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docx, jats, layout, markdown

SCHEMA = (
    "path string, kind string, title string, tags array<string>, date string, draft boolean, "
    "front map<string,string>, section_no int, heading_path array<string>, content string, error string"
)
#: Files of a task are parsed so many at a time, as a batch of them is held in memory.
FILES_A_BATCH = 16


def _text(x) -> str:
    """Front matter as a string: strings and dates as they stand, all else as JSON."""
    if isinstance(x, str):
        return x
    return x.isoformat() if hasattr(x, "isoformat") else json.dumps(x, default=str, ensure_ascii=False)


def parse_one(path: str, content: bytes, rules: dict | None = None, substitutions: dict | None = None, pdf_lines: Callable[[bytes], Iterable] | None = None) -> tuple[dict, list[tuple[list[str], str]], str | None]:
    """Front matter, sections, and an error if the file can't be read."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        try:
            return {}, markdown.sections(docx.docx_markdown(content)), None
        except ValueError as e:
            return {}, [], str(e)
    if kind == "pdf":
        if pdf_lines is None:
            return {}, [], "no function that reads the lines of a PDF was given"
        return {}, markdown.sections(layout.markdown(pdf_lines(content))), None
    text = content.decode("utf-8", "replace")
    if kind == "xml":
        front, body = jats.parse_jats(text)
        return front, markdown.sections(body), None
    if kind == "txt":
        return {}, [([], text.strip())] if text.strip() else [], None
    front, body = markdown.front_matter(text)
    return front, markdown.sections(markdown.shortcodes(body, rules or {}, substitutions)), None


def parse_files(files: DataFrame, rules: dict | None = None, substitutions: dict | None = None, pdf_lines: Callable[[bytes], Iterable] | None = None) -> DataFrame:
    """A row per section of ``files`` (path, content); a file without sections has one row without content.

    Files that can't be read carry ``error``.  ``draft`` is set by Markdown alone.
    """
    import pandas as pd

    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def rows(path: str, content: bytes):
        front, sections, error = parse_one(path, content or b"", rules, substitutions, pdf_lines)
        kind, tags = path.rsplit(".", 1)[-1].lower(), front.get("tags")
        name = path.split("/")[-1].rsplit(".", 1)[0]
        head = (
            path, kind, _text(front.get("title") or name), [_text(t) for t in tags] if isinstance(tags, list) else [], _text(front.get("date") or ""),
            kind == "md" and bool(front.get("draft")), {str(k): _text(v) for k, v in front.items() if v is not None},
        )
        for n, (headings, text) in enumerate(sections or [([], None)]):
            yield (*head, n, headings, text, error)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), FILES_A_BATCH):
                part = pdf.iloc[at : at + FILES_A_BATCH]
                yield pd.DataFrame([r for p, c in zip(part["path"], part["content"]) for r in rows(p, c)], columns=columns)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, SCHEMA)


def included(front: Column, filters: list[dict] | None, active: dict[str, str] | None = None) -> Column:
    """Whether a document passes the filters on its front matter.

    A filter has a ``field`` and perhaps ``default``, ``include`` and
    ``exclude``.  With ``include``, an active value other than ``all`` must
    equal the document's; values in ``exclude`` never pass.
    """
    keep = F.lit(True)
    for f in filters or []:
        value = F.coalesce(front[f["field"]], F.lit(f.get("default")).cast("string"))
        wanted = (active or {}).get(f["field"])
        if f.get("include") and wanted and wanted != "all":
            keep = keep & F.coalesce(value == wanted, F.lit(False))
        if f.get("exclude"):
            keep = keep & ~F.coalesce(value.isin(f["exclude"]), F.lit(False))
    return keep
