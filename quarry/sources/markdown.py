"""Front matter, heading-aware sections and shortcodes of Markdown texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRONT = re.compile(r"\A---\r?\n(.*?)---\r?\n", re.S)
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_LEAD = re.compile(r"[ ]{0,3}(>|[-*+][ ]|\d{1,9}[.)][ ])[ ]?")


def front_matter(text: str) -> tuple[dict, str]:
    """Front matter and the rest; if there is none, or it isn't valid YAML, the text stays whole."""
    import yaml

    found = _FRONT.match(text)
    if not found:
        return {}, text
    try:
        data = yaml.safe_load(found[1])
    except yaml.YAMLError:
        return {}, text
    return (data if isinstance(data, dict) else {}), text[found.end() :]


def headings(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(line, depth, text) of ATX and setext headings, also inside quotes and lists, not inside fenced code."""
    fence, paragraph = "", None
    for n, raw in enumerate(lines):
        line, quoted = raw, False
        while (lead := _LEAD.match(line)) and not _UNDERLINE.match(line):
            line, quoted = line[lead.end() :], True
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                fence = ""
            continue
        if mark:
            fence, paragraph = mark[1], None
        elif atx := _ATX.match(line):
            yield n, len(atx[1]), (atx[2] or "").strip()
            paragraph = None
        elif paragraph is not None and not quoted and (under := _UNDERLINE.match(line)):
            yield paragraph, 1 if under[1][0] == "=" else 2, " ".join(x.strip() for x in lines[paragraph:n])
            paragraph = None
        elif not line.strip():
            paragraph = None
        elif paragraph is None and not line.startswith("    "):
            paragraph = n


def sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, content): what follows each heading's first line; blank sections only shape the paths."""
    lines = text.split("\n")
    marks = sorted(headings(lines))
    path: list[str] = []
    out = []
    ends = [m[0] for m in marks] + [len(lines)]
    if preamble := "\n".join(lines[: ends[0]]).strip():
        out.append(([], preamble))
    for (line, depth, title), end in zip(marks, ends[1:]):
        path = [*path[: depth - 1], *[""] * (depth - 1 - len(path)), title]
        if body := "\n".join(lines[line + 1 : end]).strip():
            out.append(([p for p in path if p], body))
    return out


def shortcodes(text: str, rules: dict[str, dict], substitutions: dict[str, str] | None = None) -> str:
    """Blocks, then single shortcodes, then literal substitutions.

    A rule may skip, keep the inner text, put a replacement before it, or call
    a handler ``(content, args)``; without a rule the inner text stays, and a
    single shortcode goes.
    """
    opening, closing = r"\{\{[%<]\s*", r"\s*[%>]\}\}"

    def block(m: re.Match) -> str:
        rule, inner = rules.get(m["name"]), m["inner"]
        if rule is None:
            return inner
        if rule.get("handler"):
            return rule["handler"](inner, m["args"].strip())
        if rule.get("skip"):
            return ""
        if rule.get("replacement") and not rule.get("extract"):
            return rule["replacement"] + " " + inner
        return inner

    def single(m: re.Match) -> str:
        rule, args = rules.get(m["name"]), m["args"].strip()
        if rule is None:
            return ""
        if rule.get("handler"):
            return rule["handler"]("", args)
        if rule.get("skip"):
            return ""
        if rule.get("replacement"):
            return rule["replacement"]
        quoted = re.search(r'"([^"]*)"', args)
        return quoted[1] if quoted else ""

    text = re.sub(opening + r"(?P<name>\w+)(?P<args>[^%>]*?)" + closing + r"(?P<inner>.*?)" + opening + r"/\s*(?P=name)" + closing, block, text, flags=re.S)
    text = re.sub(opening + r"(?P<name>\w+)(?P<args>[^%>]*?)" + closing, single, text)
    for old, new in (substitutions or {}).items():
        text = text.replace(old, new)
    return text


def parse(files: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """``(path, title, tags, date, draft, section_no, heading_path, content)``, a row per section of files (path, text)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                front, body = front_matter(text or "")
                tags = front.get("tags")
                for n, (heads, content) in enumerate(sections(shortcodes(body, rules or {}) if rules is not None else body)):
                    rows.append((path, str(front.get("title") or path.split("/")[-1].rsplit(".", 1)[0]), [str(t) for t in tags] if isinstance(tags, list) else [], str(front.get("date") or ""), bool(front.get("draft")), n, heads, content))
            yield pd.DataFrame(rows, columns=["path", "title", "tags", "date", "draft", "section_no", "heading_path", "content"])

    schema = "path string, title string, tags array<string>, date string, draft boolean, section_no int, heading_path array<string>, content string"
    return files.select("path", F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
