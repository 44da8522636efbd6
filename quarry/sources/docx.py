"""Word documents as Markdown, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SPECIAL = re.compile(r"([\\`*_{}\[\]()#+\-.!])")


def _heading_styles(styles: bytes | None) -> dict[str, int]:
    """Depth by style id, of the styles named ``heading N``."""
    if styles is None:
        return {}
    out = {}
    for style in ET.fromstring(styles).iter(f"{_W}style"):
        name = style.find(f"{_W}name")
        found = re.fullmatch(r"heading ([1-6])", (name.get(f"{_W}val") or "").lower()) if name is not None else None
        if found:
            out[style.get(f"{_W}styleId")] = int(found[1])
    return out


def _run(run: ET.Element) -> str:
    text = "".join({f"{_W}tab": "\t", f"{_W}br": "\n"}.get(e.tag, e.text or "") for e in run if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    text = _SPECIAL.sub(r"\\\1", text)
    for tag, mark in (("i", "*"), ("b", "__")):
        e = run.find(f"{_W}rPr/{_W}{tag}")
        if text.strip() and e is not None and e.get(f"{_W}val", "1") not in ("0", "false"):
            text = mark + text + mark
    return text


def _paragraphs(body: ET.Element, headings: dict[str, int]) -> Iterator[str]:
    for p in body.iter(f"{_W}p"):  # in order, those of tables too
        text = "".join(_run(r) for r in p.iter(f"{_W}r"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        depth = headings.get(style.get(f"{_W}val")) if style is not None else None
        level = p.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
        if not text.strip():
            continue
        if depth:
            yield f"{'#' * depth} {text.strip()}"
        elif p.find(f"{_W}pPr/{_W}numPr") is not None:
            yield "    " * int(level.get(f"{_W}val") if level is not None else 0) + f"- {text}"
        else:
            yield text


def docx_markdown(content: bytes) -> str:
    """Headings, paragraphs, list items and the text of tables; raises ValueError if it isn't a Word document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            styles = z.read("word/styles.xml") if "word/styles.xml" in names else None
            document = ET.fromstring(z.read("word/document.xml"))
        return "\n\n".join(_paragraphs(document, _heading_styles(styles)))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"not a Word document: {e}") from e
