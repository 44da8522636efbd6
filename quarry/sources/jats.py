"""Journal articles in JATS XML: metadata, and the text as Markdown."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_HREF = "{http://www.w3.org/1999/xlink}href"
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)(\w+);")
_CAPTIONED = ("fig", "table-wrap", "boxed-text")
_DEEPEST = 6


def _root(xml: str) -> ET.Element | None:
    """The article element, tags without namespaces; named entities of HTML are known."""
    try:
        tree = ET.fromstring(_ENTITY.sub(lambda m: html.unescape(m[0]), xml.strip()))
    except ET.ParseError:
        return None
    for e in tree.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return tree if tree.tag == "article" else tree.find(".//article")


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _blocks(parent: ET.Element, depth: int) -> Iterator[str]:
    """Blocks of Markdown for what a section, an abstract or a body holds."""
    for e in parent:
        if e.tag == "sec":
            if heading := _text(e.find("title")):
                yield f"{'#' * min(depth, _DEEPEST)} {heading}"
            yield from _blocks(e, depth + 1)
        elif e.tag == "p":
            yield _text(e)
        elif e.tag == "list":
            yield "\n".join(f"- {t}" for t in map(_text, e.findall("list-item")) if t)
        elif e.tag in _CAPTIONED:
            yield _text(e.find("caption"))


def _body(article: ET.Element, title: str) -> Iterator[str]:
    if title:
        yield f"# {title}"
    abstract = article.find("front/article-meta/abstract")
    if abstract is not None:
        yield "## Abstract"
        yield from _blocks(abstract, 3)
    body = article.find("body")
    if body is not None:
        loose = ET.Element("body")
        loose.extend(e for e in body if e.tag in ("sec", "p"))  # of loose blocks only paragraphs count
        yield from _blocks(loose, 2)
    references = article.find("back//ref-list")
    if references is not None:
        listed = [t for t in map(_text, references.findall("ref")) if t]
        if listed:
            yield "## References"
            yield "\n".join(f"{n}. {t}" for n, t in enumerate(listed, 1))


def _date(meta: ET.Element) -> str:
    """Year, month and day of the first publication date with a year, as far as given."""
    for e in meta.findall("pub-date"):
        if year := _text(e.find("year")):
            return "-".join([year, *(t.zfill(2) for t in map(_text, (e.find("month"), e.find("day"))) if t)])
    return ""


def _authors(meta: ET.Element) -> list[str]:
    people = [c for c in meta.findall("contrib-group/contrib") if c.get("contrib-type", "author") in ("author", "")]
    names = [" ".join(filter(None, (_text(c.find("name/given-names")), _text(c.find("name/surname"))))) for c in people]
    return [n for n in names if n]


def parse_jats(xml: str) -> tuple[dict, str]:
    """Metadata and Markdown; both are empty if it isn't XML or holds no article."""
    article = _root(xml)
    if article is None:
        return {}, ""
    empty = ET.Element("none")
    meta, journal = article.find("front/article-meta"), article.find("front/journal-meta")
    meta = empty if meta is None else meta
    ids = {e.get("pub-id-type"): _text(e) for e in meta.findall("article-id")}
    title = _text(meta.find("title-group/article-title"))
    license_ = meta.find("permissions/license")
    front = {
        "source": "jats",
        "title": title,
        "date": _date(meta),
        "journal": "" if journal is None else _text(journal.find(".//journal-title")),
        **{k: ids.get(k, "") for k in ("pmid", "pmcid", "doi")},
        "authors": _authors(meta),
        "license": "" if license_ is None else license_.get(_HREF) or license_.get("license-type") or _text(license_),
    }
    return {k: v for k, v in front.items() if v}, "\n\n".join(b for b in _body(article, title) if b)
