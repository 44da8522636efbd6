"""Markdown from the printed lines of a document: text, font height, vertical place.

Getting the lines out of a PDF file takes a library that isn't part of this
package; ``parsers.parse_files`` takes a function for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import groupby
from typing import NamedTuple

HEADING, LARGE, GAP = 1.4, 2.0, 2.5
SHORT, PAGE_NUMBER = 40, 6

_PAGE = re.compile(r"[0-9\s–—-]+")
_BULLETS = "•·▪▸○◦▷»"
_BULLET = re.compile(rf"\s*[{_BULLETS}]\s*")
_SPLIT_WORD = re.compile(r"\b([B-HJ-Z]) ([A-Z]{3,})\b", re.A)
_LIGATURE = re.compile(r"\s+(?:ﬁ|fi|fl)\s+")


class Line(NamedTuple):
    text: str
    height: int
    y: float


def _heading(text: str) -> str:
    """Words that a column break split are joined; a lone ligature stands for a dash."""
    return _LIGATURE.sub(" – ", _SPLIT_WORD.sub(r"\1\2", text.strip()))


class _Body:
    """Lines of running text: pairs of (is a list item, text)."""

    def __init__(self):
        self.parts: list[tuple[bool, str]] = []
        self.item_next = False

    def add(self, text: str) -> None:
        text = text.strip()
        if text and not text.strip(_BULLETS):
            self.item_next = True
        elif self.item_next:
            self.item_next = False
            self.parts.append((True, text))
        elif _BULLET.search(text):
            first, *items = _BULLET.split(text)
            self.parts += [(False, first.strip())] if first.strip() else []
            self.parts += [(True, t.strip()) for t in items if t.strip()]
        elif self.parts and self.parts[-1][0] and re.match(r"[a-z(]", text):
            self.parts[-1] = (True, f"{self.parts[-1][1]} {text}")
        else:
            self.parts.append((False, text))

    def take(self) -> list[str]:
        """What was gathered, as lines of Markdown, an empty one behind each list."""
        out = []
        for is_item, run in groupby(self.parts, key=lambda p: p[0]):
            texts = [t for _, t in run]
            out += [*(f"- {t}" for t in texts), ""] if is_item else [" ".join(texts)]
        self.__init__()
        return out


def markdown(lines: Iterable[Line]) -> str:
    """Headings are lines well above the commonest height: much larger ones, or larger ones in capitals or short.

    Their depth is the rank of their height, 3 at most; neighbours of one depth
    are one heading unless a sentence ends between them.  A wide gap ends a
    paragraph; page numbers go.
    """
    lines = [Line(*x) for x in lines]
    if not lines:
        return ""
    size = Counter(x.height for x in lines).most_common(1)[0][0]
    rank = {h: n for n, h in enumerate(sorted({x.height for x in lines if x.height > HEADING * size}, reverse=True), 1)}

    def depth(line: Line) -> int:
        if line.height not in rank:
            return 0
        letters = re.sub("[^a-zA-Z]", "", line.text)
        if line.height > LARGE * size or (letters and letters.isupper()) or len(line.text.strip()) <= SHORT:
            return min(rank[line.height], 3)
        return 0

    out: list[str] = []
    body, open_heading = _Body(), None  # the heading that may go on: (depth, text)

    def close_heading():
        nonlocal open_heading
        if open_heading:
            out.extend([f"{'#' * open_heading[0]} {open_heading[1].strip()}", ""])
            open_heading = None

    last_y = lines[0].y
    for line in lines:
        if len(line.text) <= PAGE_NUMBER and _PAGE.fullmatch(line.text):
            continue
        gap = abs(line.y - last_y) > GAP * size
        if d := depth(line):
            if open_heading and open_heading[0] == d and not re.search(r"[.!?:]\s*$", open_heading[1]):
                open_heading = (d, _heading(f"{open_heading[1]} {line.text}"))
            else:
                close_heading()
                out.extend(body.take())
                out.extend([""] if gap and out else [])
                open_heading = (d, _heading(line.text))
        else:
            close_heading()
            if gap and body.parts:
                out.extend([*body.take(), ""])
            body.add(line.text)
        last_y = line.y
    close_heading()
    out.extend(body.take())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
