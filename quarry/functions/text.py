"""Scalar functions on texts, paths and ids, all as built-in Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folds() -> tuple[str, str]:
    """Latin letters with one accent and the letters they fold to, by their canonical decomposition; then accents on their own, which go."""
    parts = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in parts if len(b) == 2 and b[0].isascii() and b[0].isalpha()]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


FOLDED, FOLDS_TO = _folds()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def folded(c: Column) -> Column:
    """Lower case without Latin diacritics; null is empty.  Texts of ASCII alone have none and aren't translated."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(F.when(F.octet_length(c) > F.length(c), F.translate(c, FOLDED, FOLDS_TO)).otherwise(c))


def terms(c: Column) -> Column:
    """Runs of letters and digits, case-folded, without Latin diacritics."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """ceil(1.3 * words), words being what white space separates."""
    return F.ceil(F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")) * F.lit(1.3)).cast("bigint")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), _strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Runs up to closing punctuation or a line's end, or up to the end of the text."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?\n]+|[^.!?\n]+$"), F.lit(0)), _strip), lambda x: x != "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


strip = _strip


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def doc_id(path: Column, hash_: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8), F.lit("_"), F.substring(hash_, 1, 8))


def chunk_id(doc: Column, headings: Column, index: Column, hash_: Column) -> Column:
    own = F.substring(F.regexp_replace(doc, "^doc_", ""), 1, 8)
    path = F.substring(F.sha2(F.array_join(headings, "||").cast("binary"), 256), 1, 4)
    return F.concat_ws("_", F.lit("chk"), own, path, index.cast("string"), F.substring(hash_, 1, 6))


def url(path: Column, root: str = "") -> Column:
    """A page's url: no root, no extension of md, txt, pdf or docx, no trailing ``/_index``, slashes at both ends."""
    out = path if not root else F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    out = F.regexp_replace(out, r"(?i)\.(md|txt|pdf|docx)$", "")
    out = F.regexp_replace(out, r"/_index$", "")
    out = F.when(F.startswith(out, F.lit("/")), out).otherwise(F.concat(F.lit("/"), out))
    return F.when(F.endswith(out, F.lit("/")), out).otherwise(F.concat(out, F.lit("/")))


def section(path: Column, root: str = "") -> Column:
    """The first directory below the root, or an empty string."""
    out = path if not root else F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")
    parts = F.split(out, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")


def slugify(c: Column) -> Column:
    out = F.regexp_replace(_strip(F.lower(c)), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def sanitize_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)


def snippet(c: Column, size: int = 200) -> Column:
    return F.concat(F.substring(c, 1, size), F.when(F.length(c) > size, "...").otherwise(""))


def snippet_line(c: Column, size: int = 200) -> Column:
    """``snippet`` on one line: runs of line ends become spaces before the cut."""
    return F.concat(F.substring(F.regexp_replace(c, "\n+", " "), 1, size), F.when(F.length(c) > size, "...").otherwise(""))


def snippet_around(c: Column, query: str, size: int = 200, before: int = 50) -> Column:
    """A snippet that begins ``before`` characters ahead of the query's first ten letters and digits, if they stand further in."""
    needle = "".join(x for x in query.lower() if x.isascii() and x.isalnum())[:10]
    flat = lambda x: _strip(F.regexp_replace(x, "\n+", " "))
    head = _strip(F.substring(F.regexp_replace(c, "\n+", " "), 1, size))
    at = F.instr(F.lower(c), needle) - 1 if needle else F.lit(0)
    own = F.when(at > before, F.concat(F.lit("..."), flat(F.substr(c, at - before + 1, F.lit(size))))).otherwise(head)
    return F.concat(own, F.when(F.length(c) > size, "...").otherwise(""))


def method_badge(method: str, score: Column, f_rank: Column, v_rank: Column | None = None) -> Column:
    """How a result was found, as ``HYB[V1/F2] (0.0123)``, ``FTS[F1] (3.2000)`` or ``LIT[#1] (2.0000)``."""
    rank = lambda letter, c: F.coalesce(F.concat(F.lit(letter), c.cast("string")), F.lit("-"))
    own = {
        "hybrid": lambda: F.concat(F.lit("HYB["), rank("V", F.lit(None).cast("int") if v_rank is None else v_rank), F.lit("/"), rank("F", f_rank), F.lit("]")),
        "fts": lambda: F.concat(F.lit("FTS["), rank("F", f_rank), F.lit("]")),
        "literal": lambda: F.concat(F.lit("LIT["), rank("#", f_rank), F.lit("]")),
    }[method]()
    return F.format_string("%s (%.4f)", own, score)


def heading_url(url_: Column, headings: Column, base: str = "") -> Column:
    """A page's url behind the base, with the slug of the last heading as its anchor if there is one."""
    whole = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(url_, "^/", "")) if base else url_
    anchor = slugify(F.coalesce(F.get(headings, F.size(headings) - 1), F.lit("")))
    return F.concat(whole, F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise(""))


def cited(c: Column, references: int = 0) -> Column:
    """An answer without a list of references of its own at its end, its ``[n]`` as links, and ``(n)`` too where there is such a reference."""
    link = '<a href="#ref-$1" class="citation-link">[$1]</a>'
    out = _strip(F.regexp_replace(c, r"(?is)\n+(references:?|#{2,3} references).*$", ""))
    out = F.regexp_replace(out, r"\[(\d+)\](?!\()", link)
    if references:
        out = F.regexp_replace(out, r"\(0*(" + "|".join(map(str, range(1, references + 1))) + r")\)", link)
    return out


def java_hash(c: Column) -> Column:
    """31 h + c over UTF-16 units, wrapped to 32 bits: an INT value as BIGINT."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    codes = F.transform(units, lambda x: F.conv(x, 16, 10).cast("bigint"))
    span, half = 1 << 32, 1 << 31
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + x + half, F.lit(span)) - half)


def mock_embedding(c: Column, dim: int) -> Column:
    """The deterministic test vector of a text: normalised 0.5 sin(hash + j) + 0.5."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a lambda's variable is worked out once
    raw = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.sin((h + j).cast("double")) * 0.5 + 0.5)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return once(once(java_hash(c), raw), lambda v: F.zip_with(v, F.array_repeat(norm(v), dim), lambda x, n: x / n))
