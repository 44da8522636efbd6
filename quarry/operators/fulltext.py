"""Full-text search: a small query language, positional postings and BM25.

Query words are joined by AND unless upper-case AND, OR or NOT stand between
them; words side by side bind tightest, then NOT, AND, OR.  A word that falls
into several terms is a phrase, as is ``a + b``.  Any other punctuation makes
the query invalid, and an invalid query has no result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOLDED, FOLDS_TO, folded, terms

COLUMNS = ("chunk_id", "title", "section", "content", "tags")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Characters that are blanked before a query is parsed.
BLANKED = "'\"*()^:-"
_FOLD = str.maketrans(FOLDED[: len(FOLDS_TO)], FOLDS_TO, FOLDED[len(FOLDS_TO) :])


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    """``phrases``: each a tuple of terms, repeats kept; ``tree``: nested (operator, left, right) over phrase numbers."""

    phrases: tuple[tuple[str, ...], ...]
    tree: object


def parse_query(text: str) -> Query | None:
    """None if nothing is asked for; QueryError if the query isn't valid."""
    for c in BLANKED:
        text = text.replace(c, " ")
    words = text.split()
    if not words:
        return None
    tokens: list[str] = []
    for w in words:
        tokens += [t for t in re.split(r"(\+)", w) if t]
    phrases: list[tuple[str, ...]] = []
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def word() -> tuple[str, ...]:
        nonlocal at
        t = peek()
        if t is None or t in ("AND", "OR", "NOT", "+") or re.search(r"[\x00-\x7f]", re.sub(r"[A-Za-z0-9_\x1a]", "", t)):
            raise QueryError(f"unexpected {t!r}")
        at += 1
        return tuple(re.findall(r"[^\W_]+", t.translate(_FOLD).lower()))

    def sequence():
        nonlocal at
        out = None
        while out is None or peek() not in (None, "AND", "OR", "NOT"):
            phrase = word()
            while peek() == "+":
                at += 1
                phrase += word()
            if phrase:
                phrases.append(phrase)
                leaf = len(phrases) - 1
                out = leaf if out is None else ("AND", out, leaf)
            elif peek() in (None, "AND", "OR", "NOT") and out is None:
                return None
        return out

    def chain(operator: str, below):
        nonlocal at
        out = below()
        while peek() == operator:
            at += 1
            out = (operator, out, below())
        return out

    tree = chain("OR", lambda: chain("AND", lambda: chain("NOT", sequence)))
    if at < len(tokens):
        raise QueryError(f"unexpected {tokens[at]!r}")
    return Query(tuple(phrases), tree) if phrases else None


def indexed(chunks: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``(chunk_id, tokens, doc_len)``; an empty token stands between columns, so that no phrase crosses them."""
    kinds = dict(chunks.dtypes)
    parts = [terms(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")) for c in columns]
    gap = F.array(F.lit(""))
    tokens = reduce(lambda a, b: F.concat(a, gap, b), parts)
    return chunks.select("chunk_id", tokens.alias("tokens")).withColumn("doc_len", _doc_len(columns))


def _doc_len(columns: tuple[str, ...]) -> Column:
    return (F.size("tokens") - (len(columns) - 1)).cast("bigint").alias("doc_len")


def postings(index: DataFrame) -> DataFrame:
    """``(term, chunk_id, pos, doc_len)``; written sorted by term it is an inverted index that searches read in part."""
    return index.select("chunk_id", "doc_len", F.posexplode("tokens").alias("pos", "term")).filter("term <> ''")


def statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def _holds(tree, tf: list[Column]) -> Column:
    if tree is None:
        return F.lit(False)
    if isinstance(tree, int):
        return tf[tree] > 0
    operator, left, right = tree
    a, b = _holds(left, tf), _holds(right, tf)
    return a & b if operator == "AND" else a | b if operator == "OR" else a & ~b


def _may_hold(tree, phrases: tuple[tuple[str, ...], ...], plain: Column) -> Column:
    """False only for folded texts that can't match: words of theirs that must stand in a match don't."""
    if tree is None:
        return F.lit(False)
    if isinstance(tree, int):
        return reduce(lambda a, b: a & b, [F.contains(plain, F.lit(t)) for t in dict.fromkeys(phrases[tree])])
    operator, left, right = tree
    a = _may_hold(left, phrases, plain)
    if operator == "NOT":
        return a
    b = _may_hold(right, phrases, plain)
    return a & b if operator == "AND" else a | b


def _counted(tree, tf: list[Column], when: Column | None = None) -> dict[int, Column | None]:
    """Phrases that count in a row's score, each with the condition on which it does (None: always).

    What stands below a part of the query that the row doesn't match, or behind NOT, doesn't count.
    """
    if tree is None or isinstance(tree, int):
        return {} if tree is None else {tree: when}
    operator, left, right = tree
    if operator == "NOT":
        return _counted(left, tf, when)
    out: dict[int, Column | None] = {}
    for side in (left, right):
        own = when
        if operator == "OR" and not isinstance(side, int):
            own = _holds(side, tf) if when is None else when & _holds(side, tf)
        out |= _counted(side, tf, own)
    return out


def _parsed(text: str, strict: bool) -> Query | None:
    try:
        return parse_query(text)
    except QueryError:
        if strict:
            raise
        return None


def hits_of(postings: DataFrame, phrases: list[tuple[str, ...]]) -> DataFrame:
    """``(chunk_id, doc_len, tf_0, ...)`` of the chunks that hold any of the phrases' words: how often each phrase stands in them."""
    wanted = sorted({t for p in phrases for t in p})
    name = {t: f"pos_{i}" for i, t in enumerate(wanted)}
    hits = postings.filter(F.col("term").isin(wanted)).groupBy("chunk_id").agg(F.max("doc_len").alias("doc_len"), *(F.collect_list(F.when(F.col("term") == t, F.col("pos"))).alias(name[t]) for t in wanted))

    def frequency(phrase):
        if len(phrase) == 1:
            return F.size(name[phrase[0]])
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col(name[t]), p + i) for i, t in enumerate(phrase) if i])
        return F.size(F.filter(name[phrase[0]], follows))

    return hits.select("chunk_id", "doc_len", *(frequency(p).alias(f"tf_{i}") for i, p in enumerate(phrases)))


def search(postings: DataFrame, statistics: DataFrame, text: str, k: int | None = 10, strict: bool = False) -> DataFrame:
    """``(chunk_id, bm25)``, best (lowest) first; ties by chunk_id.  ``strict`` raises where a query isn't valid."""
    query = _parsed(text, strict)
    if query is None:
        return postings.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    distinct = list(dict.fromkeys(query.phrases))
    hits = hits_of(postings, distinct)
    counts = hits.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(distinct))))
    return _ranked(hits, counts.crossJoin(statistics), query, k)


def scan(chunks: DataFrame, text: str, k: int | None = 10, strict: bool = False, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """What ``search`` gives, without an index: one pass takes the statistics, another tokenises only the chunks in which the words occur; nothing is shuffled but sums and the best rows."""
    query = _parsed(text, strict)
    if query is None:
        return chunks.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    distinct = list(dict.fromkeys(query.phrases))

    def frequency(phrase):
        if len(phrase) == 1:
            return F.size("tokens") - F.size(F.array_remove("tokens", phrase[0]))
        at = lambda x, i: reduce(lambda a, b: a & b, [x == phrase[0], *(F.get("tokens", i + n) == t for n, t in enumerate(phrase) if n)])
        return F.size(F.filter("tokens", at))

    def counted(rows):
        # a generator's output isn't folded into the filters and counts above it, so each text is tokenised once
        index = indexed(rows, columns).select("chunk_id", F.explode(F.array("tokens")).alias("tokens"))
        return index.select("chunk_id", _doc_len(columns), *(frequency(p).alias(f"tf_{i}") for i, p in enumerate(distinct)))

    numbers = counted(chunks).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(distinct))))
    kinds = dict(chunks.dtypes)
    plain = F.array(*(folded(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")) for c in columns))
    some = chunks.withColumn("_plain", F.explode(F.array(F.array_join(plain, "\n")))).filter(_may_hold(query.tree, query.phrases, F.col("_plain"))).drop("_plain")
    return _ranked(counted(some), numbers, query, k)


def _ranked(hits: DataFrame, numbers: DataFrame, query: Query, k: int | None) -> DataFrame:
    distinct = list(dict.fromkeys(query.phrases))
    numbers = F.broadcast(numbers)  # one row
    tf = {p: F.col(f"tf_{i}").cast("double") for i, p in enumerate(distinct)}
    score = F.lit(0.0)
    for i, when in sorted(_counted(query.tree, [tf[p] for p in query.phrases]).items()):  # a repeated phrase counts again
        p = query.phrases[i]
        n = F.col(f"df_{distinct.index(p)}").cast("double")
        idf = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        part = idf * tf[p] * (K1 + 1) / (tf[p] + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
        score = score + (part if when is None else F.when(when, part).otherwise(0.0))
    found = hits.filter(_holds(query.tree, [tf[p] for p in query.phrases])).crossJoin(numbers).select("chunk_id", (-score).alias("bm25"))
    return found if k is None else found.orderBy("bm25", "chunk_id").limit(k)
