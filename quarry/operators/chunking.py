"""Overlapping chunks of sections, by a pointer walk inside one array expression.

Units (paragraphs, or sentences) are packed greedily: a chunk is a window
``[s, e)`` of units with at most ``most`` tokens unless one unit alone has more;
the next begins with the units at the end that fit into ``overlap``, and the
unit that didn't fit is always taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, estimate_tokens, paragraphs, sentences, strip

MOST, OVERLAP, SLACK = 500, 80, 1.2


def windows(tokens: Column, most: int, overlap: int) -> Column:
    """Array of (s, e, tokens) over an array of the units' token counts."""
    start = F.struct(F.array().cast("array<struct<s:int,e:int,tokens:bigint>>").alias("done"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("sum"))

    def add(state, n):
        full = (state["sum"] + n > most) & (state["e"] > state["s"])
        # the largest tail that fits: count units from the end while they do
        tail = F.aggregate(
            F.reverse(F.slice(tokens, state["s"] + 1, state["e"] - state["s"])),
            F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("sum"), F.lit(True).alias("open")),
            lambda t, x: F.struct(
                F.when(t["open"] & (t["sum"] + x <= overlap), t["k"] + 1).otherwise(t["k"]).alias("k"),
                F.when(t["open"] & (t["sum"] + x <= overlap), t["sum"] + x).otherwise(t["sum"]).alias("sum"),
                (t["open"] & (t["sum"] + x <= overlap)).alias("open"),
            ),
        )
        closed = F.struct(state["s"].alias("s"), state["e"].alias("e"), state["sum"].alias("tokens"))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(closed))).otherwise(state["done"]).alias("done"),
            F.when(full, state["e"] - tail["k"]).otherwise(state["s"]).alias("s"),
            (state["e"] + 1).alias("e"),
            (F.when(full, tail["sum"]).otherwise(state["sum"]) + n).alias("sum"),
        )

    last = lambda t: F.when(t["e"] > t["s"], F.concat(t["done"], F.array(F.struct(t["s"].alias("s"), t["e"].alias("e"), t["sum"].alias("tokens"))))).otherwise(t["done"])
    return F.aggregate(tokens, start, add, last)


def _packed(rows: DataFrame, keep: list[str], units: Column, most: int, overlap: int) -> DataFrame:
    """``keep``, ``part`` (place of the chunk in its row), ``content``, ``token_count``."""
    out = rows.select(*keep, F.explode(F.array(units)).alias("units"))
    out = out.select(*keep, "units", F.explode(F.array(F.transform("units", estimate_tokens))).alias("tokens"))
    out = out.select(*keep, "units", F.posexplode(windows(F.col("tokens"), most, overlap)).alias("part", "w"))
    content = F.array_join(F.slice("units", F.col("w.s") + 1, F.col("w.e") - F.col("w.s")), "\n\n")
    return out.select(*keep, "part", content.alias("content"), F.col("w.tokens").alias("token_count"))


def chunk_sections(sections: DataFrame, keys: list[str], section_no: str = "section_no", content: str = "content", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """``keys``, ``section_no``, ``idx`` (from 0 in each document), ``content``, ``token_count``, ``content_hash``.

    A section of at most ``most`` tokens is one chunk.  Others are packed by
    paragraphs, and a chunk of more than 1.2 times ``most`` again by sentences.
    Blank sections give none.
    """
    keep = [*keys, section_no]
    rows = sections.select(*keep, F.col(content).alias("text")).withColumn("whole", estimate_tokens(F.col("text")))
    short = rows.filter(F.col("whole") <= most).select(*keep, F.lit(0).alias("part"), F.lit(0).alias("sub"), strip(F.col("text")).alias("content"), F.col("whole").alias("token_count")).filter("content <> ''")
    by_paragraph = _packed(rows.filter(F.col("whole") > most), keep, paragraphs(F.col("text")), most, overlap)
    fits = by_paragraph.filter(F.col("token_count") <= SLACK * most).select(*keep, "part", F.lit(0).alias("sub"), "content", "token_count")
    long = by_paragraph.filter(F.col("token_count") > SLACK * most).withColumnRenamed("part", "outer")
    by_sentence = _packed(long.select(*keep, "outer", "content"), [*keep, "outer"], sentences(F.col("content")), most, overlap)
    by_sentence = by_sentence.select(*keep, F.col("outer").alias("part"), F.col("part").alias("sub"), "content", "token_count")
    every = short.unionByName(fits).unionByName(by_sentence)
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(section_no, "part", "sub")) - 1
    return every.withColumn("idx", idx.cast("bigint")).select(*keep, "idx", "content", "token_count", content_hash(F.col("content")).alias("content_hash"))
