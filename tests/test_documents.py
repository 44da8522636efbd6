"""Snippets, links and documents put together again, by hand-made cases."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import documents as D


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c).first()[0]


def test_snippets(spark):
    long = "x" * 80 + "\n\nNeedle here\n" + "y" * 200
    assert one(spark, T.snippet_line(F.col("t")), t="a\n\nb") == "a b"
    assert one(spark, T.snippet_line(F.col("t")), t=long) == ("x" * 80 + " Needle here " + "y" * 200)[:200] + "..."
    assert one(spark, T.snippet_around(F.col("t"), "needle?"), t=long) == "..." + long[32:232].replace("\n\n", " ").replace("\n", " ") + "..."
    for query in ("none", "", "xx"):
        assert one(spark, T.snippet_around(F.col("t"), query), t=long).startswith("xxx")
    assert one(spark, T.snippet_around(F.col("t"), "a"), t="") == ""


def test_badges_and_links(spark):
    n = F.lit(None).cast("int")
    assert one(spark, T.method_badge("hybrid", F.lit(0.01234), F.lit(2), n)) == "HYB[-/F2] (0.0123)"
    assert one(spark, T.method_badge("hybrid", F.lit(0.5), n, F.lit(1))) == "HYB[V1/-] (0.5000)"
    assert one(spark, T.heading_url(F.lit("/a/"), F.array(F.lit("B"), F.lit("C d!")), "https://x/")) == "https://x/a/#c-d"
    assert one(spark, T.heading_url(F.lit("/a/"), F.array().cast("array<string>"))) == "/a/"
    link = '<a href="#ref-2" class="citation-link">[2]</a>'
    assert one(spark, T.cited(F.lit("so [2], [2](u), (2) and (9)\n\nReferences:\n[1] a"), 3)) == f"so {link}, [2](u), {link} and (9)"
    assert one(spark, T.cited(F.lit("so (2)"))) == "so (2)"


def test_reading(spark):
    rows = [(1, "a", "one", ["A", "B"]), (1, "b", "two", ["A", "C <i>x</i>"]), (1, "c", "three", ["A"]), (1, "d", "four", ["A", "B"]), (2, "a", "alone", None), (3, "a", "same", ["A"]), (3, "b", "again", ["A"])]
    got = {r.doc_id: r for r in D.reading(spark.createDataFrame(rows, "doc_id int, chunk_id string, content string, headings array<string>")).collect()}
    assert got[1].content == "# A\n\n## B\n\none\n\n## C <i>x</i>\n\ntwo\n\nthree\n\n## B\n\nfour"
    assert [tuple(c) for c in got[1].contents] == [("A", "a"), ("B", "b"), ("C x", "c-x")]
    assert got[2].content == "alone" and got[2].contents == [] and got[3].content == "# A\n\nsame\n\nagain"
