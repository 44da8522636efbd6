"""Benchmark decontamination by MinHash containment, with DataFrame functions alone.

Items are partitioned by their number of distinct word shingles, into classes
[2^s, 2^(s+1)).  Each class has its own sketch length and number of hits: a
sketch is an item's smallest hashes, as many as the class's largest item may
lack at the threshold, and the hits more.  A document that contains an item to
that share contains at least the hits of its sketch, however long it is, and an
item of a large class isn't looked at for one common passage.  Documents found
are verified by exact containment of shingles, compared as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, written

WIDTH, THRESHOLD = 5, 0.8
#: Words of a stretch; stretches overlap, so each shingle starts in exactly one.
STRETCH = 512
#: Shingles of a class's smallest item for each hit that the class wants; one hit at least.
SHINGLES_A_HIT = 8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(rows: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep`` and the words ``w0`` ... of every shingle, in their order, from an array column ``words``."""
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - width), F.lit(STRETCH)), lambda s: F.slice("words", s + 1, F.lit(STRETCH + width - 1)))
    parts = rows.select(*keep, F.explode(stretches).alias("part"))
    placed = parts.select(*keep, "part", F.posexplode("part").alias("pos", "w0")).filter(f"pos < {STRETCH}")
    return placed.select(*keep, "w0", *(F.get("part", F.col("pos") + k).alias(f"w{k}") for k in range(1, width))).filter(F.col(f"w{width - 1}").isNotNull())


def _with_words(rows: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """The words as a column of their own, split once: a generator's output is not folded into later expressions."""
    return rows.select(*keep, F.explode(F.array(words(text))).alias("words"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` where a document contains an item to ``threshold`` or more.

    Shingles are distinct runs of ``width`` words.  An item with fewer words has
    none and is found nowhere: a word or two tell no leak, they are in clean
    documents too.  Rows that share an id, or a null id, count as one document
    or item; null texts are empty.  Repeated rows change nothing.
    """
    run = [f"w{k}" for k in range(width)]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    own = written(_shingles(_with_words(items, ["item_id"], F.col("item_text")), ["item_id"], width).distinct().withColumn("h", F.xxhash64(*run)), "item_shingles")
    by_item = Window.partitionBy("item_id")
    ranked = own.select("item_id", "h", F.count("*").over(by_item).alias("n"), F.row_number().over(by_item.orderBy("h")).alias("rank"))
    least = F.pow(F.lit(2), F.floor(F.log2("n")))
    ranked = ranked.withColumn("hits", F.greatest(F.lit(1), F.floor(least / SHINGLES_A_HIT)).cast("int"))
    sketch = written(ranked.filter(F.col("rank") <= F.floor((2 * least - 1) * F.lit(1 - threshold) + 1e-9) + F.col("hits")).select("item_id", "h", "hits"), "sketches")
    hashed = _shingles(_with_words(docs, ["doc_id"], F.col("text")), ["doc_id"], width).select("doc_id", F.xxhash64(*run).alias("h"))
    met = hashed.join(hinted(sketch), "h").select("doc_id", "item_id", "hits", "h").distinct()
    candidates = written(met.groupBy("doc_id", "item_id", "hits").count().filter("count >= hits").select("doc_id").distinct().withColumnRenamed("doc_id", "candidate"), "candidates")
    chosen = docs.join(hinted(candidates), F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi")
    held = _shingles(_with_words(chosen, ["doc_id"], F.col("text")), ["doc_id"], width)
    found = held.join(hinted(own.drop("h")), run).select("doc_id", "item_id", *run).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    # a pair may share shingles though its sketch wasn't met; then it is below the threshold
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    joined = found.join(sizes, found["item_id"].eqNullSafe(sizes["item_id"])).select("doc_id", found["item_id"], "n_shingles", "n_found")
    return joined.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold) - 1e-9)
