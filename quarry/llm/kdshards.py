"""Shards of near-equal bytes by a k-d tree over document metadata.

A node that is to become n shards is split into floor(n/2) and the rest, along
the dimension in which its documents lie furthest apart, at the weighted median:
the key below which the documents hold that share of the bytes.  All nodes of a
level are split at once.  A cut is searched in the sums of bytes over ranges of
keys, then over ranges within the range it falls in; only such sums, at most
``RANGES`` a node, come to the driver.

A key is a document's place along the dimension, then a hash of its text, then
one of the row, so no two rows tie, a hot value is split like any other, and
equal texts stay side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, hinted, written

RANGES = 1024
PLACE, TEXT, ROW = 20, 22, 21
#: Rows that get their slots in one task, about.
SLOT_ROWS = 1 << 15


def _ranks(rows: DataFrame, column: Column) -> DataFrame:
    """``(value, rank)`` of the distinct strings of a column in byte order, from 1; whole strings, ranked by a distributed sort."""
    values = rows.select(column.cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    ordered = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "values")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per partition
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select("value", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("double").alias("rank"))


def shards(docs: DataFrame, n_shards: int = 40, dimensions: tuple[str, ...] = ("size", "lang", "source"), overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, a row per document; slots are gapless from 0 in each shard.

    Size is the text's UTF-8 bytes (null: none) plus ``overhead``.  Dimensions
    are ``size`` (by its logarithm) and names of columns: numbers by value,
    others by the rank of the whole string in byte order; null comes first.
    A dimension has 2^20 places; what shares one is told apart by text.  Rows are never dropped: repeated
    rows, null ids and empty texts are placed like others.  Fewer rows than
    shards leave shards empty.
    """
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint") + overhead
    places, texts = {}, {}
    for k, name in enumerate(dimensions):
        if name == "size":
            places[f"p{k}"] = F.log2(size.cast("double"))
        elif kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal"):
            places[f"p{k}"] = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
        else:
            places[f"p{k}"], texts[f"p{k}"] = F.col(name).cast("string"), _ranks(docs, F.col(name))
    base = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *(c.alias(n) for n, c in places.items()))
    for n, ranks in texts.items():
        ranked = hinted(written(ranks, "ranks").withColumnsRenamed({"value": f"value_{n}", "rank": f"rank_{n}"}))
        base = base.join(ranked, F.col(n) == F.col(f"value_{n}"), "left").withColumn(n, F.coalesce(f"rank_{n}", F.lit(0.0))).drop(f"value_{n}", f"rank_{n}")
    base = written(base.withColumn("row_hash", F.xxhash64("doc_id", "text_hash", F.monotonically_increasing_id())), "metadata")
    spans = base.agg(*(f(n).alias(f"{n}_{f.__name__}") for n in places for f in (F.min, F.max)), F.count("*").alias("n")).first()
    keys = {}
    for n in places:
        low, high = spans[f"{n}_min"], spans[f"{n}_max"]
        part = F.lit(0) if not spans["n"] or high <= low else F.floor((F.col(n) - low) / (high - low) * float((1 << PLACE) - 1)).cast("bigint")
        keys[n] = F.shiftleft(part.cast("bigint"), TEXT + ROW) + F.shiftleft(F.pmod("text_hash", F.lit(1 << TEXT)), ROW) + F.pmod("row_hash", F.lit(1 << ROW))
    meta = base.select("doc_id", "size", "text_crc32", "row_hash", *(k.alias(n) for n, k in keys.items()))
    placed = _grow(meta, list(keys), n_shards).withColumnRenamed("node", "shard")
    drop_written(base)
    parts = max(4, -(-spans["n"] // (n_shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod("row_hash", F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row_hash")) - 1)
    return ranked.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("bigint").alias("slot"))


def _grow(meta: DataFrame, names: list[str], n_shards: int) -> DataFrame:
    """``meta`` with ``node``: the shard of each row.  A node bears the number of its first shard."""
    spark = meta.sparkSession
    meta = written(meta.withColumn("node", F.lit(0)), "level")
    nodes = {0: n_shards}  # each with how many shards it is to become; n_shards of them at most
    while any(n > 1 for n in nodes.values()):
        stats = {r["node"]: r for r in meta.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max))).collect()}
        cuts, search = {}, {}
        for node, n in nodes.items():
            if n > 1 and (r := stats.get(node)) is not None:
                widest = max(names, key=lambda d: (r[f"{d}_max"] >> (TEXT + ROW)) - (r[f"{d}_min"] >> (TEXT + ROW)))
                search[node] = [widest, r[f"{widest}_min"], r[f"{widest}_max"], 0, r["bytes"] * (n // 2) / n, r["bytes"] * 2e-5]
        while search:
            cuts |= _narrow(meta, names, search)
        plan = spark.createDataFrame([(node, d, cut, nodes[node] // 2) for node, (d, cut) in cuts.items()], "node int, dimension string, cut bigint, half int")
        moved = meta.join(F.broadcast(plan), "node", "left").withColumn("node", F.col("node") + F.when(_along(names) > F.col("cut"), F.col("half")).otherwise(0))
        last, meta = meta, written(moved.select(meta.columns), "level")
        drop_written(last)
        nodes = {k: v for node, n in nodes.items() for k, v in (((node, n),) if n == 1 else ((node, n // 2), (node + n // 2, n - n // 2)))}
    return meta


def _along(names: list[str]) -> Column:
    """The key along the dimension that the column ``dimension`` names."""
    key = F.when(F.col("dimension") == names[0], F.col(names[0]))
    for n in names[1:]:
        key = key.when(F.col("dimension") == n, F.col(n))
    return key


def _narrow(meta: DataFrame, names: list[str], search: dict) -> dict:
    """One round for all nodes: cuts found; the others' ranges in ``search`` get narrower."""
    plan = meta.sparkSession.createDataFrame([(node, d, lo, hi, (hi - lo) // RANGES + 1) for node, (d, lo, hi, *_) in search.items()], "node int, dimension string, low bigint, high bigint, step bigint")
    ranged = meta.join(F.broadcast(plan), "node").withColumn("key", _along(names)).filter("key BETWEEN low AND high")
    sums: dict[int, list] = {node: [] for node in search}
    for r in ranged.groupBy("node", F.expr("(key - low) div step").alias("range")).agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
        sums[r["node"]].append(r)
    found = {}
    for node, rows in sums.items():
        d, _, _, before, target, fine = search[node]
        rows.sort(key=lambda r: r["range"])
        for r in rows:
            if before + r["bytes"] >= target:
                break
            before += r["bytes"]
        if r["lo"] == r["hi"] or r["bytes"] <= fine:
            whole = before + r["bytes"] - target <= target - before
            found[node] = (d, r["hi"] if whole else r["lo"] - 1)
            del search[node]
        else:
            search[node] = [d, r["lo"], r["hi"], before, target, fine]
    return found
