"""Harmonic packing of token ids into sequences of a fixed capacity.

A piece of length l is of class j = capacity // l, and j pieces of class j fill
one sequence.  Documents are cut into reciprocals of the capacity (1024, 512,
341, 256 ...): a remainder is kept whole where a sequence full of it wastes at
most 2 % or where it is shorter than 64, else its largest reciprocal is cut off.

Workers number the pieces of a class on their own; offsets by (class, worker),
from counts, make the numbers gapless over all workers, so piece i of class j
lies in sequence i // j whichever worker has it.  What doesn't fill a last
sequence is fewer than j pieces a class - a number that only the capacity
bounds - and is packed first-fit decreasing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_ids, merge_blocks, text_bytes, written

SHORT, WASTE = 64, 0.02


def cut_lengths(n: int, capacity: int = 1024) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if rest < SHORT or capacity - j * rest <= WASTE * capacity:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, class, worker, number within class and worker (and ids).

    A null or empty text has the end id alone.  Repeated rows are documents of
    their own.  Other columns are not read.
    """
    tails = [cut_lengths(r, capacity) for r in range(capacity)]

    def pieces(batches):
        from pyspark import TaskContext

        from .tokenids import worker_encoder

        worker, seen, encoder = TaskContext.get().partitionId(), Counter(), worker_encoder(tokenizer)
        for batch in merge_blocks(batches):
            ids, at = encoder.encode(text_bytes(batch.column(1)))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                start, whole = 0, len(own) // capacity
                for length in [capacity] * whole + tails[len(own) % capacity]:
                    j, part = capacity // length, own[start : start + length]
                    rows.append((i, start, length, crc_ids(part), len(own), j, seen[j], part.tobytes() if with_ids else None))
                    seen[j] += 1
                    start += length
            doc, start, length, crc, n, j, number, raw = zip(*rows)
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n)), pa.array(j, pa.int32()), pa.array([worker] * len(j), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=names)

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "number"] + ["ids"] * with_ids
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["bigint"] * 4, "int", "int", "bigint"] + ["binary"] * with_ids
    return docs.mapInArrow(pieces, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence); with ``with_ids`` also its ids.

    Empty input gives no rows; see ``cut_pieces`` for nulls and repeated rows.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    counts = written(pieces.groupBy("class", "worker").agg(F.count("*").alias("n")), "piece_counts")
    before = counts.select("class", "worker", (F.sum("n").over(Window.partitionBy("class").orderBy("worker")) - F.col("n")).alias("before"))
    # one row per class, of which there are at most as many as the capacity
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    plan, base = [], 0
    for j in sorted(totals):
        plan.append((j, base, totals[j] // j * j))
        base += totals[j] // j
    classes = spark.createDataFrame(plan, "class int, base bigint, filled bigint")
    numbered = pieces.join(before, ["class", "worker"]).join(F.broadcast(classes), "class").withColumn("number", F.col("number") + F.col("before"))
    main = numbered.filter("number < filled").withColumn("sequence_id", F.expr("base + number div class"))
    within = Window.partitionBy("sequence_id").orderBy("number")
    main = main.withColumn("offset", F.sum("length").over(within) - F.col("length"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    left = numbered.filter("number >= filled").orderBy(F.desc("length"), "number").collect()  # fewer than j for class j
    room: list[int] = []
    rows = []
    for r in left:
        k = next((k for k, x in enumerate(room) if x >= r["length"]), len(room))
        if k == len(room):
            room.append(capacity)
        rows.append((*(r[c] for c in out[:5]), base + k, capacity - room[k], *(r[c] for c in out[7:])))
        room[k] -= r["length"]
    main = main.select(*out)
    return main.unionByName(spark.createDataFrame(rows, main.schema)) if rows else main


def sequences(pieces: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` from ``pack(with_ids=True)``: padded to the capacity, except at a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("ids"))))  # at most capacity rows a group
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(F.transform(parts, lambda p: p["ids"]), "").alias("ids"))
    padded = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, F.col("n_tokens")).otherwise(F.lit(capacity))
    pad = pad_id.to_bytes(4, "little").hex().upper()
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat("ids", F.repeat(F.lit(pad), (padded - F.col("n_tokens")).cast("int")))).alias("ids"))
