"""Quality by importance resampling (Xie et al., 2023): hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts every text.  The target model counts the texts of at most
``max_labels`` labelled good documents.  A document's log weight is the mean over
its n-grams of log(target / raw), so that length doesn't decide; the k largest
of log weight over ``TEMPERATURE`` plus Gumbel noise are selected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_blocks, text_bytes, written

#: Bound on the labelled rows that the target model and k are fitted on.
MAX_LABELS = 20_000
#: Difference in log weight that makes a document e times as likely to be drawn first.
TEMPERATURE = 0.002
#: Share of the held-out good documents that the cut leaves in, at least.
KEEP_GOOD = 0.95


def labelled_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> dict[int, bool]:
    """doc_id -> good, of at most ``max_labels`` ids, chosen by hash; an id with any bad row is bad; null ids or labels are left out."""
    rows = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect()
    return {r["doc_id"]: r["q"] > 0 for r in rows}


def fit(docs: DataFrame, good: list[int]) -> np.ndarray:
    """log(target / raw) of each bucket.  Counts are summed over tasks; what comes to the driver is a row per bucket."""
    from .ngrams import BUCKETS

    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(good))  # at most MAX_LABELS ids
    m = BUCKETS + 2

    def count(batches):
        from .ngrams import features

        raw, target = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for batch in merge_blocks(batches, limit=1 << 20):
            doc, bucket = features(text_bytes(batch.column(1)))
            raw += np.bincount(bucket, minlength=m)
            own = np.array([x in chosen.value for x in batch.column(0).to_pylist()], bool)
            target += np.bincount(bucket[own[doc]], minlength=m)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(m), np.zeros(m)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    raw, target = raw + 1, target + 1
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``(doc_id, text_key, log_weight)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # a float per bucket

    def score(batches):
        from .ngrams import features

        for batch in merge_blocks(batches, limit=1 << 20):
            doc, bucket = features(text_bytes(batch.column(1)))
            w = np.bincount(doc, weights=shared.value[bucket], minlength=batch.num_rows) / np.bincount(doc, minlength=batch.num_rows).clip(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(w)], names=["doc_id", "text_key", "log_weight"])

    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: counts in 4096 ranges, then again inside the range it lies in."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while True:
        width = (hi - lo) / 4096
        inside = df.filter(F.col(column).between(lo, hi))
        if not width or lo + width == lo:
            return hi
        bucket = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095)).alias("b")
        above = 0
        for r in sorted(inside.groupBy(bucket).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        k, lo, hi = k - above, r["lo"], r["hi"]
        if lo == hi or r["n"] == 1:
            return lo


def cut_between(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The log weight from which on a document counts as good.

    Of the places that leave in ``keep_good`` of the good ones or more, that at
    which the shares of good and bad ones left in differ most, the lowest of such;
    half-way to the next weight below.  Without bad ones, the least good weight.
    """
    good, bad = np.sort(good), np.sort(bad)
    if not len(bad):
        return float(good[0])
    places = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(good, places, "left") / len(good)
    wrong = 1 - np.searchsorted(bad, places, "left") / len(bad)
    best = int(np.argmax(np.where(kept >= keep_good, kept - wrong, -2.0)))
    return float(places[best] if not best else (places[best] + places[best - 1]) / 2)


def select(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, seed: int = 7, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, log_weight, gumbel_key, selected)``, a row per document.

    A fifth of the labelled good documents, by a hash of the id, is held out of
    the target model, as all bad ones are; k is the number of documents whose log
    weight reaches ``cut_between`` those held out (all good ones, if none is).  Noise comes from a hash of
    seed, id and text, so a rerun selects the same; rows with the same id and
    text share their key, and rows that tie with the k-th are all selected.  A
    null or empty text has weight zero.  No good label (or no documents):
    nothing can be judged, so all are selected.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = labelled_sample(labels, max_labels)
    good = [d for d, ok in sample.items() if ok]
    held = [d for d in good if zlib.crc32(str(d).encode()) % 5 == 0]
    fitted = [d for d in good if zlib.crc32(str(d).encode()) % 5]
    held, fitted = held or good, fitted or good
    scored = written(weights(docs.withColumn("text_key", F.xxhash64("text")), fit(docs, fitted)), "weights")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") / TEMPERATURE - F.log(-F.log(uniform)))
    spark = docs.sparkSession
    judged = [(d, True) for d in held] + [(d, False) for d, ok in sample.items() if not ok]
    ids = F.broadcast(spark.createDataFrame(judged, f"doc_id {scored.schema['doc_id'].dataType.simpleString()}, good boolean"))  # at most max_labels rows
    known = scored.join(ids, "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("w")).collect() if good else []
    weights_of = lambda ok: np.array([r["w"] for r in known if r["good"] == ok])
    if not len(weights_of(True)):
        return keyed.withColumn("selected", F.lit(True))
    k = scored.filter(F.col("log_weight") >= cut_between(weights_of(True), weights_of(False), keep_good)).count()
    return keyed.withColumn("selected", F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))
