"""Training-data pipeline: quality, near duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what it returns to
the shared folder and gives the reread table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontam, packing, resample, simhash
from quarry.llm.queries import CAPACITY, table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; rows with the same id and text are judged alike."""
    judged = resample.select(docs, table(spark, sf_dir, "labels")).filter("NOT selected").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("bad_key"))
    return docs.join(common.hinted(common.written(judged, "rejected")), same, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash candidates of 0.8 similarity on five-word shingles link: that with the smallest id.

    Texts are judged, not ids: rows with one id or none count as one document
    only if their texts link.  A row without an id stays if its group has no
    other.  Of rows with the same id and text any one stays.
    """
    key = simhash.text_key(F.col("text"))
    rows = common.written(docs.groupBy("doc_id", key.alias("text_key")).agg(F.count("*").alias("n")), "rows")
    # minima are summed up before a shuffle, and rows are matched by id and text together, so no large group meets in a task
    first = lambda *names: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *names)).alias("first")
    texts = rows.groupBy("text_key").agg(first()).select("text_key", "first.doc_id")
    classes = texts.join(simhash.similar_texts(docs), "text_key", "left").groupBy(F.coalesce("component", "text_key").alias("component")).agg(first("text_key"))
    kept = classes.select(F.col("first.doc_id").alias("id_"), F.col("first.text_key").alias("key_"))
    others = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left_anti")
    gone = common.written(others.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")), "copies")
    repeated = common.written(rows.filter("n > 1").select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (key == F.col("key_"))
    kept = docs.join(common.hinted(gone), same, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(common.hinted(repeated), same, "left_semi").withColumn("key_", key).dropDuplicates(["doc_id", "key_"])
    return kept.join(common.hinted(repeated), same, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own text contains no benchmark item to 0.8 or more; rows with the same id or none are judged apart."""
    key = simhash.text_key(F.col("text"))
    found = decontam.contaminated(docs.select(key.alias("text_key"), "text"), table(spark, sf_dir, "benchmark"), id_col="text_key")
    bad = common.written(found.select(F.col("doc_id").alias("bad_key")).distinct(), "leaks")
    return docs.join(common.hinted(bad), key == F.col("bad_key"), "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=CAPACITY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: Weights, fingerprints and packing are beyond SQL; tests hold near_duplicates and each operator against brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for ``documents``; what a stage has put into the shared folder goes once its own table is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/stage_{name}-{common.unique()}"
        with common.scratch_deleted(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
