"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, forest, kdshards, packing, rans, resample, simhash, tokencount, warc

SHARDS, CAPACITY = 40, 1024


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.similar(table(spark, sf_dir, "embeddings"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshards.shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "selected")


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(extra)))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=CAPACITY)


def queries() -> dict:
    import corpus_pipeline

    own = [op1_warc_chunks, op2_rans_ids, op3_minhash_containment, op4_fst_token_counts, op5_projection_forest, op6_kd_shards, op7_importance_resampling, op8_simhash_tiles, op9_prefix_targets, op10_harmonic_packing]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


# sha1 and sizes by SQL; archives are read back to the same values
OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS responder FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN responder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN responder = page_id THEN NULL ELSE responder END AS refers_to, url
FROM r"""

OP3_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN s USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= 0.8::DOUBLE * n_shingles - 1e-9"""

OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
c(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op1_warc_chunks": OP1_SQL, "op3_minhash_containment": OP3_SQL, "op5_projection_forest": OP5_SQL} | whole
