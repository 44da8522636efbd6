"""Queries over the test tables, and the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import documents as D
from .operators import fulltext as FT
from .operators import vectors as V
from .operators.chunking import chunk_sections
from .operators.filters import compile_filter
from .operators.hybrid import fuse
from .operators.vector_index import first_wins, last_wins, page
from .plans import build

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, one each."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("chk_"), F.col("doc_id")).alias("chunk_id"), "doc_id", F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/")).alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.col("source").alias("section"), F.array("lang").alias("tags"), F.col("text").alias("content"),
    )


CHUNKS = "c AS (SELECT 'chk_' || doc_id AS chunk_id, doc_id, '/' || source || '/' || doc_id || '/' AS url, 'Document ' || doc_id AS title, source AS section, lang AS tags, text AS content FROM documents)"

# -- full text ---------------------------------------------------------------

TERMS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


def _fts_sql(terms: list[str], holds: str, k: int = 10) -> str:
    whole = "chunk_id || ' ' || title || ' ' || section || ' ' || content || ' ' || tags"
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))" for i in range(len(terms)))
    return f"""WITH {CHUNKS}, i AS (SELECT chunk_id, {TERMS.format(whole)} AS t FROM c), p AS (SELECT chunk_id, len(t)::DOUBLE AS len, {tf} FROM i),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, {df} FROM p), r AS (SELECT chunk_id, round(-({score}), 12) AS bm25 FROM p, s WHERE {holds})
SELECT chunk_id, bm25 FROM r ORDER BY bm25, chunk_id LIMIT {k}"""


def _fts(spark, sf_dir, text: str, k: int = 10) -> DataFrame:
    found = FT.scan(chunks(spark, sf_dir), text, k=None).withColumn("bm25", F.round("bm25", 12))
    return found.orderBy("bm25", "chunk_id").limit(k)


for _name, _text, _terms, _holds in [
    ("fts_and", "ther than", ["ther", "than"], "tf0 > 0 AND tf1 > 0"),
    ("fts_or", "erin OR thnt", ["erin", "thnt"], "tf0 > 0 OR tf1 > 0"),
    ("fts_not", "ther NOT than", ["ther", "than"], "tf0 > 0 AND NOT tf1 > 0"),
    ("fts_common_idf_floor", "in the", ["in", "the"], "tf0 > 0 AND tf1 > 0"),
    ("fts_accents", "MÉNT letré", ["ment", "letre"], "tf0 > 0 AND tf1 > 0"),
]:
    query(_fts_sql(_terms, _holds), _name)(lambda spark, sf_dir, _t=_text: _fts(spark, sf_dir, _t))


@query("SELECT 'x' AS chunk_id, 0.0::DOUBLE AS bm25 WHERE false")
def fts_syntax_error_empty(spark, sf_dir):
    return _fts(spark, sf_dir, "what is ther?")


@query(f"""WITH {CHUNKS}, i AS (SELECT chunk_id, {TERMS.format("content")} AS t FROM c)
SELECT chunk_id, len(list_filter(range(1, len(t)), lambda k: t[k] = 'of' AND t[k + 1] = 'the'))::BIGINT AS n FROM i WHERE n > 0""")  # fmt: skip
def fts_phrase_counts(spark, sf_dir):
    """How often the phrase ``of the`` stands in each content."""
    index = FT.indexed(chunks(spark, sf_dir), ("content",))
    return FT.hits_of(FT.postings(index), [("of", "the")]).select("chunk_id", F.col("tf_0").cast("bigint").alias("n")).filter("n > 0")


@query(_fts_sql(["ther", "than"], "tf0 > 0 AND tf1 > 0"))
def fts_postings(spark, sf_dir):
    """``fts_and`` by postings, as an index has them."""
    index = FT.indexed(chunks(spark, sf_dir))
    found = FT.search(FT.postings(index), FT.statistics(index), "ther than", k=None).withColumn("bm25", F.round("bm25", 12))
    return found.orderBy("bm25", "chunk_id").limit(10)


# -- literal -----------------------------------------------------------------


def _literal_sql(text: str, k: int = 10) -> str:
    q, low = text.lower().replace("'", "''"), f"translate(content, '{T.UPPER}', '{T.LOWER}')"
    return f"WITH {CHUNKS}, m AS (SELECT chunk_id, (length({low}) - length(replace({low}, '{q}', ''))) // {len(text)} AS match_count FROM c WHERE contains({low}, '{q}')) SELECT chunk_id, match_count::BIGINT AS match_count FROM m ORDER BY match_count DESC, chunk_id LIMIT {k}"


for _name, _text in [("literal_ampersand", "&&&"), ("literal_percent", "%"), ("literal_license", "License"), ("literal_pipe", "|")]:
    query(_literal_sql(_text), _name)(lambda spark, sf_dir, _t=_text: D.literal_search(chunks(spark, sf_dir), _t))

# -- vectors -----------------------------------------------------------------


def vectors(spark, sf_dir) -> DataFrame:
    """The vector index: namespace from the label; metadata with label and id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), "vec_id", F.col("embedding").alias("values"), F.concat(F.lit("n"), F.col("label")).alias("namespace"), F.to_json(F.struct("label", F.col("vec_id").alias("n"), F.concat(F.lit("k"), F.col("label")).alias("kind"))).alias("metadata"))


VECTORS = "v AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, vec_id, embedding::DOUBLE[] AS e, 'n' || label AS namespace, label FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"
COSINE = "(1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))"
L2 = "list_distance(e, q)"


def _first(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {VECTORS} SELECT id, round({L2}, 6) AS distance FROM v, q ORDER BY {L2}, id LIMIT 10")
def knn_l2(spark, sf_dir):
    return V.nearest(vectors(spark, sf_dir), _first(spark, sf_dir), 10).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {VECTORS} SELECT id, round(1 - {COSINE} / 2, 6) AS score FROM v, q ORDER BY {COSINE}, id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return V.query(vectors(spark, sf_dir), _first(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} SELECT id, round(1 - {COSINE} / 2, 6) AS score FROM v, q ORDER BY {COSINE}, id LIMIT 10")
def knn_dot_as_cosine(spark, sf_dir):
    return V.query(vectors(spark, sf_dir), _first(spark, sf_dir), 10, "dot-product").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} SELECT id, round({L2}, 6) AS score FROM v, q ORDER BY {L2}, id LIMIT 5")
def knn_euclidean_score(spark, sf_dir):
    return V.query(vectors(spark, sf_dir), _first(spark, sf_dir), 5, "euclidean").select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), id) AS r FROM d) SELECT query_id, id, r::INTEGER AS rank FROM r WHERE r <= 10""")  # fmt: skip
def knn_batch(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 100, against all."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    near = V.batch_nearest(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("values")), 10, "vec_id", "embedding", digits=6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 6), "id"))
    return near.withColumn("rank", rank).filter("rank <= 10").select("query_id", "id", "rank")


def _post(where: str, k: int = 10) -> str:
    return f"WITH {VECTORS}, n AS (SELECT *, {COSINE} AS d FROM v, q ORDER BY d, id LIMIT 100) SELECT id, round(1 - d / 2, 6) AS score FROM n WHERE {where} ORDER BY d, id LIMIT {k}"


@query(_post("namespace = 'n3'"))
def knn_namespace_postfilter(spark, sf_dir):
    return V.query(vectors(spark, sf_dir), _first(spark, sf_dir), 10, namespace="n3").select("id", F.round("score", 6).alias("score"))


for _name, _spec, _where in [
    ("eq", {"label": 4}, "label = 4"), ("ne", {"kind": {"$ne": "k4"}}, "label <> 4"), ("in", {"label": {"$in": [1, 2, "3"]}}, "label IN (1, 2)"),
    ("nin", {"kind": {"$nin": ["k1", "k2"]}}, "label NOT IN (1, 2)"), ("range", {"n": {"$gte": 100, "$lt": 300}}, "vec_id >= 100 AND vec_id < 300"),
]:
    query(_post(_where), f"knn_filter_{_name}")(lambda spark, sf_dir, _s=_spec: V.query(vectors(spark, sf_dir), _first(spark, sf_dir), 10, where=compile_filter(_s)).select("id", F.round("score", 6).alias("score")))

for _name, _spec, _where in [
    ("eq", {"k": 7}, "k = 7"), ("range", {"k": {"$gt": 90}}, "k > 90"), ("in", {"k": {"$in": [1, 2, 3]}}, "k IN (1, 2, 3)"), ("ne", {"k": {"$ne": 5}}, "k IS NULL OR k <> 5"),
    ("null", {"missing": None}, "true"), ("text_is_no_number", {"k": "7"}, "false"), ("below_text", {"k": {"$lt": "a"}}, "k IS NOT NULL"),
]:
    query(f"WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT event_id FROM e WHERE {_where}", f"json_filter_events_{_name}")(lambda spark, sf_dir, _s=_spec: table(spark, sf_dir, "events").filter(compile_filter(_s, "props")).select("event_id"))



def _nested(spark, sf_dir) -> DataFrame:
    """Events with metadata of objects, lists and booleans."""
    n = F.col("event_id")
    inner = F.struct((n % 7).alias("b"), F.col("event_type").alias("kind"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(inner.alias("a"), (n % 2 == 0).alias("flag"), F.array(F.lit(1), n % 3).alias("list"), F.when(n % 5 == 0, n).alias("some"))).alias("metadata"))


for _name, _spec, _where in [
    ("dotted", {"a.b": 3}, "b = 3"), ("dotted_text_range", {"a.kind": {"$gte": "d"}}, "event_type >= 'd'"), ("several", {"a.b": {"$gte": 2, "$lt": 5}, "flag": False}, "b >= 2 AND b < 5 AND NOT flag"),
    ("boolean", {"flag": True}, "flag"), ("boolean_as_number", {"flag": {"$in": [1, 5]}}, "flag"), ("element", {"list[1]": 2}, "event_id % 3 = 2"), ("true_is_one", {"list[0]": True}, "true"),
    ("not_null", {"some": {"$ne": None}}, "event_id % 5 = 0"), ("missing_is_not_in", {"some": {"$nin": [5, 10]}}, "event_id NOT IN (5, 10)"), ("missing_is_in_no_range", {"some": {"$lte": 50}}, "event_id % 5 = 0 AND event_id <= 50"),
]:
    query(f"WITH e AS (SELECT event_id, event_type, event_id % 7 AS b, event_id % 2 = 0 AS flag FROM events) SELECT event_id FROM e WHERE {_where}", f"filter_{_name}")(lambda spark, sf_dir, _s=_spec: _nested(spark, sf_dir).filter(compile_filter(_s)).select("event_id"))


@query(f"WITH {VECTORS.replace('vec_id = 0', 'vec_id = 17')} SELECT id, round(1 - {COSINE} / 2, 6) AS score FROM v, q ORDER BY {COSINE}, id LIMIT 5")
def query_by_id(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return V.query(v, v.filter("id = '00000017'").select("values").first()[0]).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} SELECT id, namespace FROM v WHERE id IN ('00000003', '00000005', 'missing')")
def get_by_ids(spark, sf_dir):
    return vectors(spark, sf_dir).filter(F.col("id").isin("00000003", "00000005", "missing")).select("id", "namespace")


@query(f"WITH {VECTORS} SELECT id FROM v WHERE id > '00000041' ORDER BY id LIMIT 21")
def list_vectors_page(spark, sf_dir):
    return page(vectors(spark, sf_dir), 20, "00000041")


def _batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All vectors, and a batch of as many with twice their ids, each twice: some are in the table, others are not."""
    v = vectors(spark, sf_dir)
    doubled = F.lpad((2 * F.col("vec_id")).cast("string"), 8, "0").alias("id")
    batch = v.select(doubled, F.explode(F.array(F.lit(1), F.lit(2))).alias("take"), F.col("take").alias("pos"))
    return v.select("id", F.lit(0).alias("take")), batch


BATCH = f"WITH {VECTORS}, old AS (SELECT id, 0 AS take FROM v), new AS (SELECT lpad((2 * vec_id)::VARCHAR, 8, '0') AS id, t AS take FROM v, (VALUES (1), (2)) x(t))"


@query(f"{BATCH} SELECT id, take FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, max(take) FROM new GROUP BY id")
def upsert_last_wins(spark, sf_dir):
    old, batch = _batch(spark, sf_dir)
    return build.upsert(old, last_wins(batch).drop("pos"), "id")


@query(f"{BATCH} SELECT id, take FROM old UNION ALL SELECT id, min(take) FROM new WHERE id NOT IN (SELECT id FROM old) GROUP BY id")
def insert_first_wins(spark, sf_dir):
    old, batch = _batch(spark, sf_dir)
    return old.unionByName(first_wins(batch).drop("pos").join(old.select("id"), "id", "left_anti"))


@query(f"WITH {VECTORS} SELECT id FROM v WHERE vec_id % 7 <> 0")
def delete_by_ids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return build.delete(v.select("id"), v.filter("vec_id % 7 = 0").select("id"), "id")


# -- hybrid ------------------------------------------------------------------


def _hybrid(spark, sf_dir, text: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    found = FT.scan(c, text, k=None).withColumn("bm25", F.round("bm25", 12)).orderBy("bm25", "chunk_id").limit(20)
    joined = c.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    near = joined.withColumn("distance", V.l2(F.col("embedding"), _first(spark, sf_dir))).select("chunk_id", "content", "distance").orderBy("distance", "chunk_id").limit(30)
    return fuse(near, found).select("chunk_id", F.round("score", 6).alias("score"), "v_rank", "f_rank")


def _hybrid_sql(fts: str) -> str:
    return f"""WITH {CHUNKS}, f0 AS ({fts}), f AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) AS f_rank FROM f0),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
n AS (SELECT chunk_id, content, list_distance(embedding::DOUBLE[], q) AS d FROM c JOIN embeddings ON doc_id = vec_id, q ORDER BY d, chunk_id LIMIT 30),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS v_rank FROM n WHERE length(content) >= 100), s AS (SELECT count(*) > 0 AS any_f FROM f),
b AS (SELECT coalesce(v.chunk_id, f.chunk_id) AS chunk_id, v_rank, f_rank, any_f, CASE WHEN any_f THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS w FROM v FULL JOIN f ON v.chunk_id = f.chunk_id, s),
x AS (SELECT *, (coalesce(w / (60 + v_rank), 0) + coalesce((1 - w) / (60 + f_rank), 0)) * CASE WHEN v_rank IS NOT NULL AND f_rank IS NOT NULL THEN 1.5::DOUBLE WHEN f_rank IS NULL AND any_f THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM b)
SELECT chunk_id, round(score, 6) AS score, v_rank, f_rank FROM x ORDER BY x.score DESC, v_rank NULLS LAST, f_rank LIMIT 10"""


@query(_hybrid_sql(_fts_sql(["ther", "than"], "tf0 > 0 AND tf1 > 0", 20)))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "ther than")


@query(_hybrid_sql("SELECT 'x' AS chunk_id, 0.0::DOUBLE AS bm25 WHERE false"))
def hybrid_no_fts(spark, sf_dir):
    return _hybrid(spark, sf_dir, "what is ther?")


# -- documents ---------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT section AS doc_id, min(url) AS url, min(title) AS title, count(*) AS chunk_count FROM c GROUP BY section")
def list_documents(spark, sf_dir):
    return D.list_documents(chunks(spark, sf_dir).withColumn("doc_id", F.col("section")))


@query("SELECT count(*) AS chunk_count, count(DISTINCT doc_id) AS doc_count FROM documents")
def doc_counts(spark, sf_dir):
    return D.counts(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT chunk_id, url, content FROM c WHERE doc_id::VARCHAR = '/SRC3/1' OR url LIKE '%/src3/1%' OR url LIKE '%src3/1%'")
def read_document(spark, sf_dir):
    return D.document_chunks(chunks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")), "/SRC3/1").select("chunk_id", "url", "content")


LINKED = r"(SELECT page_id::VARCHAR AS doc_id, url, regexp_replace(html, '<a href=\"/([^\"]*)\"[^>]*>([^<]*)</a>', '[\2](\1)', 'g') AS content FROM pages)"


@query(rf"SELECT DISTINCT doc_id, url, url AS title FROM {LINKED} p WHERE translate(content, '{T.UPPER}', '{T.LOWER}') LIKE '%](that%' OR translate(content, '{T.UPPER}', '{T.LOWER}') LIKE '%](../that%' ORDER BY title, doc_id LIMIT 5")
def related_pages(spark, sf_dir):
    content = F.regexp_replace("html", r'<a href="/([^"]*)"[^>]*>([^<]*)</a>', r"[$2]($1)")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "url", F.col("url").alias("title"), content.alias("content"))
    return D.related_documents(p, "docs/THAT.md")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), f AS (SELECT * FROM l WHERE regexp_matches(line, '(?i)license') ORDER BY doc_id, n LIMIT 100) SELECT doc_id AS path, count(*) AS matches, min(n) AS first_line FROM f GROUP BY doc_id ORDER BY matches DESC, path LIMIT 10")
def grep_lines(spark, sf_dir):
    return D.grep(D.lines(table(spark, sf_dir, "documents"), "doc_id"), "license").select("path", "matches", "first_line")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM l WHERE regexp_matches(line, 'the')) SELECT doc_id AS path, n AS line_no, line FROM r WHERE r <= 2")
def grep_per_file_cap(spark, sf_dir):
    return D.grep_capped(D.lines(table(spark, sf_dir, "documents"), "doc_id"), "the", 2)


@query("WITH f AS (SELECT role AS chunk_id, min(conv_id * 1000 + turn) AS first_seq FROM conversations GROUP BY role) SELECT chunk_id, first_seq, row_number() OVER (ORDER BY first_seq, chunk_id) AS citation FROM f")
def citation_order(spark, sf_dir):
    return D.citations(table(spark, sf_dir, "conversations").select(F.col("role").alias("chunk_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))


@query("SELECT event_id FROM events WHERE ts::TIMESTAMP >= (SELECT max(ts)::TIMESTAMP FROM events) - INTERVAL 7 DAYS OR event_type LIKE 'click%'")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now: datetime = e.agg(F.max("ts")).first()[0]
    return build.retained(e, now, 7, "ts", "event_type", "click").select("event_id")


def _turns(spark, sf_dir) -> DataFrame:
    """Conversations as documents, a chunk a turn, below a heading for every two turns and one for the role."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"),
        F.array(F.concat(F.lit("Part "), F.floor(F.col("turn") / 2)), F.coalesce("role", F.lit("?"))).alias("headings"),
    )


TURNS = "t AS (SELECT conv_id AS doc_id, lpad(turn::VARCHAR, 6, '0') AS chunk_id, coalesce(text, '') AS content, 'Part ' || (turn // 2) AS part, coalesce(role, '?') AS role FROM conversations)"


@query(f"WITH {TURNS} SELECT doc_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_id, content) AS content, count(*) AS chunk_count FROM t GROUP BY doc_id")
def render_documents(spark, sf_dir):
    return D.render(_turns(spark, sf_dir))


@query(f"""WITH {TURNS}, p AS (SELECT *, lag(part) OVER w AS part0, lag(role) OVER w AS role0 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)),
b AS (SELECT *, CASE WHEN part0 IS DISTINCT FROM part THEN '# ' || part || chr(10) || chr(10) ELSE '' END || CASE WHEN part0 IS DISTINCT FROM part OR role0 <> role THEN '## ' || role || chr(10) || chr(10) ELSE '' END || content AS block FROM p),
h AS (SELECT doc_id, part AS title, chunk_id || '0' AS k FROM t UNION ALL SELECT doc_id, role, chunk_id || '1' FROM t), f AS (SELECT doc_id, title, min(k) AS k FROM h GROUP BY doc_id, title),
c AS (SELECT doc_id, string_agg(title || '#' || lower(replace(title, ' ', '-')), '|' ORDER BY k) AS contents FROM f GROUP BY doc_id)
SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY chunk_id) AS content, any_value(contents) AS contents FROM b JOIN c USING (doc_id) GROUP BY doc_id""")  # fmt: skip
def reading_pages(spark, sf_dir):
    """Documents with their headings put back, and their tables of contents."""
    contents = F.array_join(F.transform("contents", lambda c: F.concat_ws("#", c["title"], c["anchor"])), "|")
    return D.reading(_turns(spark, sf_dir)).select("doc_id", "content", contents.alias("contents"))


LINES = r"regexp_replace({}, '\n+', ' ', 'g')"


@query(rf"""WITH a AS (SELECT doc_id, text, instr(lower(text), 'license') - 1 AS place, {LINES.format("text")} AS flat, CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS more FROM documents)
SELECT doc_id, substr(text, 1, 200) || more AS snippet, substr(flat, 1, 200) || more AS line,
CASE WHEN place > 50 THEN '...' || regexp_replace({LINES.format("substr(text, place - 49, 200)")}, '^\s+|\s+$', '', 'g') ELSE regexp_replace(substr(flat, 1, 200), '^\s+|\s+$', '', 'g') END || more AS around FROM a""")  # fmt: skip
def snippets(spark, sf_dir):
    """The three kinds of snippet of every text."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(c).alias("snippet"), T.snippet_line(c).alias("line"), T.snippet_around(c, "License!").alias("around"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^\w\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug,
substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS file_name FROM documents""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"), T.sanitize_filename(F.col("text")).alias("file_name"))


@query("SELECT doc_id, 'https://x/' || source || '/' || doc_id || '/#part-' || lower(lang) AS link FROM documents")
def heading_links(spark, sf_dir):
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/"))
    return table(spark, sf_dir, "documents").select("doc_id", T.heading_url(path, F.array(F.lit("Top"), F.concat(F.lit("Part: "), F.col("lang"))), "https://x").alias("link"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text || ' see [' || doc_id || '] and (02), (77) or [1](x)', '\[(\d+)\]\(', chr(1) || '\1' || chr(2), 'g'), '\[(\d+)\]', '<a href="#ref-\1" class="citation-link">[\1]</a>', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\(0*([1-5])\)', '<a href="#ref-\1" class="citation-link">[\1]</a>', 'g') AS t FROM a) SELECT doc_id, regexp_replace(replace(replace(t, chr(1), '['), chr(2), ']('), '^\s+|\s+$', '', 'g') AS answer FROM b""")
def cited_answers(spark, sf_dir):
    """Texts as answers with five references: their citations become links, and a list at their end goes."""
    answer = F.concat(F.col("text"), F.lit(" see ["), F.col("doc_id"), F.lit("] and (02), (77) or [1](x)\n\n## References\n[1] one\n[2] two"))
    return table(spark, sf_dir, "documents").select("doc_id", T.cited(answer, 5).alias("answer"))


# -- chunking ----------------------------------------------------------------

WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"
TOKENS = "ceil(" + WORDS + " * 1.3::DOUBLE)::BIGINT"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENTENCES = r"list_filter(list_transform(regexp_extract_all({}, '[^.!?\n]+[.!?\n]+|[^.!?\n]+$'), lambda x: " + TRIM.format("x") + "), lambda x: x <> '')"
PARAGRAPHS = r"list_filter(list_transform(string_split_regex({}, '\n\s*\n'), lambda x: " + TRIM.format("x") + "), lambda x: x <> '')"


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, unnest({SENTENCES.format('text')}) AS sentence FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query(f"SELECT doc_id, unnest({PARAGRAPHS.format('text')}) AS paragraph FROM documents")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("paragraph"))


# no document has a blank line, so paragraphs pack to one unit; long ones go on to sentences
PACKED = rf"""d AS (SELECT doc_id, {TRIM.format('text')} AS t, {TOKENS.format('text')} AS whole FROM source),
short AS (SELECT doc_id, 0 AS part, t AS content, whole AS token_count FROM d WHERE whole <= 600 AND t <> ''),
u AS (SELECT doc_id, {SENTENCES.format('t')} AS units FROM d WHERE whole > 600),
p AS (SELECT doc_id, units, len(units) AS n, list_transform(range(0, len(units) + 1), lambda k: coalesce(list_sum(list_transform(units[1:k], lambda x: {TOKENS.format('x')})), 0)::BIGINT) AS s FROM u),
w AS (SELECT doc_id, 0 AS part, 0 AS b, greatest(1, list_max(list_filter(range(0, n + 1), lambda x: s[x + 1] <= 500))) AS e FROM p WHERE n > 0
  UNION ALL
  SELECT doc_id, part + 1, b2, greatest(e + 1, list_max(list_filter(range(b2, n + 1), lambda x: s[x + 1] - s[b2 + 1] <= 500))) FROM
    (SELECT w.doc_id, part, e, n, s, coalesce(list_min(list_filter(range(b, e), lambda j: s[e + 1] - s[j + 1] <= 80)), e) AS b2 FROM w JOIN p USING (doc_id) WHERE e < n)),
o AS (SELECT doc_id, part, array_to_string(units[b + 1:e], chr(10) || chr(10)) AS content, s[e + 1] - s[b + 1] AS token_count FROM w JOIN p USING (doc_id)),
z AS (SELECT doc_id, part, content, token_count::BIGINT AS token_count, substr(sha256(content), 1, 16) AS content_hash FROM (SELECT * FROM short UNION ALL SELECT * FROM o))"""


@query(f"WITH RECURSIVE source AS (SELECT doc_id, text FROM documents), {PACKED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS idx, content, token_count, content_hash FROM z")
def pack_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("section_no"), F.col("text").alias("content"))
    return chunk_sections(d, ["doc_id"]).drop("section_no")


@query(f"""WITH RECURSIVE source AS (SELECT conv_id * 100000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations), {PACKED}
SELECT doc_id // 100000 AS conv_id, doc_id % 100000 AS turn, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id, part) - 1 AS idx, content, token_count, content_hash FROM z""")  # fmt: skip
def pack_sections(spark, sf_dir):
    """Chunks of documents with several sections: a conversation's turns, numbered through."""
    d = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("text", F.lit("")).alias("content"))
    return chunk_sections(d, ["conv_id"], section_no="turn")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, 'doc_' || substr(sha256(source || '/' || doc_id || '.md'), 1, 8) || '_' || substr(sha256(text), 1, 8) AS id FROM documents")
def doc_ids(spark, sf_dir):
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_id(path, T.content_hash(F.col("text"))).alias("id"))


@query("SELECT doc_id, 'chk_' || substr(sha256(source || '/' || doc_id || '.md'), 1, 8) || '_' || substr(sha256(source || '||' || lang), 1, 4) || '_3_' || substr(sha256(text), 1, 6) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    path, h = F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".md"))), T.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(T.doc_id(path, h), F.array("source", "lang"), F.lit(3), h).alias("id"))


@query("SELECT doc_id, '/' || source || '/' || doc_id || '/' AS url, source AS section FROM documents")
def page_urls(spark, sf_dir):
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/_index.md"))
    return table(spark, sf_dir, "documents").select("doc_id", T.url(path, "docs").alias("url"), T.section(path, "docs").alias("section"))


def _hash_sql() -> str:
    """The hash as a sum of units times powers of 31, which are products of four powers from lists of 64."""
    wrap = 1 << 32
    factor = lambda k: f"([{', '.join(str(pow(31, d * 64**k, wrap)) for d in range(64))}])[((len(u) - i) // {64**k}) % 64 + 1]::HUGEINT"
    power = factor(0)
    for k in range(1, 4):
        power = f"({power} * {factor(k)}) % {wrap}"
    units = "flatten(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN [55296 + (unicode(x) - 65536) // 1024, 56320 + (unicode(x) - 65536) % 1024] ELSE [unicode(x)] END))"
    total = f"coalesce(list_sum(list_transform(u, lambda x, i: (x * ({power})) % {wrap})), 0)::HUGEINT"
    return f"u AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE {units} END AS u FROM documents), h AS (SELECT doc_id, ((({total} + {wrap >> 1}) % {wrap}) - {wrap >> 1})::BIGINT AS h FROM u)"


@query(f"WITH {_hash_sql()} SELECT doc_id, h FROM h")
def mock_embedding_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.java_hash(F.col("text")).alias("h"))


@query(f"""WITH {_hash_sql()}, r AS (SELECT doc_id, list_transform(range(0, 64), lambda j: sin((h + j)::DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE) AS v FROM h)
SELECT doc_id, unnest(range(0, 64))::INTEGER AS j, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM r""")  # fmt: skip
def mock_embedding(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.mock_embedding(F.col("text"), 64)).alias("j", "x")).withColumn("x", F.round("x", 6))


# -- builds ------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), o AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change FROM n FULL JOIN o ON n.path = o.path""")  # fmt: skip
def incremental_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    old = d.filter("path % 3 <> 0").withColumn("content_hash", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return build.diff(old, d.filter("path % 5 <> 0"))


@query("SELECT DISTINCT substr(sha256(text), 1, 16) AS content_hash, text AS content FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def cache_miss(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("content"))
    return build.cache_misses(d, d.filter("doc_id % 2 = 0").select(F.lit("mock").alias("model"), "content_hash"), "mock")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
