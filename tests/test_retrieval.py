import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import documents as D
from quarry.operators import fulltext as FT
from quarry.operators import vectors as V
from quarry.operators.chunking import windows
from quarry.operators.filters import FilterError, compile_filter
from quarry.operators.hybrid import fuse
from quarry.operators.vector_index import VectorIndex

CHUNK = "chunk_id string, doc_id string, url string, title string, section string, tags array<string>, content string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("ch_reg_1", "doc_reg", "/f/reg/", "Patient Registration", "Overview", ["registration"], "How a patient registration starts."),
        ("ch_reg_2", "doc_reg", "/f/reg/", "Patient Registration", "HL7 Interface", ["registration", "hl7"], "The ADT^A04 message, foo_bar, café."),
        ("ch_sched_1", "doc_sched", "/f/sched/", "Scheduling", "Appointments", ["scheduling"], "Appointments; foo x bar. See [reg](reg.md)."),
    ]
    return spark.createDataFrame(rows, CHUNK)


QUERIES = ["registration", "patient OR appointments", "registration NOT hl7", "foo_bar", "CAFE", "foo + bar", "patient registration starts", "what is it?", "AND", "x OR registration NOT hl7 appointments", "or"]


@pytest.mark.parametrize("text", QUERIES)
def test_full_text_equals_fts5(chunks, text):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id, title, section, content, tags)")
    for r in chunks.collect():
        db.execute("INSERT INTO f VALUES (?, ?, ?, ?, ?)", (r.chunk_id, r.title, r.section, r.content, " ".join(r.tags)))
    try:
        want = db.execute("SELECT chunk_id, bm25(f) FROM f WHERE f MATCH ? ORDER BY 2, 1", (text,)).fetchall()
    except sqlite3.OperationalError:
        want = []
    index = FT.indexed(chunks)
    got = [(r.chunk_id, r.bm25) for r in FT.search(FT.postings(index), FT.statistics(index), text).collect()]
    assert sorted(x[0] for x in got) == sorted(x[0] for x in want)
    assert {k: round(v, 6) for k, v in got} == {k: round(v, 6) for k, v in want}


def test_strict_query_raises(chunks):
    index = FT.indexed(chunks)
    with pytest.raises(FT.QueryError):
        FT.search(FT.postings(index), FT.statistics(index), "a, b", strict=True)


def test_literal_and_documents(chunks):
    assert [r.chunk_id for r in D.literal_search(chunks, "adt^a04").collect()] == ["ch_reg_2"]
    assert D.literal_search(chunks, "  ").count() == 0
    assert D.document_chunks(chunks, "doc_reg").count() == 2 and D.document_chunks(chunks, "/F/REG").count() == 2
    assert [tuple(r) for r in D.list_documents(chunks).select("doc_id", "chunk_count").collect()] == [("doc_reg", 2), ("doc_sched", 1)]
    assert [r.doc_id for r in D.related_documents(chunks, "x/reg.md").collect()] == ["doc_sched"]
    assert D.render(chunks.filter("doc_id = 'doc_reg'")).first().content.count("---") == 1


def test_short_chunks_leave_the_vector_side(spark, chunks):
    near = chunks.select("chunk_id", "content", F.lit(0.1).alias("distance"))
    found = spark.createDataFrame([("ch_reg_1", -1.0)], "chunk_id string, bm25 double")
    assert [(r.chunk_id, r.v_rank) for r in fuse(near, found).collect()] == [("ch_reg_1", None)]
    assert fuse(near, found.limit(0)).count() == 0


def test_windows_equal_the_loop(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(1, 40) for _ in range(rng.randint(0, 25))], 60, 20) for i in range(200)]

    def loop(units, most, overlap):
        out, s, e, total = [], 0, 0, 0
        for n in units:
            if total + n > most and e > s:
                out.append((s, e, total))
                keep, kept = 0, 0
                for x in reversed(units[s:e]):
                    if kept + x > overlap:
                        break
                    keep, kept = keep + 1, kept + x
                s, total = e - keep, kept
            e, total = e + 1, total + n
        return out + ([(s, e, total)] if e > s else [])

    df = spark.createDataFrame([(i, u) for i, u, _, _ in rows], "i int, u array<bigint>")
    got = {r.i: [tuple(w) for w in r.w] for r in df.select("i", windows(F.col("u"), 60, 20).alias("w")).collect()}
    assert got == {i: loop(u, m, o) for i, u, m, o in rows}


META = ['{"a":true}', '{"a":1}', '{"a":"1"}', '{"a":null}', "{}", None, '{"a":{"b":2}}', '{"a.b":2}', '{"a":1.5}', '{"a":"x"}', '{"a":[5,6]}']
CASES = [
    ({"a": True}, [1, 2]), ({"a": 1}, [1, 2]), ({"a": "1"}, [3]), ({"a": None}, [4, 5, 6, 8]), ({"a": {"$ne": None}}, [1, 2, 3, 7, 9, 10, 11]),
    ({"a": {"$ne": 1}}, [3, 4, 5, 6, 7, 8, 9, 10, 11]), ({"a": {"$in": [1, "x"]}}, [1, 2, 10]), ({"a": {"$nin": [1, "x"]}}, [3, 4, 5, 6, 7, 8, 9, 11]),
    ({"a.b": 2}, [7]), ({"a": {"$gt": 1, "$lt": 2}}, [9]), ({"a": {"$lt": "abc"}}, [1, 2, 3, 9, 11]), ({"a": {"$gte": "x"}}, [7, 10]),
]


@pytest.mark.parametrize("spec,want", CASES, ids=lambda x: json.dumps(x))
def test_filters_keep(spark, spec, want):
    df = spark.createDataFrame([(i + 1, m) for i, m in enumerate(META)], "id int, metadata string")
    assert sorted(r.id for r in df.filter(compile_filter(spec)).collect()) == want


@pytest.mark.parametrize("spec", [{}, [], {"$bad": 1}, {"a": {"$gt": 1, "$eq": 5}}, {"a": "x" * 3000}, {"a": {"$in": []}}, {"a": {"$gt": True}}, {"a": {"$gt": 1, "x": 1}}, {'a"': 1}])
def test_filters_refuse(spec):
    with pytest.raises(FilterError):
        compile_filter(spec)


def test_vector_index(spark, tmp_path):
    embed = lambda texts: [[1.0, 0, 0, 0] if t == "hello" else [0, 1.0, 0, 0] for t in texts]
    index = VectorIndex(spark, f"file://{tmp_path}/i", 4, embedder=embed)
    e = lambda k: [float(j == k) for j in range(4)]
    assert index.insert([{"id": "a", "values": e(0), "metadata": {"tag": "x"}}, {"id": "b", "values": e(1), "namespace": "n"}]).count == 2
    assert index.insert([{"id": "a", "values": e(3)}, {"id": "c", "text": "other"}, {"id": "c", "values": e(2)}]).ids == ("c",)
    top = index.query(e(0), 2).collect()
    assert top[0].id == "a" and top[0].score > 0.9 and len(top) == 2
    assert [r.id for r in index.query("hello", 1, filter={"tag": "x"}).collect()] == ["a"]
    assert [r.id for r in index.query(e(0), namespace="n").collect()] == ["b"]
    index.upsert([{"id": "a", "values": e(2), "metadata": {"tag": "new"}}])
    assert [r.metadata for r in index.get_by_ids(["a"]).collect()] == ['{"tag": "new"}']
    assert index.query_by_id("b", top_k=1).first().id == "b" and index.query_by_id("none").count() == 0
    first = index.list_vectors(2)
    assert first["ids"] == ["a", "b"] and first["is_truncated"] and index.list_vectors(2, first["cursor"])["ids"] == ["c"]
    assert index.delete_by_ids(["a", "missing"]).ids == ("a",)
    for bad in (lambda: index.upsert([{"id": "z", "values": [1, 2]}]), lambda: index.query(e(0), 200), lambda: index.query(e(0), 80, return_values=True), lambda: VectorIndex(spark, f"file://{tmp_path}/i", 8)):
        with pytest.raises(ValueError):
            bad()
    for k in range(10):
        index.create_metadata_index(f"p{k}", "string")
    with pytest.raises(ValueError):
        index.create_metadata_index("p10", "string")
    assert index.describe()["vectors_count"] == 2


def test_urls_and_hashes(spark):
    df = spark.createDataFrame([("docs/a/_index.md",), ("docs/x.xml",), ("_index.md",), ("docs/a/b.PDF",)], "p string")
    assert [r[0] for r in df.select(T.url(F.col("p"), "docs")).collect()] == ["/a/", "/x.xml/", "/_index/", "/a/b/"]
    assert spark.range(1).select(T.java_hash(F.lit("hello"))).first()[0] == 99162322
    assert spark.range(1).select(T.slugify(F.lit(" What's New? A - b "))).first()[0] == "whats-new-a-b"


def test_batch_nearest_equals_single(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(6)]) for i in range(80)], "id int, values array<double>")
    got = V.batch_nearest(df, df.filter("id < 3").withColumnRenamed("id", "query_id"), 5).collect()
    for q in df.filter("id < 3").collect():
        want = [r.id for r in V.nearest(df, q["values"], 5).collect()]
        assert [r.id for r in sorted(got, key=lambda r: (r.distance, r.id)) if r.query_id == q.id] == want


def test_batch_nearest_ties_and_blocks(spark):
    from quarry.operators import vectors as V

    rows = [(i, [1.0, 2.0]) for i in range(40, 0, -1)] + [(100, [5.0, 5.0])]
    v = spark.createDataFrame(rows, "id bigint, values array<double>").coalesce(1)
    q = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "query_id bigint, values array<double>")
    got = {(r.query_id, r.id) for r in V.batch_nearest(v, q, 10, digits=6, block=2).collect()}
    assert got == {(i, j) for i in range(5) for j in range(1, 11)}


def test_accents_are_folded_as_fts5_folds_them(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).isalpha()]
    texts = [f"x{c}y" for c in letters] + ["re\u0301sume\u0301", "n\u0303o", "\u01d5", "\u1ed9z"]
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    want = dict(db.execute("SELECT doc, term FROM v").fetchall())
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.terms(F.col("t")).alias("t")).collect()}
    other = {texts[i]: (got[i], want.get(i)) for i in range(len(texts)) if got[i] != [want.get(i)]}
    assert not {t for t in other if t in texts[-4:]} and len(other) < 30, other


@pytest.mark.parametrize("text", QUERIES)
def test_scan_equals_postings(chunks, text):
    index = FT.indexed(chunks)
    rows = lambda x: [(r.chunk_id, round(r.bm25, 9)) for r in x.collect()]
    assert rows(FT.scan(chunks, text)) == rows(FT.search(FT.postings(index), FT.statistics(index), text))


def test_test_vectors_of_whole_texts(spark):
    import math
    import time

    def hashed(text):
        h, units = 0, text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + units[k] * 256 + units[k + 1] + 2**31) % 2**32 - 2**31
        return h

    texts = ["", "a", "\U0001f600", "x\U0001f600é", *(f"{i} " + "word " * 400 for i in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(T.java_hash(F.col("t")).alias("h")).collect()] == [hashed(t) for t in texts]
    assert hashed("\U0001f600") == 1772899
    rows = df.select(T.mock_embedding(F.col("t"), 64).alias("v"))
    rows.collect()
    began = time.perf_counter()
    got = [r.v for r in rows.collect()]
    assert time.perf_counter() - began < 5
    for t, v in zip(texts, got):
        raw = [math.sin(hashed(t) + j) * 0.5 + 0.5 for j in range(64)]
        norm = math.sqrt(sum(x * x for x in raw))
        assert v == pytest.approx([x / norm for x in raw])


def test_load_tables_into_a_vector_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"), 2)
    rows = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 1), ("a", [1.0, 1.0], 2)], "id string, values array<double>, pos int")
    assert index.load(rows) == 2
    before = index.vectors
    assert {r.id: list(r["values"]) for r in before.collect()} == {"a": [1.0, 1.0], "b": [0.0, 1.0]}
    assert index.load(rows.withColumn("id", F.concat("id", F.lit("2"))).unionByName(rows), replace=False) == 2
    assert before.count() == 2 and index.vectors.count() == 4
    assert {r.id: list(r["values"]) for r in index.vectors.collect()}["a2"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        index.load(spark.createDataFrame([("c", [1.0])], "id string, values array<double>"))
