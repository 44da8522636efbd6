import math

import pytest

from quarry.agent import loop
from quarry.agent.tools import query_index, registry
from quarry.plans.index import build, opened, state
from quarry.streaming.updates import follow


def mock(text: str, dim: int = 8) -> list[float]:
    h = 0
    for c in text:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    raw = [0.5 * math.sin(h + j) + 0.5 for j in range(dim)]
    return [x / math.sqrt(sum(y * y for y in raw)) for x in raw]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    (root / "content" / "guide").mkdir(parents=True)
    (root / "content" / "guide" / "one.md").write_text("---\ntitle: One\n---\n# Start\nalpha words, see [two](two.md)\n## More\nbeta")
    (root / "content" / "two.md").write_text("# Two\nalpha gamma ADT^A04")
    return root


def rows(index) -> dict:
    return {r.chunk_id: r for r in index.chunks.collect()}


def test_build_update_and_tools(spark, place):
    content, folder = f"file://{place}/content", f"file://{place}/index"
    assert opened(spark, folder) is None
    first = build(spark, content, folder, dimension=8, content_copy=True, config={"baseUrl": "https://x/"})
    assert first.manifest["doc_count"] == 2 and first.manifest["chunk_count"] == 3
    assert all(r.embedding == pytest.approx(mock(r.content), abs=1e-6) for r in rows(first).values())

    tools = registry(first, mock)
    assert tools["search_fts"](query="alpha gamma").chunks[0]["title"] == "two"
    assert "URL: https://x/two/" in tools["search_literal"](query="adt^a04").text
    assert tools["search_hybrid"](query="beta", k=2).chunks and not tools["search_hybrid"](query="beta").is_error
    assert "Chunks: 2" in tools["read_document"](doc_id="/guide/one/").text and tools["read_document"](doc_id="none").is_error
    assert "1. One" in tools["find_related"](path="two.md").text
    assert tools["list_documents"]().text.startswith("2 documents indexed:\n\nOne (2 chunks)")
    assert tools["search_grep"](pattern="be.a").text == "guide/one.md:7:beta"
    assert tools["search_fts"](query="none").text == "No results found."
    for bad in ({"query": "a", "k": 51}, {"query": "a", "k": 0}, {}, {"query": "a", "x": 1}):
        assert tools["search_fts"](**bad).is_error

    (place / "content" / "two.md").write_text("---\ndraft: true\n---\n# Two\nnot yet")
    (place / "content" / "three.txt").write_text("delta")
    second = build(spark, content, folder, dimension=8)
    before, after = rows(first), rows(second)
    assert sorted(r.path for r in after.values()) == ["guide/one.md", "guide/one.md", "three.txt"]
    assert {k: v for k, v in after.items() if k in before} == {k: v for k, v in before.items() if v.path == "guide/one.md"}
    assert second.table("tracking").count() == 3 and opened(spark, folder).manifest["version"] == 2
    third = build(spark, content, folder, dimension=8, drafts=True, clean=True)
    assert third.manifest["doc_count"] == 3 and not third.has_lines


def test_stream_brings_the_index_up_to_date(spark, tmp_path):
    (tmp_path / "content").mkdir()
    (tmp_path / "content" / "a.md").write_text("# A\none")
    where = [f"file://{tmp_path}/{x}" for x in ("content", "index", "checkpoint")]
    follow(spark, *where, once=True, dimension=8).awaitTermination()
    (tmp_path / "content" / "b.md").write_text("# B\ntwo")
    follow(spark, *where, once=True, dimension=8).awaitTermination()
    index = opened(spark, where[1])
    assert index.manifest["version"] == 2 and sorted(r.content for r in index.chunks.collect()) == ["one", "two"]


CHUNK = {"chunk_id": "c", "doc_id": "d", "title": "T", "url": "/u/", "headings": ["H"], "content": "text", "score": 0.5}


def tools(found=True):
    from quarry.agent.tools import Argument, Result, Tool

    run = lambda query, k: Result("text", chunks=[CHUNK] if found else [])
    return {"search_fts": Tool("search_fts", "", {"query": Argument(str), "k": Argument(int, 10, 1, 50)}, run)}


def events(replies, **kwargs):
    replies = iter(replies)
    return list(loop.answer("What is it?", tools(**kwargs), lambda m: [next(replies)]))


def test_agent_loop():
    call = '```tool\n{"tool": "search_fts", "query": "q"}\n```'
    out = events([call, "so\nFINAL: yes [1]"])
    assert [e["type"] for e in out] == ["start", "thinking", "tool_result", "tool_call", "tool_result", "token", "done"]
    assert out[-2]["content"] == "yes [1]" and out[-1]["references"] == [{"n": 1, "title": "T", "url": "/u/", "headings": ["H"]}]
    out = events(["FINAL: a", "b", "FINAL: c"])  # sent back twice, then a search is made for it
    assert [e["content"] for e in out if e["type"] == "token"] == ["c"] and sum(e["type"] == "tool_call" for e in out) == 1
    out = events([call] * 5 + ["no marker"])
    assert out[-2]["content"] == "no marker"
    assert events([call] * 5, found=False)[-1]["type"] == "error"
    assert loop.tool_calls('x {"tool": "a", "query": "b"} {"tool": "a"}') == [{"tool": "a", "query": "b"}]
    assert loop.final_answer("a\n final: ```\nb\n```") == "b" and loop.final_answer("a FINAL: b") is None
    assert loop.presearch_query("What is a hash?") == "hash" and loop.presearch_query("?") == ""


def test_vectors_outlive_clean_and_stopped_builds(spark, tmp_path):
    (tmp_path / "content").mkdir()
    (tmp_path / "content" / "a.md").write_text("# A\n" + "alpha " * 60)
    (tmp_path / "content" / "b.md").write_text("# B\nbeta")
    content, folder = f"file://{tmp_path}/content", f"file://{tmp_path}/index"
    assert state(spark, folder) == "none"
    lines = []
    first = build(spark, content, folder, dimension=8, report=lines.append)
    assert lines[0] == "2 files, all new" and lines[1].startswith("2 texts embedded") and lines[2] == "2 documents with 2 chunks"
    (tmp_path / "content" / "c.md").write_text("# C\nbeta")

    def given(**kwargs):
        lines.clear()
        made = build(spark, content, folder, report=lines.append, **kwargs)
        return made, lines[1].split()[0]

    made, embedded = given(dimension=8)
    assert lines[0] == "1 new, 2 unchanged" and embedded == "0" and made.manifest["chunk_count"] == 3
    made, embedded = given(dimension=8, clean=True)
    assert embedded == "0" and {r.content_hash: r.embedding for r in made.chunks.collect()} == {r.content_hash: r.embedding for r in first.chunks.collect()}
    assert given(dimension=4)[1] == "2" and given(dimension=8)[1] == "0"

    import shutil

    shutil.rmtree(tmp_path / "index" / "manifest")  # as if the first build had stopped before its end
    assert state(spark, folder) == "partial"
    made, embedded = given(dimension=8)
    assert embedded == "0" and state(spark, folder) == "complete"

    best = query_index(made, mock, "alpha", 2)[0]
    assert best["title"] == "a" and len(best["content"]) == 203 and best["content"].endswith("...")
    tools = registry(made, mock)
    assert tools["search_fts"](query="alpha").chunks[0]["badge"].startswith("FTS[F1] (")
    assert tools["search_literal"](query="alpha").chunks[0]["badge"] == "LIT[#1] (60.0000)"
    assert tools["search_hybrid"](query="alpha").chunks[0]["badge"].startswith("HYB[V1/F1] (")
