import io
import json
import os
import time

import quarry
from quarry.agent.loop import presearch_query
from quarry.agent.mcp import MANIFEST, Server
from quarry.agent.server import Logs
from quarry.agent.tools import Argument, Result, Tool

TOOLS = {t.name: t for t in [
    Tool("search_fts", "Chunks.", {"query": Argument(str), "k": Argument(int, 10, 1, 50)}, lambda query, k: Result(f"{query} {k}")),
    Tool("list_documents", "All.", {}, lambda: Result("none", True)),
]}


def talk(*messages):
    out = io.StringIO()
    lines = [m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages]
    Server({"project_name": "Test Docs", "doc_count": 2}, TOOLS).serve(lines, out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_protocol():
    hello, listed, called, bad, none, resource, read, lost, method, parse = talk(
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search_fts", "arguments": {"query": "ADT^A04"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search_fts", "arguments": {"query": "x", "k": 51}}},
        {"id": 5, "method": "tools/call", "params": {"name": "missing"}},
        {"id": 6, "method": "resources/list"},
        {"id": 7, "method": "resources/read", "params": {"uri": MANIFEST}},
        {"id": 8, "method": "resources/read", "params": {"uri": "index://x"}},
        {"id": "nine", "method": "nothing"},
        "{",
    )
    assert hello["result"]["protocolVersion"] == "2024-11-05" and hello["result"]["serverInfo"]["name"] == "quarry-test-docs"
    assert [t["name"] for t in listed["result"]["tools"]] == ["search_fts", "list_documents"]
    assert listed["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    assert listed["result"]["tools"][0]["inputSchema"]["properties"]["k"] == {"type": "integer", "default": 10, "minimum": 1, "maximum": 50}
    assert called["result"] == {"content": [{"type": "text", "text": "ADT^A04 10"}], "isError": False}
    assert bad["result"]["isError"] and none["error"]["code"] == -32602
    assert resource["result"]["resources"][0]["uri"] == MANIFEST and json.loads(read["result"]["contents"][0]["text"])["doc_count"] == 2
    assert lost["error"]["code"] == -32602 and method["id"] == "nine" and method["error"]["code"] == -32601 and parse["error"]["code"] == -32700


def test_old_logs_go(tmp_path):
    for name, days in (("a.json", 8), ("b.json", 6), ("reported-c.json", 80)):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (time.time() - days * 86_400,) * 2)
    assert Logs(str(tmp_path)).clear() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["b.json", "reported-c.json"]
    assert Logs(str(tmp_path / "missing")).clear() == 0


def test_questions_lose_their_opening():
    for question, want in [("What is a chunk?", "chunk"), ("When do builds run?", "do builds run"), ("why", "why"), ("How can the index grow", "the index grow"), ("Tell me about an index.", "index"), ("is?", "is"), ("A", "")]:
        assert presearch_query(question) == want


def test_public_names():
    for name in quarry.__all__:
        assert callable(getattr(quarry, name))
