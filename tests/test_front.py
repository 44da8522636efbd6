"""Command line, HTTP server, and clients against a small server of this process."""

import io
import json
import threading
import urllib.error
import urllib.request
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.agent import models, server
from quarry.agent.tools import registry
from quarry.functions import embedders
from quarry.plans import index as I


@contextmanager
def running(made):
    threading.Thread(target=made.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{made.server_address[1]}"
    finally:
        made.shutdown()
        made.server_close()


class Fake(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_POST(self):
        given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, out = 200, b""
        if self.path == "/embeddings":
            out = json.dumps({"data": [{"index": n, "embedding": [float(len(t)), 1.0]} for n, t in reversed(list(enumerate(given["input"])))]}).encode()
        elif self.path == "/api/embeddings":
            if given["model"] == "none":
                status, out = 404, b"not found"
            elif len(given["prompt"]) > 60:
                status, out = 500, b"exceeds the context length"
            else:
                out = json.dumps({"embedding": [float(len(given["prompt"]))]}).encode()
        elif self.path == "/chat/completions":
            out = b'data: {"choices": [{"delta": {"content": "FINAL: "}}]}\n\ndata: {"choices": [{"delta": {"content": "yes"}}]}\n\ndata: [DONE]\n\n'
        elif self.path == "/api/chat":
            out = b'{"message": {"content": "a"}}\n{"message": {"content": "b"}, "done": true}\n'
        self.send_response(status)
        self.end_headers()
        self.wfile.write(out)


def test_clients(spark, monkeypatch):
    with running(ThreadingHTTPServer(("127.0.0.1", 0), Fake)) as url:
        assert embedders.RemoteEmbedder("m", 2, url).embed(["a" * n for n in range(250)]) == [[float(n), 1.0] for n in range(250)]
        assert embedders.LocalEmbedder("m", 1, url=url).embed(["x" * 200, "yy"]) == [[50.0], [2.0]]
        with pytest.raises(embedders.ModelMissing):
            embedders.LocalEmbedder("none", url=url).embed(["x"])
        with pytest.raises(ValueError):
            embedders.LocalEmbedder("m", 1, url=url).embed(["x" * 10_000])
        monkeypatch.setenv("OPENAI_BASE_URL", url)
        monkeypatch.setenv("OPENAI_API_KEY", "k")
        monkeypatch.setenv("OLLAMA_HOST", url)
        assert "".join(models.by_name("gpt-x")([])) == "FINAL: yes"
        assert "".join(models.by_name("ollama:any")([])) == "ab"
        df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
        got = df.select("t", embedders.as_column("text-embedding-any", 2)(F.col("t")).alias("e")).collect()
        assert {r.t: r.e for r in got} == {"abc": [3.0, 1.0], None: None, "": [0.0, 1.0]}
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(ValueError):
        list(models.by_name("gpt-x")([]))


def test_shortened_and_dimensions():
    assert embedders.shortened("x" * 10, 512) == "x" * 10
    assert len(embedders.shortened("x" * 9000, 512)) == 1638
    assert embedders.shortened(("x" * 1599 + " ") * 2, 512) == "x" * 1599
    assert [embedders.dimension_of(m) for m in ("mock", "ollama:all-minilm", "ollama:other", "bge-m3", "text-embedding-any")] == [64, 384, 768, 1024, 1536]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    (root / "guide").mkdir()
    (root / "guide" / "start.md").write_text("---\ntitle: Start\n---\n# One\n\nAlpha words here.\n\n## Two\n\nBeta words there.\n")
    (root / "end.md").write_text("# End\n\nGamma ADT^A04 closes.\n")
    return root, I.build(spark, str(root), str(root / ".quarry"))


def get(url: str, body: dict | None = None) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode())) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def test_server(built, tmp_path):
    root, index = built
    said = ['```tool\n{"tool": "search_fts", "query": "alpha"}\n```', "FINAL: It is alpha [1]"] * 2
    replies = iter(said)
    logs = server.Logs(str(tmp_path))
    made = server.server(index, registry(index), lambda m: [next(replies)], 0, suggested=["Why?"], content=str(root), logs=logs)
    with running(made) as url:
        assert json.loads(get(f"{url}/health")[1])["documents"] == 2
        assert json.loads(get(f"{url}/examples")[1]) == {"examples": ["Why?"]}
        assert json.loads(get(f"{url}/browse")[1])["guide"]["children"]["start"]["title"] == "Start"
        assert get(f"{url}/guide/start.md")[1].decode() == "# Start\n\n# One\n\nAlpha words here.\n\n## Two\n\nBeta words there."
        assert get(f"{url}/file/end.md")[1] == (root / "end.md").read_bytes()
        assert get(f"{url}/file/..%2F..%2Fetc%2Fpasswd")[0] == 404 and get(f"{url}/none")[0] == 404
        assert get(f"{url}/ask")[0] == 400 and get(f"{url}/ask", [])[0] == 400
        got = json.loads(get(f"{url}/ask", {"question": "Tell me"})[1])
        assert got["answer"] == "It is alpha [1]" and got["references"][0]["n"] == 1
        events = [json.loads(x[6:]) for x in get(f"{url}/ask/stream?q=Tell+me")[1].decode().split("\n\n") if x]
        assert events[0]["type"] == "start" and events[-1]["type"] == "done"
        name, token = events[0]["debugFile"], events[0]["reportToken"]
        assert [get(f"{url}/report", b)[0] for b in ({}, {"debugFile": "../x", "reportToken": token}, {"debugFile": name, "reportToken": "no"})] == [400, 404, 403]
        assert get(f"{url}/report", {"debugFile": name, "reportToken": token, "comment": "bad"})[0] == 200
        assert json.loads((tmp_path / f"reported-{name}").read_text())["reported"]["comment"] == "bad" and not (tmp_path / name).exists()


def test_build_and_query(built, spark, tmp_path, capsys, monkeypatch):
    root, _ = built
    monkeypatch.chdir(tmp_path)
    assert main(["build", "-c", str(root), "-o", str(tmp_path / "ix")], spark) == 0
    assert json.loads(capsys.readouterr().out)["doc_count"] == 2
    for mode, text in (("fts", "gamma"), ("literal", "ADT^A04"), ("vector", "gamma"), ("hybrid", "gamma")):
        assert main(["query", text, "--mode", mode, "--index", str(tmp_path / "ix")], spark) == 0
        assert "Gamma ADT^A04" in capsys.readouterr().out
    assert main(["query", "x", "--index", str(tmp_path / "none")], spark) == 1


def test_search_by_line_and_grep(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\nalpha\nbeta alpha")
    where = ["-c", str(tmp_path / "docs"), "-o", str(tmp_path / "ix")]
    assert main(["build", *where, "--copy-content"], spark) == 0
    assert "building a first index" in capsys.readouterr().err
    monkeypatch.setattr("sys.stdin", io.StringIO("\nalpha\n:grep\nAL.HA\n[\n:quit\nnever\n"))
    assert main(["query", "--mode", "fts", "--index", str(tmp_path / "ix")], spark) == 0
    got = capsys.readouterr()
    assert "--- Result 1" in got.out and "a.md (2 matches)\n  2: alpha\n  3: beta alpha" in got.out and "not a pattern" in got.err
    assert main(["build", *where], spark) == 0 and "up to date" in capsys.readouterr().err
    assert main(["query", "x", "--mode", "grep", "--index", str(tmp_path / "ix")], spark) == 1


def test_vectors(spark, tmp_path, capsys):
    def run(*args):
        status = main(["vectors", "--dir", str(tmp_path), *args], spark)
        return json.loads(capsys.readouterr().out) if status == 0 else None

    assert run("info", "a") is None
    assert run("create", "a", "--dimensions", "2", "--metric", "euclidean")["vectors_count"] == 0
    (tmp_path / "v").write_text('{"id": "x", "values": [1, 0], "metadata": {"k": 1}}\n\n{"id": "y", "values": [0, 1]}\n')
    assert run("insert", "a", "--file", str(tmp_path / "v"))["ids"] == ["x", "y"]
    assert run("upsert", "a", "--file", str(tmp_path / "v"))["count"] == 2
    assert [m["id"] for m in run("query", "a", "--vector", "[1, 0]", "--top-k", "2")["matches"]] == ["x", "y"]
    assert [m["id"] for m in run("query", "a", "--vector-id", "y", "--filter", '{"k": 1}')["matches"]] == ["x"]
    assert run("query", "a", "--vector", '["a"]') is None and run("query", "a") is None
    assert run("get-by-ids", "a", "--ids", " x, ")[0]["id"] == "x"
    assert run("list-vectors", "a", "--count", "1") == {"ids": ["x"], "is_truncated": True, "cursor": "x"}
    assert run("create-metadata-index", "a", "--property-name", "k", "--type", "number") == {"k": "number"}
    assert run("delete-metadata-index", "a", "--property-name", "k") == {} == run("list-metadata-index", "a")
    assert run("delete-by-ids", "a", "--ids", "x,z")["ids"] == ["x"]
    (tmp_path / "v").write_text("{\n")
    assert run("insert", "a", "--file", str(tmp_path / "v")) is None
