"""Questions and documents of an index over HTTP, with logs of the conversations.

Answers are JSON: ``/health``, ``/examples``, ``/browse``, ``/ask`` and, as
server-sent events, ``/ask/stream``; ``POST /report`` marks a logged
conversation; ``/file/<path>`` gives a source file and any other path the
document of that url as text.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from ..operators import documents as D
from ..plans.index import Index
from ..sources.files import KINDS
from .loop import answer
from .tools import Tool


def examples(path: str) -> list:
    """Suggested questions of a YAML file: a list, or one behind ``examples`` or ``questions``."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    if isinstance(found, dict):
        found = found.get("examples") or found.get("questions") or []
    return found if isinstance(found, list) else []


def tree(rows: Iterable[dict]) -> dict:
    """Documents by the parts of their urls; a leaf holds title and url."""
    top: dict = {}
    for r in rows:
        here = top
        *folders, last = [p for p in (r["url"] or "").split("/") if p] or [""]
        for folder in folders:
            here = here.setdefault(folder, {}).setdefault("children", {})
        here.setdefault(last, {}).update(title=r["title"], url=r["url"])
    return top


class Logs:
    """A file a conversation, in a folder of the server's own machine; files older than ``days`` go, unless reported."""

    def __init__(self, folder: str, days: int = 7):
        self.folder, self.days = Path(folder), days

    def clear(self, now: datetime | None = None) -> int:
        """Deletes old logs; how many."""
        oldest, gone = (now or datetime.now(UTC)).timestamp() - self.days * 86_400, 0
        for path in self.folder.glob("*.json") if self.folder.is_dir() else ():
            if not path.name.startswith("reported-") and path.stat().st_mtime < oldest:
                path.unlink()
                gone += 1
        return gone

    def write(self, name: str, token: str, question: str, messages: list[dict], said: str, references: list[dict]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        meta = {"question": question, "timestamp": datetime.now(UTC).isoformat(), "reportToken": token}
        log = {"metadata": meta, "messages": [*messages, {"role": "assistant", "content": said}], "references": references}
        (self.folder / name).write_text(json.dumps(log, indent=2), encoding="utf-8")

    def report(self, name: str, token: str, comment: str | None) -> tuple[int, dict]:
        """Status and reply; only who has the token of the conversation may report it."""
        if not name or not token:
            return 400, {"error": "debugFile and reportToken are needed"}
        path = self.folder / name
        if Path(name).name != name or not path.is_file():
            return 404, {"error": "no such conversation"}
        log = json.loads(path.read_text(encoding="utf-8"))
        if not secrets.compare_digest(str(log["metadata"].get("reportToken")).encode(), str(token).encode()):
            return 403, {"error": "wrong token"}
        log = {"reported": {"timestamp": datetime.now(UTC).isoformat(), "comment": comment or None}, **log}
        (self.folder / f"reported-{name}").write_text(json.dumps(log, indent=2), encoding="utf-8")
        path.unlink()
        return 200, {"success": True, "reportedFile": f"reported-{name}"}


def logged(question: str, tools: dict[str, Tool], model: Callable, iterations: int, prompt: str | None, logs: Logs | None) -> Iterator[dict]:
    """The events of ``answer``; the first tells the name and token of the log, which is written at the end."""
    last: list[dict] = []

    def recorded(messages: list[dict]):
        last[:] = messages
        return model(messages)

    name, token, said, references = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{secrets.token_hex(4)}.json", secrets.token_hex(16), "", []
    for event in answer(question, tools, recorded, iterations, prompt):
        if event["type"] == "start" and logs:
            event = event | {"debugFile": name, "reportToken": token}
        said += event.get("content", "") if event["type"] == "token" else ""
        references = event.get("references", references)
        yield event
    if logs:
        logs.write(name, token, question, last, said, references)


def server(index: Index, tools: dict[str, Tool], model: Callable, port: int = 3000, host: str = "127.0.0.1", iterations: int = 5, prompt: str | None = None, suggested: list | None = None, content: str | None = None, logs: Logs | None = None) -> ThreadingHTTPServer:
    """A server that is bound to its port and not yet running."""
    if logs:
        logs.clear()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def reply(self, status: int, body, kind: str = "application/json") -> None:
            data = body if isinstance(body, bytes) else (json.dumps(body) if kind == "application/json" else body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def body(self) -> dict:
            found = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if not isinstance(found, dict):
                raise ValueError("the body must be an object")
            return found

        def do_GET(self):
            url = urlsplit(self.path)
            path, query = unquote(url.path), parse_qs(url.query)
            if path in ("/ask", "/ask/stream"):
                self.ask(path, query.get("q", [""])[0])
            elif path == "/health":
                self.reply(200, {"status": "ok", "project": index.manifest.get("project_name"), "documents": index.manifest["doc_count"], "chunks": index.manifest["chunk_count"], "hasExamples": bool(suggested)})
            elif path == "/examples":
                self.reply(200, {"examples": suggested or []})
            elif path == "/browse":
                self.reply(200, tree(r.asDict() for r in D.list_documents(index.chunks).collect()))
            elif path == "/":
                self.reply(200, f"<!doctype html><title>{escape(index.manifest.get('project_name') or 'Documents')}</title><form action=/ask><input name=q><button>Ask</button></form><a href=/browse>Documents</a>", "text/html; charset=utf-8")
            elif path == "/favicon.ico":
                self.reply(204, b"")
            elif path.startswith("/file/"):
                self.file(path.removeprefix("/file/"))
            else:
                self.document(path)

        def do_POST(self):
            try:
                given = self.body()
            except ValueError:
                return self.reply(400, {"error": "the body isn't a JSON object"})
            path = urlsplit(self.path).path
            if path in ("/ask", "/ask/stream"):
                self.ask(path, str(given.get("question") or given.get("q") or ""))
            elif path == "/report" and logs:
                self.reply(*logs.report(given.get("debugFile"), given.get("reportToken"), given.get("comment")))
            else:
                self.reply(404, {"error": "not found"})

        def ask(self, path: str, question: str | None) -> None:
            if not question:
                return self.reply(400, {"error": "no question"})
            events = logged(question, tools, model, iterations, prompt, logs)
            if path == "/ask":
                try:
                    got = list(events)
                except (OSError, ValueError) as e:
                    return self.reply(500, {"error": str(e)})
                said = "".join(e["content"] for e in got if e["type"] == "token")
                return self.reply(200, {"question": question, "answer": said, "references": got[-1].get("references", []), "error": got[-1].get("message")})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            try:
                for event in events:
                    self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):
                pass
            except (OSError, ValueError) as e:
                self.wfile.write(f"data: {json.dumps({'type': 'error', 'message': str(e)})}\n\n".encode())

        def file(self, name: str) -> None:
            root = Path(content).resolve() if content else None
            path = (root / name).resolve() if root else None
            if not path or not path.is_relative_to(root) or path.suffix.lower().lstrip(".") not in KINDS or not path.is_file():
                return self.reply(404, {"error": "not found"})
            self.reply(200, path.read_bytes(), "application/octet-stream")

        def document(self, path: str) -> None:
            bare = path.strip("/")
            for suffix in (".md", ".txt", ".pdf", ".docx"):
                bare = bare.removesuffix(suffix)
            rows = [r.asDict() for r in index.chunks.drop("embedding").filter(F.col("url") == f"/{bare}/").orderBy("idx").collect()]
            if not rows:
                return self.reply(404, {"error": "not found"})
            out, before = [f"# {rows[0]['title']}"], []
            for r in rows:
                own = r["headings"] or []
                same = next((n for n, (a, b) in enumerate(zip(own, before)) if a != b), min(len(own), len(before)))
                out += ["#" * (n + 1) + " " + own[n] for n in range(same, len(own))] + [r["content"]]
                before = own
            self.reply(200, "\n\n".join(out), "text/markdown; charset=utf-8")

    return ThreadingHTTPServer((host, port), Handler)
