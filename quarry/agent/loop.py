"""Questions answered by a language model that may call the tools.

The model is any function from messages to pieces of text.  It replies with
tool calls (JSON, fenced or bare) or with an answer behind ``FINAL:``.  An
answer before any search is sent back twice; then a search is made for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from .tools import Result, Tool, format_chunks

FINAL = re.compile(r"(?:^|\n)\s*FINAL:\s*", re.I)
_FENCED = re.compile(r"```tool\s*\n?(.*?)\n?```", re.S)
_OBJECT = re.compile(r"\{[^{}]*\}")
#: Words and phrases that open a question (fixed values).
ASKING = ("what", "how", "why", "when", "where", "who", "is", "are", "do", "does", "can", "could", "would", "should")
LEAD = ("what is", "what are", "how do", "how to", "how can", "tell me about", "explain", "describe", *ASKING)
_LEAD = re.compile(r"^(" + "|".join(x.replace(" ", r"\s+") for x in LEAD) + r")\s+(an?\s+)?", re.I)
_ASKING = re.compile(r"^(" + "|".join(ASKING) + r")\s+", re.I)
_RETRIES, _PRESEARCH, _QUERY = 2, 5, 100

INSTRUCTIONS = "Answer from the documents alone. Call one of the tools below, or give your answer behind FINAL: with citations such as [1].\n\n{{TOOLS}}"
SEARCH_FIRST = 'Search before you answer. Reply with a tool call alone, for example:\n```tool\n{"tool": "search_fts", "query": "word"}\n```'
SUM_UP = "Make no more tool calls. Give the best answer that the results allow, beginning with FINAL:"


def tool_calls(reply: str) -> list[dict]:
    """Calls in fenced blocks; if there are none, in bare JSON objects.  A call names a tool and a query or document."""
    for texts in (_FENCED.findall(reply), _OBJECT.findall(reply)):
        calls = []
        for text in texts:
            try:
                call = json.loads(text)
            except ValueError:
                continue
            if isinstance(call, dict) and call.get("tool") and (call.get("query") or call.get("doc_id")):
                calls.append(call)
        if calls:
            return calls
    return []


def without_calls(reply: str) -> str:
    return _FENCED.sub("", reply).strip()


def clean(text: str) -> str:
    """Without a code fence around the whole."""
    return re.sub(r"\n?```\s*$", "", re.sub(r"^```[a-z]*\n?", "", text, flags=re.I)).strip()


def final_answer(reply: str) -> str | None:
    found = FINAL.search(reply)
    return clean(reply[found.end() :].strip()) if found else None


def presearch_query(question: str) -> str:
    """The question without its opening phrase and punctuation; empty if too little is left."""
    bare = re.sub(r"[?!.,;:'\"]", "", _LEAD.sub("", question)).strip()[:_QUERY]
    return bare if len(bare) >= 2 else ""


@dataclass
class Session:
    """Chunks seen so far, numbered in the order of their first appearance."""

    tools: dict[str, Tool]
    numbers: dict[str, int] = field(default_factory=dict)
    seen: list[dict] = field(default_factory=list)

    def cite(self, chunks: Iterable[dict]) -> None:
        for c in chunks:
            if c["chunk_id"] not in self.numbers:
                self.numbers[c["chunk_id"]] = len(self.numbers) + 1
                self.seen.append(c)

    def references(self) -> list[dict]:
        own = lambda c: {"badge": c["badge"]} if c.get("badge") else {}
        return [{"n": self.numbers[c["chunk_id"]], "title": c["title"], "url": c["url"], "headings": c["headings"]} | own(c) for c in self.seen]

    def run(self, call: dict) -> Result:
        tool = self.tools.get(call["tool"])
        if tool is None:
            return Result(f"Unknown tool: {call['tool']}", True)
        value = call.get("query") or call.get("doc_id")
        if tool.name == "read_document" and (m := re.fullmatch(r"\[?(\d+)\]?", str(value))) and 0 < int(m[1]) <= len(self.seen):
            value = self.seen[int(m[1]) - 1]["url"]
        first = next(iter(tool.arguments), None)
        limit = next((n for n in ("k", "limit", "max_results") if n in tool.arguments), None)
        result = tool(**({first: value} if first else {}), **({limit: call.get("limit", 5)} if limit else {}))
        self.cite(result.chunks)
        return result


def answer(question: str, tools: dict[str, Tool], model: Callable[[list[dict]], Iterable[str]], iterations: int = 5, prompt: str | None = None) -> Iterator[dict]:
    """Events: start, thinking, tool_call, tool_result, token, and at last done (with references) or error."""
    session = Session(tools)
    hybrid = "search_hybrid" if "search_hybrid" in tools else "search_fts"
    yield {"type": "start", "question": question}
    listed = "\n".join(f"- {t.name}: {t.description}" for t in tools.values())
    system = (prompt or INSTRUCTIONS).replace("{{TOOLS}}", listed, 1)
    if query := presearch_query(question):
        yield {"type": "thinking", "message": "Looking for documents"}
        result = tools[hybrid](query=query, k=_PRESEARCH)
        if result.chunks:
            yield {"type": "tool_result", "tool": "pre-search", "count": len(result.chunks)}
            system += "\n\nPerhaps of use:\n" + format_chunks(result.chunks)
    messages = [{"role": "system", "content": system}, {"role": "user", "content": question}]
    thoughts: list[str] = []

    def call(c: dict) -> Iterator[dict]:
        yield {"type": "tool_call", "tool": c["tool"], "query": c.get("query") or c.get("doc_id")}
        result = session.run(c)
        yield {"type": "tool_result", "tool": c["tool"], "count": len(result.chunks), "text": result.text}

    def done(text: str) -> Iterator[dict]:
        if text:
            yield {"type": "token", "content": text}
        yield {"type": "done", "references": session.references()}

    for i in range(iterations):
        reply = "".join(model(messages))
        final, calls = final_answer(reply), tool_calls(reply)
        if not session.seen and i < _RETRIES and (final is not None or not calls):
            messages += [{"role": "assistant", "content": reply}, {"role": "user", "content": SEARCH_FIRST}]
            continue
        if final is not None:
            if not session.seen:
                yield from call({"tool": hybrid, "query": _ASKING.sub("", question)[:50]})
            yield from done(final)
            return
        if not calls:
            yield from done(clean(without_calls(reply)))
            return
        thoughts.append(without_calls(reply))
        texts = []
        for c in calls:
            for event in call(c):
                yield event
            texts.append(f"{c['tool']}({c.get('query') or c.get('doc_id')!r}):\n{event['text']}")
        messages += [{"role": "assistant", "content": reply}, {"role": "user", "content": "Tool results:\n\n" + "\n\n---\n\n".join(texts)}]

    if session.seen:
        yield {"type": "thinking", "message": "Summing up"}
        reply = "".join(model([*messages, {"role": "user", "content": SUM_UP}]))
        final = final_answer(reply)
        yield from done(clean(without_calls(reply)) if final is None else final)
    elif any(thoughts):
        yield from done(clean("\n".join(t for t in thoughts if t)))
    else:
        yield {"type": "error", "message": "No answer within the limit of iterations."}
