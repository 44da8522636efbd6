"""Language models over HTTP as functions from messages to pieces of text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from ..functions.embedders import LOCAL_URL, REMOTE_URL, post

_REMOTE = re.compile(r"^(gpt-|o[0-9]|chatgpt)", re.I)


def remote(name: str, url: str = REMOTE_URL) -> Callable[[list[dict]], Iterator[str]]:
    """A service whose stream is of server-sent events."""

    def ask(messages: list[dict]) -> Iterator[str]:
        key = os.environ.get("OPENAI_API_KEY")
        if not key:
            raise ValueError(f"{name} needs OPENAI_API_KEY")
        with post(f"{url}/chat/completions", {"model": name, "messages": messages, "stream": True}, key) as lines:
            for line in lines:
                data = line.decode().strip().removeprefix("data:").strip()
                if data and data != "[DONE]" and line.startswith(b"data:"):
                    for choice in json.loads(data).get("choices", [])[:1]:
                        if piece := choice.get("delta", {}).get("content"):
                            yield piece

    return ask


def local(name: str, url: str = LOCAL_URL) -> Callable[[list[dict]], Iterator[str]]:
    """A server whose stream is of JSON lines."""

    def ask(messages: list[dict]) -> Iterator[str]:
        with post(f"{url}/api/chat", {"model": name, "messages": messages, "stream": True}) as lines:
            for line in lines:
                if line.strip() and (piece := json.loads(line).get("message", {}).get("content")):
                    yield piece

    return ask


def by_name(name: str) -> Callable[[list[dict]], Iterator[str]]:
    if _REMOTE.match(name):
        return remote(name, os.environ.get("OPENAI_BASE_URL", REMOTE_URL))
    return local(name.removeprefix("ollama:"), os.environ.get("OLLAMA_HOST", LOCAL_URL))
