"""Project configuration in JSON or YAML, and the manifest of an index."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

FILENAMES = ("quarry.config.json", "quarry.config.yaml", "quarry.config.yml", ".quarry.json", ".quarry.yaml")
CLIMBS = 10

#: Shortcodes whose inner text stays, and those that go with it.
KEPT = ("info", "note", "tip", "warning", "panel", "section", "column", "columns", "pre", "glow")
DROPPED = ("children", "toc", "anchor", "youtube", "vimeo", "drawio")

DEFAULTS: dict = {
    "content": {"dir": ".", "include": ["**/*.md"], "exclude": ["**/node_modules/**"]},
    "shortcodes": {**{n: {"extractContent": True} for n in KEPT}, **{n: {"skip": True} for n in DROPPED}},
    "chunking": {"maxTokens": 500, "overlap": 80},
    "agent": {"model": "llama3.2", "maxIterations": 5},
}

#: Names of models that a local server offers; a part of the name is enough.
LOCAL_MODELS = ("nomic-embed-text", "mxbai-embed-large", "all-minilm", "snowflake-arctic-embed", "bge-m3", "bge-large")


def merge(user: dict) -> dict:
    """Sections that have defaults are merged key by key; all others are taken as they are."""
    return {**DEFAULTS, **user, **{k: {**v, **(user.get(k) or {})} for k, v in DEFAULTS.items()}}


def find(start: str) -> Path | None:
    """The nearest configuration file, up to ten folders up."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:CLIMBS]:
        for name in FILENAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def load(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return merge(json.loads(text))
    import yaml

    return merge(yaml.safe_load(text) or {})


def project(start: str) -> tuple[dict, Path | None]:
    """The configuration and its file; the defaults and None if there is none."""
    path = find(start)
    return (load(path), path) if path else (merge({}), None)


def content_root(config: dict, folder: str) -> Path:
    return (Path(folder) / (config.get("content") or {}).get("root", "")).resolve()


def rules(config: dict) -> dict[str, dict]:
    """Shortcode rules as ``sources.markdown.shortcodes`` takes them."""
    return {n: {("extract" if k == "extractContent" else k): v for k, v in r.items()} for n, r in (config.get("shortcodes") or {}).items()}


def parse_filter(pairs: list[str]) -> dict[str, str]:
    """``field=value`` arguments; what follows a second ``=`` is cut off, and pairs without a field or value are left out."""
    split = [p.split("=") for p in pairs]
    return {s[0]: s[1] for s in split if len(s) > 1 and s[0] and s[1]}


def provider(model: str) -> str:
    if model == "mock":
        return "mock"
    if model.startswith("ollama:") or any(n in model.lower() for n in LOCAL_MODELS):
        return "ollama"
    return "openai"


def model_folder(model: str) -> str:
    """A model's name as the name of a folder."""
    bare = model.split(":", 1)[1] if model.startswith(("ollama:", "openai:")) else model
    return "".join(c if c.isascii() and (c.isalnum() or c in "._-") else "-" for c in bare)


def git_commit(folder: str = ".") -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def manifest(config: dict, model: str, dimension: int, doc_count: int, chunk_count: int, active: dict | None = None, content_copy: bool = False, version: int = 0) -> dict:
    """What an index was built from and holds."""
    chunking, agent = config["chunking"], config["agent"]
    out = {
        "schema_version": "1.1.0",
        "version": version,
        "project_name": config.get("name"),
        "build_time_utc": datetime.now(UTC).isoformat(),
        "source_git_commit": git_commit(),
        "base_url": config.get("baseUrl"),
        "chunking": {"max_tokens": chunking["maxTokens"], "overlap": chunking["overlap"], "strategy": "heading-aware"},
        "embedding": {"model_id": model, "dimension": dimension, "provider": provider(model)},
        "fts_fields": ["title", "content"],
        "doc_count": doc_count,
        "chunk_count": chunk_count,
        "filters": active or None,
        "content_copy": {"enabled": True, "path": "content"} if content_copy else None,
        "agent": {"system_prompt": agent.get("systemPrompt"), "model": agent.get("model"), "max_iterations": agent.get("maxIterations")},
    }
    return {k: v for k, v in out.items() if v is not None or k == "source_git_commit"}
