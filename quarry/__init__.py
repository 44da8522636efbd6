"""Document and vector retrieval as Spark DataFrame plans."""

from importlib import import_module

#: Public names and the modules that have them; each is imported when first asked for.
_PUBLIC = {
    "Index": "plans.index", "build": "plans.index", "opened": "plans.index",
    "find_files": "sources.files", "read_vectors": "sources.files", "parse_files": "sources.parsers",
    "chunk_sections": "operators.chunking", "search": "operators.fulltext", "scan": "operators.fulltext", "literal_search": "operators.documents",
    "nearest": "operators.vectors", "batch_nearest": "operators.vectors", "fuse": "operators.hybrid", "compile_filter": "operators.filters",
    "VectorIndex": "operators.vector_index", "mock_embedding": "functions.text", "answer": "agent.loop", "registry": "agent.tools", "query_index": "agent.tools",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module 'quarry' has no attribute {name!r}")
    return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
