"""Clients of embedding models over HTTP, and their use on Columns and on single texts."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.config import provider
from .text import mock_embedding

#: Dimension and most tokens of models that a local server offers.
LOCAL = {
    "nomic-embed-text": (768, 8192),
    "mxbai-embed-large": (1024, 512),
    "all-minilm": (384, 512),
    "snowflake-arctic-embed": (1024, 512),
    "bge-m3": (1024, 8192),
    "bge-large": (1024, 512),
}
LOCAL_DEFAULT, REMOTE_DIMENSION, MOCK_DIMENSION = (768, 8192), 1536, 64
LOCAL_URL, REMOTE_URL = "http://localhost:11434", "https://api.openai.com/v1"
REMOTE_BATCH, LOCAL_THREADS, HALVINGS = 100, 10, 4


class ModelMissing(ValueError):
    """The server doesn't have the model."""


def post(url: str, body: dict, key: str | None = None, timeout: float = 120):
    """The open response to a JSON request."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout)


def shortened(text: str, max_tokens: int) -> str:
    """At most four fifths of four characters a token, cut at a space if one lies in the last fifth."""
    most = int(max_tokens * 4 * 0.8)
    if len(text) <= most:
        return text
    space = text.rfind(" ", 0, most)
    return text[: space if space > 0.8 * most else most]


@dataclass(frozen=True)
class LocalEmbedder:
    """A server that embeds one text a request; ten requests run at once."""

    model: str
    dimension: int = LOCAL_DEFAULT[0]
    max_tokens: int = LOCAL_DEFAULT[1]
    url: str = LOCAL_URL

    def _one(self, text: str) -> list[float]:
        text = shortened(text, self.max_tokens)
        for left in range(HALVINGS, -1, -1):
            try:
                with post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": text}) as r:
                    return json.load(r)["embedding"]
            except urllib.error.HTTPError as e:
                said = e.read().decode("utf-8", "replace")
                if e.code == 404:
                    raise ModelMissing(f"{self.model}: {said}") from e
                if "context" not in said.lower() or not left:
                    raise ValueError(f"{self.model}: {e.code} {said}") from e
                text = text[: len(text) // 2]
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        with ThreadPoolExecutor(LOCAL_THREADS) as pool:
            return list(pool.map(self._one, texts))


@dataclass(frozen=True)
class RemoteEmbedder:
    """A service that embeds a hundred texts a request.  The key is read from the environment where it is used."""

    model: str
    dimension: int = REMOTE_DIMENSION
    url: str = REMOTE_URL

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for at in range(0, len(texts), REMOTE_BATCH):
            with post(f"{self.url}/embeddings", {"model": self.model, "input": texts[at : at + REMOTE_BATCH]}, os.environ.get("OPENAI_API_KEY")) as r:
                out += [d["embedding"] for d in sorted(json.load(r)["data"], key=lambda d: d["index"])]
        return out


def client(model: str, dimension: int | None = None):
    """The client of a model by its name; None for the built-in test vectors."""
    kind = provider(model)
    if kind == "mock":
        return None
    if kind == "openai":
        return RemoteEmbedder(model, dimension or REMOTE_DIMENSION, os.environ.get("OPENAI_BASE_URL", REMOTE_URL))
    bare = model.removeprefix("ollama:")
    known, most = next((v for n, v in LOCAL.items() if n in bare.lower()), LOCAL_DEFAULT)
    return LocalEmbedder(bare, dimension or known, most, os.environ.get("OLLAMA_HOST", LOCAL_URL))


def dimension_of(model: str, dimension: int | None = None) -> int:
    own = client(model, dimension)
    return own.dimension if own else dimension or MOCK_DIMENSION


def as_column(model: str, dimension: int | None = None) -> Callable[[Column], Column]:
    """Texts to vectors on Columns, an Arrow batch of texts at a time; a null text has no vector."""
    own = client(model, dimension)
    if own is None:
        return lambda c: mock_embedding(c, dimension or MOCK_DIMENSION)

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        found = iter(own.embed([t for t in texts if t is not None]))
        return pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return embedded


def for_queries(spark: SparkSession, model: str, dimension: int | None = None) -> Callable[[str], list[float]]:
    """One text to its vector."""
    own = client(model, dimension)
    if own is None:
        return lambda text: spark.range(1).select(mock_embedding(F.lit(text), dimension or MOCK_DIMENSION)).first()[0]
    return lambda text: own.embed([text])[0]
