"""Embeddings: a protocol for models and a deterministic stand-in for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts


class Embedder(Protocol):
    """Texts to vectors.  It is sent to the workers; load heavy models on first use."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Unit vectors from hashed words; equal texts get equal vectors.  Not a language model."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[k, h % self.dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0).tolist()


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "document") -> DataFrame:
    """Rows with ``embedding``; the model lives as long as a Python worker's task and gets some hundred texts at a time."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(batch):
                yield pa.array(embedder.embed([t or "" for t in part.to_pylist()]), pa.list_(pa.float32()))

    return rows.withColumn("embedding", run(F.col(text_col)))


def embed_query(embedder: Embedder, query: str) -> list[float]:
    return embedder.embed([query])[0]
