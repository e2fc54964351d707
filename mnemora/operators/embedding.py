"""Vectors by a pluggable embedder, batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[Sequence[str]], list[list[float]]]


def hashing_embedder(size: int = 64) -> Embedder:
    """Deterministic vectors of hashed words, for tests and for runs without a model."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return embed


def embed(texts: DataFrame, embedder: Embedder, model: str, size: int) -> DataFrame:
    """`source_type`, `source_id`, `embedding`, `model` of `texts` (source_type, source_id, content); wrong sizes raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = embedder(b["content"].fillna("").tolist())
            if any(len(v) != size for v in vectors):
                raise ValueError(f"the embedder's vectors do not have {size} numbers")
            yield pd.DataFrame({"source_type": b["source_type"], "source_id": b["source_id"], "embedding": vectors, "model": model})

    return texts.select("source_type", "source_id", "content").mapInPandas(run, "source_type string, source_id long, embedding array<float>, model string")
