"""Vectors of texts behind a provider, so that any model can be plugged in."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    dims: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Unit vectors of hashed word counts: repeatable, without a model and without meaning; for tests and smoke runs."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            h = np.fromiter(map(zlib.crc32, map(str.encode, t.lower().split())), np.int64)
            out[i] = np.bincount(h % self.dims, np.where(h >> 31, 1.0, -1.0), self.dims)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embedded(chunks: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """``chunks`` with an ``embedding`` column; the provider sees one Arrow batch at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(embedding=list(provider(part[text].fillna("").tolist())))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{names}, embedding array<float>")
