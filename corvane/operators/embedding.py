"""Embeddings of texts: by a model behind Arrow batches, or hashed words without a model."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class HashedWords:
    """Signed feature hashing of lower-case words, unit length; the same everywhere and in every run."""

    size: int = 256

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float]:
        out = [0.0] * self.size
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[(h >> 1) % self.size] += 1.0 if h & 1 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out


def embed(df: DataFrame, text: str, model: Embedder, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Add ``name``: vectors of a text column, asked for in batches on the executors; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf[text]]
            vectors = [v for lo in range(0, len(texts), batch) for v in model(texts[lo : lo + batch])]
            yield pdf.assign(**{name: vectors})

    df = df.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{name}` array<float>")
