"""Embedders as a map source: any function of a list of texts, and a seeded one for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]

#: Offset and prime of 32-bit FNV-1a, multiplier and increment of the generator.
FNV_OFFSET, FNV_PRIME, LCG_A, LCG_C = 2166136261, 16777619, 1664525, 1013904223


def seeded(dims: int) -> Embedder:
    """FNV-1a over the UTF-16 units of a text seeds a linear congruential generator; the vector has length 1."""

    def of(text: str) -> list[float]:
        h = FNV_OFFSET
        for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
            h = ((h ^ unit) * FNV_PRIME) & 0xFFFFFFFF
        out = []
        for _ in range(dims):
            h = (h * LCG_A + LCG_C) & 0xFFFFFFFF
            out.append(h / 2**32 * 2 - 1)
        n = sum(x * x for x in out) ** 0.5 or 1.0
        return [x / n for x in out]

    return lambda texts: [of(t) for t in texts]


def check(vectors: list[list[float]], dims: int) -> None:
    """An embedder's answers have the right length and finite numbers, or the call failed."""
    for v in vectors:
        if len(v) != dims or not np.isfinite(v).all():
            raise ValueError("invalid vector")


def embed(df: DataFrame, text: str, dims: int, embedder: Embedder | None = None, name: str = "vector") -> DataFrame:
    """Add a vector column; batches of rows go to the embedder."""
    f = embedder or seeded(dims)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = f(frame[text].fillna("").tolist())
            check(vectors, dims)
            yield frame.assign(**{name: vectors})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
