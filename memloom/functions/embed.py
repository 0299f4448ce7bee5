"""A pluggable text embedder: any function from a list of texts to a matrix; by default hashed word and letter features."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


@lru_cache(maxsize=100_000)
def _word(word: str, dim: int) -> np.ndarray:
    """What a word adds: one signed place for itself and one for each of its letter triples; words come again and again."""
    out = np.zeros(dim, np.float32)
    for part in [word, *(f"<{word}>"[i : i + 3] for i in range(len(word)))]:
        h = zlib.crc32(part.encode())
        out[h % dim] += 1 if h >> 31 else -1
    return out


def hashed(texts: Sequence[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed hashed words and letter triples: deterministic and without a model; blank texts give zeros."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = [_word(word, dim) for word in (text or "").lower().split()]
        if words:
            row += np.sum(words, axis=0)
            size = np.linalg.norm(row)
            if size:
                row /= size
    return out


def embedded(text: Column, embedder: Callable[[Sequence[str]], np.ndarray] = hashed) -> Column:
    """The vector of a text; the embedder is loaded once for each Python worker. Null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = embedder([t if isinstance(t, str) else "" for t in batch])
            yield pd.Series([v.tolist() if isinstance(t, str) else None for t, v in zip(batch, vectors, strict=True)])

    return run(text)


def vectors_of(sources: dict[str, tuple[DataFrame, str, str]], embedder: Callable[[Sequence[str]], np.ndarray] = hashed) -> DataFrame:
    """(source_type, source_id, vector) of several tables, each given as (table, id column, text column)."""
    parts = None
    for kind, (df, key, text) in sources.items():
        part = df.filter(F.col(text).isNotNull()).select(F.lit(kind).alias("source_type"), F.col(key).cast("long").alias("source_id"), F.col(text).alias("text"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("source_type", "source_id", embedded(F.col("text"), embedder).alias("vector"))
