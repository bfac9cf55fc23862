"""Embedders turn texts to vectors; callers may bring their own. The default needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed hashing of words and character trigrams, each vector scaled to length 1."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for row, t in zip(out, texts):
        for w in t.lower().split():
            marked = f"#{w}#"
            for g in (w, *(marked[i : i + 3] for i in range(len(marked) - 2))):
                h = xxhash.xxh64_intdigest(g)
                row[h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(rows: DataFrame, text: str, out: str = "embedding", model: Callable[[list[str]], np.ndarray] = hashed, batch: int = 64) -> DataFrame:
    """Rows with a vector of each text, in batches; a null text has the vector of an empty one."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if t is None else t for t in part]
            made = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series(made, index=part.index)

    return rows.withColumn(out, run(text))
