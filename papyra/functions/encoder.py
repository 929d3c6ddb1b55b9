"""Text encoders as column functions; the default needs no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

DIMENSIONS = 64


def hashing_encoder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors from hashed words: the same text has the same vector on every machine; a text without words has the first unit vector."""
    import re
    import zlib

    out = np.zeros((len(texts), dimensions), np.float32)
    for i, s in enumerate(texts):
        for w in re.findall(r"\w+", s.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dimensions] += 1 if h & 0x8000_0000 else -1
        if not out[i].any():
            out[i, 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def encode_texts(df: DataFrame, text: Column, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder) -> DataFrame:
    """``df`` with ``embedding``, by Arrow batches. If the encoder fails on a batch, its rows have a null vector and the job goes on. A null text has a null vector."""

    def run(s: pd.Series) -> pd.Series:
        have = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        try:
            vectors = encoder([x.strip() for x in s[have]])
        except Exception:
            return out
        for i, v in zip(s.index[have], vectors):
            out[i] = v
        return out

    return df.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()))(text))


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.trim(F.concat_ws("\n", title, abstract))
