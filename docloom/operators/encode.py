"""Texts to unit vectors (V1, V3, V12). Encoders are plug-ins; the one here hashes words, it knows nothing of their meaning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 768
AT_ONCE = 256


class Encoder(Protocol):
    dimension: int

    def query(self, text: str) -> tuple[float, ...]: ...


class HashingEncoder:
    """Signed word counts in `dimension` md5 buckets, L2-normalised; a text without words is the zero vector."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.query = lru_cache(maxsize=100)(self._query)

    def _query(self, text: str) -> tuple[float, ...]:
        import hashlib
        import re

        out = [0.0] * self.dimension
        for w in re.findall(r"[^\W_]+", text.lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            out[int(h[:8], 16) % self.dimension] += 1.0 if int(h[8], 16) < 8 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return tuple(x / norm for x in out) if norm else tuple(out)


def word_buckets(text: str, dimension: int = DIMENSION) -> str:
    """SQL: the words of a column as array<struct<bucket, sign>>, equal to the encoder's for ASCII texts."""
    words = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    return f"transform({words}, w -> struct(cast(cast(conv(substr(md5(w), 1, 8), 16, 10) as bigint) % {dimension} as int) as bucket, case when cast(conv(substr(md5(w), 9, 1), 16, 10) as int) < 8 then 1 else -1 end as sign))"


def encode(df: DataFrame, encoder: HashingEncoder, text: str = "content", into: str = "embedding") -> DataFrame:
    """df with array<float> column `into`: Arrow batches through the encoder's query function, one vector a row. Vectors leave a task
    in slices of AT_ONCE rows, as those of a whole batch are far larger than its texts."""
    dimension = encoder.dimension

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = HashingEncoder(dimension)
        for texts in batches:
            for lo in range(0, len(texts), AT_ONCE):
                yield pd.Series([np.array(own._query(t or ""), np.float32) for t in texts.iloc[lo : lo + AT_ONCE]])

    return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


def self_test(encoder: HashingEncoder) -> bool:
    """A test text gives a unit vector of the right size."""
    v = encoder.query("test query")
    return len(v) == encoder.dimension and abs(sum(x * x for x in v) - 1) < 1e-6
