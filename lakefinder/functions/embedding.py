"""Embeddings of texts: two deterministic ones, and the interface for a model."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def digest_vector(text: Column) -> Column:
    """384 numbers from the MD5 of the text: a hash, which says nothing of meaning."""
    h = F.md5(text.cast("binary"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.conv(F.substring(h, i % 32 + 1, F.lit(1)), 16, 10).cast("int"))
    four = F.transform(digits, lambda d: F.array(d / 15.0 - 0.5, (d * 7) % 16 / 15.0 - 0.5, (d * 13) % 16 / 15.0 - 0.5, (d * 17) % 16 / 15.0 - 0.5))
    return F.flatten(four)


def gram_vector(text: Column, dim: int = 384, n: int = 3) -> Column:
    """Counts of hashed character n-grams: texts that share n-grams are near; a blank text is a zero vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            if t and t.strip():
                t = f" {t.strip().lower()} "
                at = [zlib.crc32(t[i : i + n].encode()) % dim for i in range(max(1, len(t) - n + 1))]
                np.add.at(v, at, 1.0)
            out.append(v)
        return pd.Series(out)

    return vectors(text)


class EmbeddingProvider(Protocol):
    """A model: texts to vectors, called for batches within an executor; one instance for each worker."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, text_col: str, provider: EmbeddingProvider | None = None, out: str = "embedding") -> DataFrame:
    """Add a vector for each text: each distinct text is embedded once and joined back.

    Without a provider ``gram_vector`` serves.  Null and blank texts get zero vectors.
    """
    if provider is None:
        return rows.withColumn(out, gram_vector(F.coalesce(F.col(text_col), F.lit(""))))
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [[0.0] * provider.dim for _ in texts]
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            for i, v in zip(some, provider.embed([texts[i] for i in some]) if some else [], strict=True):
                found[i] = list(map(float, v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [text_col, out])

    texts = rows.select(F.col(text_col).cast("string").alias(text_col)).distinct()
    made = texts.mapInArrow(run, f"`{text_col}` string, `{out}` array<double>")
    return rows.join(made.withColumnRenamed(text_col, "__text"), F.col(text_col).eqNullSafe(F.col("__text")), "left").drop("__text")
