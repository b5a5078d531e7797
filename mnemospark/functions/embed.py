"""Embedding of texts in Arrow batches by a pluggable embedder; a hashing embedder needs no model files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2000


class Embedder(Protocol):
    model_id: str

    def embed_many(self, texts: list[str]) -> list[list[float] | None]: ...


class HashingEmbedder:
    """Signed hashed words and letter trigrams, scaled to length 1; the same text always has the same vector."""

    def __init__(self, dim: int = 64):
        self.dim, self.model_id = dim, f"hashing:{dim}"

    def embed_many(self, texts: list[str]) -> list[list[float] | None]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in re.findall(r"\w+", text[:MAX_CHARS].lower()):
            for part in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                h = zlib.crc32(part.encode())
                v[h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()


_loaded: dict[str, Embedder] = {}


def embed(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """(doc_id, vec, model_id) of documents (id, text and, if there is one, summary). An embedder that fails on a batch gives NULLs.

    The embedder is kept by its model once per worker process.
    """
    text = F.when(F.coalesce("summary", F.lit("")) != "", F.concat_ws("\n", "summary", "text")).otherwise(F.col("text")) if "summary" in docs.columns else F.col("text")
    model = embedder.model_id

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _loaded.setdefault(model, embedder)
        for s in batches:
            texts = [t[:MAX_CHARS] for t in s.fillna("")]
            try:
                yield pd.Series(own.embed_many(texts))
            except Exception:  # noqa: BLE001 - any failure of a model means no vectors, not a failed pass
                yield pd.Series([None] * len(texts))

    return docs.select(F.col("id").alias("doc_id"), vectors(F.coalesce(text, F.lit(""))).alias("vec"), F.lit(model).alias("model_id"))


def fill_missing(docs: DataFrame, have: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors of the documents that ``have`` (doc_id, vec, model_id) lacks for the embedder's model."""
    known = have.where(F.col("vec").isNotNull() & (F.col("model_id") == embedder.model_id)).select(F.col("doc_id").alias("id"))
    return embed(docs.join(known, "id", "left_anti"), embedder)
