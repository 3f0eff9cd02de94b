"""Embedding providers and the keyed table that remembers their results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.keys import embedding_key
from .memo import ExpiringTable

EMBED_BATCH = 128  # fixed value: texts per provider call

#: A batch of texts -> one vector each.
EmbedBatch = Callable[[list[str]], np.ndarray]


def hashed_vectors(token_lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Signed feature hashing of tokens: the offline stand-in for an embedding model. Each distinct token is hashed once."""
    words = token_lists.flatten().dictionary_encode()
    slots = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in words.dictionary.to_pylist()], dtype=np.int64)
    signs = np.where((slots // dim) % 2 == 0, 1.0, -1.0)
    word = words.indices.to_numpy()
    row = np.repeat(np.arange(len(token_lists)), token_lists.value_lengths().fill_null(0).to_numpy())
    sums = np.bincount(row * dim + (slots % dim)[word], weights=signs[word], minlength=len(token_lists) * dim).astype(np.float64)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, len(sums) + 1, dim), pa.int32()), pa.array(sums), mask=token_lists.is_null())


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Column function text -> vector, null of a null text; tokens are cut in the JVM, hashing runs on Arrow batches.

    Its `of_tokens` takes the tokens of a text that is cut already.
    """
    from ..functions.text import tokens

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(token_lists: pa.Array) -> pa.Array:
        return hashed_vectors(token_lists, dim)

    def of_text(text: Column) -> Column:
        return embed(tokens(text))

    of_text.of_tokens = embed
    return of_text


def embed_texts(texts: DataFrame, provider: EmbedBatch, batch: int = EMBED_BATCH) -> DataFrame:
    """key, vector for rows of (key, text), calling the provider in fixed batches per task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = provider(part["text"].tolist())
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": [np.asarray(v, dtype=np.float32) for v in vectors]})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<float>")


class EmbeddingTable:
    """Vectors keyed by digest of model, size and text, so changed text misses and moved ids hit."""

    def __init__(self, spark: SparkSession, path: str, model: str, dim: int, ttl_s: int = Settings.embedding_ttl_s) -> None:
        self.model, self.dim = model, dim
        self.table = ExpiringTable(spark, path, "vector array<float>", ttl_s)

    def stored(self) -> DataFrame:
        """key, vector of all that is held and has not expired."""
        return self.table.live()

    def embed(self, rows: DataFrame, provider: EmbedBatch, text: str = "text") -> DataFrame:
        """`rows` with their `vector`. Each distinct missing text is embedded once and kept.

        Copies of one text share a key, so they are reduced to one before anything is called, and
        the join back keeps a much-copied text from landing in one task.
        """
        key = embedding_key(self.model, self.dim, F.col(text))
        return self.table.read_through(rows, key, text, lambda missing: embed_texts(missing, provider)).drop("error")
