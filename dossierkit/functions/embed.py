"""Batch embedding of texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic embedder for offline use: signed hashed word counts, normalised."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self.model = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)


def embed_column(rows: DataFrame, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``rows`` with a ``vector`` of each text; all vectors must have one dimension, and as many must come as were asked."""
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimensions = None
        for b in batches:
            vectors = []
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for a in range(0, len(texts), batch):
                part = [t or "" for t in texts[a : a + batch]]
                got = np.asarray(embedder.embed(part), np.float32)
                if len(got) != len(part) or got.ndim != 2 or not got.shape[1]:
                    raise ValueError(f"{len(part)} texts gave vectors of shape {got.shape}")
                if dimensions not in (None, got.shape[1]):
                    raise ValueError(f"vectors of {got.shape[1]} dimensions among those of {dimensions}")
                dimensions = got.shape[1]
                vectors += got.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return rows.mapInArrow(run, schema)
