"""Byte-bounded overlapping chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of about ``size`` bytes, each beginning ``size - overlap`` bytes after the one before.

    Begin and end move forward to the next character, so that a chunk may exceed
    ``size`` by up to three bytes; blank texts have none.
    """
    body = (text or "").strip()
    if not body:
        return []
    if len(body) * 4 <= size:
        return [body]
    raw = body.encode()
    if len(raw) <= size:
        return [body]
    # positions at which a character begins, and the end; the next one at or after a position is one search away
    bounds = np.append(np.flatnonzero(np.frombuffer(raw, np.int8) >= -64), len(raw))
    at = bounds.searchsorted
    out, begin, end = [], 0, 0
    while end < len(raw):
        begin = int(bounds[at(begin)])
        end = int(bounds[at(min(begin + size, len(raw)))])
        out.append(raw[begin:end].decode())
        begin += size - overlap
    return out


def chunks(texts: DataFrame, key: str, text: str, size: int = 2048, overlap: int = 256) -> DataFrame:
    """(key, chunk_idx, chunk) of every text; ``overlap`` must be under ``size``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the size")
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = cut(t, size, overlap)
                at += [i] * len(parts)
                number += range(len(parts))
                out += parts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(out, pa.string())], [key, "chunk_idx", "chunk"])

    return texts.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, chunk_idx int, chunk string")
