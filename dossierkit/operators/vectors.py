"""Vector search in blocks, rank fusion, and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a block of 64 dimensions is 1 MB of float32.
BLOCK = 4096


def _packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks of at most BLOCK vectors: n, ids and matrix as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                lists = part.column(1)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["n", "ids", "matrix"])

    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(pack, "n int, ids binary, matrix binary")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest rows of each query, exactly.

    Both sides are packed into blocks, each pair of blocks is one matrix product
    in one task, and only its k best a query leave the task. Ties go to the
    smaller key; null vectors are left out; dimensions must agree.
    """
    q = _packed(queries, key, vector).select(F.monotonically_increasing_id().alias("q"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("matrix").alias("qm"))
    v = _packed(vectors, key, vector)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qn, qids, qm, n, ids, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(qm, np.float32).reshape(qn, -1).astype(np.float64)
                b = np.frombuffer(m, np.float32).reshape(n, -1).astype(np.float64)
                q_ids, v_ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                if metric == "cosine":
                    d = 1 - (a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-300)
                else:
                    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0))
                d = np.round(np.maximum(d, 0), 6)  # rounding leaves like vectors just under 0
                order = np.lexsort((np.broadcast_to(v_ids, d.shape), d), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, order.shape[1])), pa.array(v_ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["query_id", key, "distance"]
                )

    pairs = q.join(v).select("qn", "qids", "qm", "n", "ids", "matrix")  # blocks with blocks: the stated query set against all rows
    best = pairs.mapInArrow(match, f"query_id long, `{key}` long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], key: list[str], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key columns, rank from 1): key, score = sum of 1 / (constant + rank)."""
    rows = rankings[0].select(*key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(*key, "rank"))
    return rows.groupBy(*key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def collapse(hits: DataFrame, document: str, order: list) -> DataFrame:
    """The first hit of each document in the given order."""
    w = Window.partitionBy(document).orderBy(*order)
    return hits.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def hydrate(hits: DataFrame, docs: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Hits with their documents' columns; a hit whose document is missing is kept with the defaults."""
    joined = hits.join(docs.select(key, *defaults), key, "left")
    return joined.select(*hits.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])
