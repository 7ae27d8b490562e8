"""Approximate nearest vectors by an inverted file: lists around k-means centres.

The centres are fitted on a bounded sample (``SAMPLE`` rows of least key hash,
all rows where there are fewer); every row is indexed. A search looks through the lists
nearest to each query, by default so many that on the sample the share
``TARGET`` of the exact nearest is found. Under ``LEAST_ROWS`` rows there is one
list, which makes the search exact. A saved index keeps a folder for each list,
and a search reads the folders of the lists it looks through only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows the centres are fitted on, rows from which there is more than one list, and the most lists (4,096 x 64 floats are 1 MB).
SAMPLE, LEAST_ROWS, MOST_LISTS = 20_000, 256, 4096
#: Share of the nearest that the default number of lists finds on the sample, and the sample's queries it is measured with.
TARGET, TRIED = 0.95, 200


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # key, vector, list
    centres: np.ndarray
    key: str
    vector: str
    probes: int  # lists a search looks through


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def fit(vectors: DataFrame, key: str, vector: str, lists: int | None = None, rounds: int = 10) -> tuple[np.ndarray, int]:
    """Centres of the lists, as many as the root of the number of rows unless told otherwise, and how many to look through."""
    filled = vectors.where(F.col(vector).isNotNull())
    n = filled.count()
    sample = filled.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(vector).cast("array<float>")).toArrow().column(0).combine_chunks()
    x = _matrix(sample)
    if n < LEAST_ROWS:
        return (x[:1] if len(x) else np.zeros((1, 1), np.float32)), 1
    k = min(lists or int(np.sqrt(n)), MOST_LISTS, len(x))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(1)
        for c in range(k):
            members = x[nearest == c]
            if len(members):
                centres[c] = members.mean(0)
    # the place, in each tried row's order of lists, of the list that holds each of its ten nearest
    tried = x[:TRIED]
    holds = _distances(x, centres).argmin(1)
    place = np.argsort(np.argsort(_distances(tried, centres), axis=1), axis=1)
    near = np.argsort(_distances(tried, x), axis=1)[:, :10]
    needed = np.sort(np.take_along_axis(place, holds[near], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def build(vectors: DataFrame, key: str, vector: str, lists: int | None = None) -> Index:
    """Index of every row with a vector."""
    centres, probes = fit(vectors, key, vector, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _distances(_matrix(b.column(1)), centres).argmin(1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [key, vector, "list"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<float>").alias(vector))
    return Index(rows.mapInArrow(assign, f"`{key}` long, `{vector}` array<float>, list int"), centres, key, vector, probes)


def save(index: Index, path: str) -> None:
    """Store the index: its rows in a folder a list, and its centres."""
    index.rows.repartitionByRange("list", index.key).write.partitionBy("list").parquet(f"{path}/lists")
    spark = index.rows.sparkSession
    head = [(i, c.tolist(), index.key, index.vector, index.probes) for i, c in enumerate(index.centres)]
    spark.createDataFrame(head, "list int, centre array<float>, key string, vector string, probes int").coalesce(1).write.parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> Index:
    head = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS rows at most
    key, vector = head[0]["key"], head[0]["vector"]
    rows = spark.read.parquet(f"{path}/lists").select(key, vector, "list")
    return Index(rows, np.array([h["centre"] for h in head], np.float32), key, vector, head[0]["probes"])


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, key, distance, rank): about the ``k`` nearest rows of each query (columns key and vector), L2."""
    centres, key, vector, probes = index.centres, index.key, index.vector, probes or index.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(_distances(_matrix(b.column(1)), centres), axis=1)[:, :probes]
            take = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(order.ravel().astype(np.int32))], ["query_id", "asked", "list"])

    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(probe, "query_id long, asked array<float>, list int")
    # the lists to look through, MOST_LISTS at most: the others' folders are not read
    wanted = [r[0] for r in asked.select("list").distinct().collect()]
    pairs = asked.join(index.rows.where(F.col("list").isin(wanted)), "list").select("query_id", "asked", key, vector)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_matrix(b.column(1)).astype(np.float64) - _matrix(b.column(3)).astype(np.float64)) ** 2).sum(1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.round(d, 6))], ["query_id", key, "distance"])

    near = pairs.mapInArrow(measure, f"query_id long, `{key}` long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
