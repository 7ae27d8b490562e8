"""A stored full-text index: postings laid out by term, so that a search reads its terms only.

Two tables: postings (bucket, term, key, tf, doc_len), one folder a bucket of
terms and sorted by term within, and documents (key, doc_len), from which the
corpus statistics come. A hot term spreads over files by its keys. A search
prunes folders by its terms' buckets and row groups by their terms.

Defined cases: null texts are no documents, texts without words count for the
mean length only; a key must stand for one text; a query without words finds
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import K1, B, postings, query_tokens, tokens
from .store import Store

BUCKETS = 64


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame  # bucket, term, key, tf, doc_len
    documents: DataFrame  # key, doc_len


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def chunk_key() -> Column:
    """Key of a chunk in indexes and rankings."""
    return F.xxhash64("doc_id", "artifact_name", "chunk_idx")


def rows(docs: DataFrame, key: str, body: str) -> TextIndex:
    """The two tables of an index, not yet stored."""
    p = postings(docs, key, body).select(bucket(F.col("term")).alias("bucket"), "term", F.col(key).alias("key"), F.col("tf").cast("int").alias("tf"), "doc_len")
    d = docs.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.size(tokens(F.col(body))).alias("doc_len"))
    return TextIndex(p.repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key"), d)


def save(index: TextIndex, path: str) -> None:
    index.postings.write.partitionBy("bucket").parquet(f"{path}/postings")
    index.documents.write.parquet(f"{path}/documents")


def load(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


def store(to: Store, table: str, index: TextIndex) -> None:
    """Put the index of ``table`` into the archive, both tables in one commit."""
    t = to.begin()
    t.put(f"{table}_postings", index.postings, "bucket")
    t.put(f"{table}_lengths", index.documents)
    t.commit()


def stored(of: Store, table: str) -> TextIndex | None:
    if not of.exists(f"{table}_postings"):
        return None
    return TextIndex(of.read(f"{table}_postings"), of.read(f"{table}_lengths"))


def search(index: TextIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) by BM25 of the rows that hold a term of the query, from the asked terms' postings alone."""
    words = query_tokens(query)
    if not words:
        return index.documents.select("key", F.lit(0.0).alias("score")).limit(0)
    total = index.documents.agg(F.count("*"), F.avg("doc_len")).first()
    spark = index.postings.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket(F.col("w"))).distinct().collect()]
    asked = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
    df = asked.groupBy("term").agg(F.count("*").alias("df"))  # at most one row a word
    n, mean = float(total[0]), float(total[1] or 1.0)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / mean))
    return asked.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(score).alias("score"))
