"""Point and batch lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(docs: DataFrame, predicate: Column, columns: list[str], limit: int | None = None) -> DataFrame:
    """Rows of ``docs`` for which the predicate holds, as the scan can push it; nothing when no row does."""
    found = docs.where(predicate).select(*columns)
    return found if limit is None else found.limit(limit)


def get_many(docs: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` for the keys of ``wanted`` (pos, key), in the order asked, each once, missing ones left out.

    A key asked twice keeps its first position. The position comes back as ``pos``.
    """
    first = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("pos"))
    return docs.join(first, key).orderBy("pos")


def existing(docs: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The distinct keys of ``wanted`` that ``docs`` has."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(docs.select(key), key, "left_semi")


def digests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, digest) of the wanted documents; a null digest is left out."""
    return docs.join(wanted.select("id").distinct(), "id", "left_semi").where(F.col("digest").isNotNull()).select("id", "digest").distinct()


def artifact_keys() -> Column:
    """name NUL md5 of an artifact row, nulls as empty."""
    return F.concat(F.coalesce("name", F.lit("")), F.lit("\0"), F.coalesce("md5", F.lit("")))


def artifact_digests(artifacts: DataFrame) -> DataFrame:
    """(id, keys) with the sorted distinct artifact keys of each document."""
    return artifacts.groupBy("id").agg(F.sort_array(F.collect_set(artifact_keys())).alias("keys"))


def by_bns(docs: DataFrame, bns: DataFrame) -> DataFrame:
    """Documents whose bn is among the wanted (first column), whole rows, each once."""
    return docs.join(bns.select(F.col(bns.columns[0]).alias("bn")).where(F.col("bn").isNotNull()).distinct(), "bn", "left_semi").dropDuplicates(["id"])


def by_conversations(docs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Documents of the wanted conversations (first column), whole rows, each once."""
    return docs.join(conversations.select(F.col(conversations.columns[0]).alias("conversation")).where(F.col("conversation").isNotNull()).distinct(), "conversation", "left_semi").dropDuplicates(["id"])


def resolve(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id) of each wanted key that is a document's id, else its bn; of several with one bn the smallest id."""
    keys = keys.select("key").where(F.col("key").isNotNull()).distinct()
    by_id = keys.join(docs.select(F.col("id").alias("key"), "id").distinct(), "key").select("key", "id", F.lit(0).alias("rank"))
    by_bn = keys.join(docs.where(F.col("bn").isNotNull()).groupBy(F.col("bn").alias("key")).agg(F.min("id").alias("id")), "key").select("key", "id", F.lit(1).alias("rank"))
    return by_id.unionByName(by_bn).groupBy("key").agg(F.min_by("id", "rank").alias("id"))


def is_text() -> Column:
    """Whether an artifact row holds text: by its type, or by its name's ending."""
    return (F.coalesce(F.col("media_type") == "text/plain", F.lit(False))) | F.coalesce(F.lower("name").endswith(".ocr"), F.lit(False))


def text_artifacts(artifacts: DataFrame) -> DataFrame:
    """(id, name, media_type) of the text artifacts, by id and name, nulls first."""
    return artifacts.where(F.col("media_type") == "text/plain").select("id", "name", "media_type").orderBy(F.asc_nulls_first("id"), F.asc_nulls_first("name"))


def raw_candidates(artifacts: DataFrame, with_text: bool = True) -> DataFrame:
    """Artifacts to store raw; those of unknown type are never among them."""
    kept = F.col("media_type").isNotNull() if with_text else F.col("media_type") != "text/plain"
    return artifacts.where(kept)
