"""Artifact retrieval: tiers, byte pages, object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import is_text

#: Bounds of what a call may ask for: (least, most, default).
TEXT_PAGE, BYTE_PAGE, HITS, SQL_ROWS = (1, 65_536, 8_192), (1, 1_048_576, 65_536), (1, 50, 10), (1, 2_000, 200)


def clamp(value: int | None, bounds: tuple[int, int, int]) -> int:
    least, most, default = bounds
    return default if value is None else max(least, min(most, value))


def byte_page(data: Column, offset: int, most: int) -> dict[str, Column]:
    """Slice of a binary column with its total and whether more follows; an offset past the end gives nothing."""
    total = F.octet_length(data)
    start = F.least(F.lit(max(offset, 0)), total)
    end = F.least(start + most, total)
    return {"slice": F.substring(data, F.lit(max(offset, 0) + 1), F.lit(most)), "offset": start, "returned_bytes": end - start, "total_bytes": total, "truncated": end < total}


def read_text(artifacts: DataFrame, data: DataFrame, offset: int = 0, most: int = TEXT_PAGE[2], configured: bool = True) -> DataFrame:
    """Text page of each artifact row (id, name, media_type), from ``data`` (id, name, data).

    The status is the first that holds: no reader configured, not text, file
    missing, loaded. The slice may cut a character; what then isn't UTF-8 reads
    as the replacement character.
    """
    rows = artifacts.select("id", "name", "media_type", is_text().alias("__text")).join(data.select("id", "name", "data"), ["id", "name"], "left")
    page = byte_page(F.col("data"), offset, clamp(most, TEXT_PAGE))
    status = (
        F.when(F.lit(not configured), "artifact_root_not_configured").when(~F.col("__text"), "unsupported_artifact_type").when(F.col("data").isNull(), "artifact_file_missing").otherwise("text_loaded")
    )
    loaded = status == "text_loaded"
    return rows.select(
        "id", "name", "media_type", status.alias("status"), F.when(loaded, F.make_valid_utf8(page["slice"].cast("string"))).alias("text"),
        *[F.when(loaded, page[c]).alias(n) for c, n in (("offset", "text_offset"), ("returned_bytes", "returned_bytes"), ("total_bytes", "total_bytes"), ("truncated", "truncated"))],
    )


def read_bytes(data: DataFrame, offset: int = 0, most: int = BYTE_PAGE[2]) -> DataFrame:
    """Base64 page of each artifact's bytes."""
    page = byte_page(F.col("data"), offset, clamp(most, BYTE_PAGE))
    return data.select("id", "name", F.regexp_replace(F.base64(page["slice"]), "\r\n", "").alias("data_base64"), page["returned_bytes"].alias("returned_bytes"), page["total_bytes"].alias("total_bytes"), page["truncated"].alias("truncated"))


def resolve_tiers(wanted: DataFrame, raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, name, data, tier) of the wanted artifacts: the raw store first, then the artifact store, else null."""
    r = raw.select("id", "name", F.col("data").alias("raw_data"), F.lit(True).alias("in_raw")).dropDuplicates(["id", "name"])
    f = fallback.select("id", "name", F.col("data").alias("file_data"), F.lit(True).alias("in_file")).dropDuplicates(["id", "name"])
    rows = wanted.select("id", "name").join(r, ["id", "name"], "left").join(f, ["id", "name"], "left")
    tier = F.when(F.col("in_raw"), "raw").when(F.col("in_file"), "artifact_store")
    return rows.select("id", "name", F.when(F.col("in_raw"), F.col("raw_data")).otherwise(F.col("file_data")).alias("data"), tier.alias("tier"))


def fanout_key(id_: Column, name: Column, prefix: str = "artifacts", depth: int = 4) -> Column:
    """Object key that spreads ids over ``depth`` levels of one character each."""
    levels = F.array_join(F.filter(F.split(F.substring(id_, 1, depth), ""), lambda c: c != ""), "/")
    return F.concat_ws("/", F.lit(prefix), F.nullif(levels, F.lit("")), id_, name)


def read_objects(spark: SparkSession, root: str, wanted: DataFrame, prefix: str = "artifacts", depth: int = 4) -> DataFrame:
    """(id, name, data) of the wanted artifacts that exist under ``root``; missing files are left out.

    Files are listed and read by Spark's own binary source and matched by key.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{prefix}")
    keyed = files.select(F.regexp_extract("path", rf"({prefix}/.*)$", 1).alias("key"), F.col("content").alias("data"))
    keys = wanted.select("id", "name").distinct().withColumn("key", fanout_key(F.col("id"), F.col("name"), prefix, depth))
    return keys.join(keyed, "key").select("id", "name", "data")


def to_store(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates that the raw store lacks, by (id, name)."""
    return candidates.join(stored.select("id", "name"), ["id", "name"], "left_anti")
