"""Tables of the archive and their null and empty conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
# The archive's columns and their order, by which its users read it.
SCALARS = ["id", "bn", "title", "industry", "collection", "genre", "date_sent", "date_received", "topic", "description", "keywords", "conversation"]
LISTS = ["custodian", "authors", "recipients", "cc", "attachments", "related", "mentions"]

DOCUMENTS = T.StructType(
    [T.StructField(c, _S) for c in SCALARS]
    + [T.StructField(c, T.ArrayType(_S)) for c in [*LISTS, "artifact_types"]]
    + [T.StructField("artifact_count", T.LongType(), False), T.StructField("search_text", _S, False), T.StructField("ddmudate", _S), T.StructField("digest", _S, False)]
)
ARTIFACTS = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("media_type", _S), T.StructField("size", T.LongType()), T.StructField("md5", _S)])
CHUNKS = T.StructType(
    [T.StructField("doc_id", _S, False), T.StructField("chunk_idx", T.IntegerType(), False), T.StructField("artifact_name", _S, False), T.StructField("text", _S, False), T.StructField("vector", T.ArrayType(T.FloatType()), False)]
)
RAW_ARTIFACTS = T.StructType([*ARTIFACTS.fields, T.StructField("data", T.BinaryType(), False)])

#: Columns searched by keyword, in the order in which matches are reported.
SEARCHED = ["title", "bn", "topic", "description", "keywords", "authors", "custodian", "recipients"]


def text(c: str) -> Column:
    """A string as it reads back: empty is null."""
    return F.nullif(F.col(c), F.lit(""))


def items(c: str) -> Column:
    """A list as it reads back: without null and empty elements, never null."""
    return F.coalesce(F.filter(F.col(c), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def count(c: str) -> Column:
    """A count read as unsigned: null and negative are 0."""
    return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))


def size(c: str) -> Column:
    """An artifact size: null stays null, negative is 0."""
    return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0)))
