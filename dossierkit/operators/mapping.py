"""Semi-structured source records mapped to ``documents`` and ``artifacts`` rows.

A record is one JSON text. Everything is expressed on VARIANT columns, so one
malformed field of a record never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of ``documents`` -> field of the source record.
# Field names of the source's records.
SCALAR_FIELDS = {
    "id": "id", "bn": "bn", "industry": "industry", "collection": "collection", "genre": "genre", "date_sent": "datesent", "date_received": "datereceived", "topic": "topic", "description": "desc",
    "keywords": "kw", "conversation": "conversation",
}
LIST_FIELDS = {"custodian": "custodian", "authors": "au", "recipients": "rc", "cc": "cc", "attachments": "attachment", "related": "related", "mentions": "men"}
UNIT, ELEMENT = "\x1f", "\x1e"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def scalar(record: Column, field: str) -> Column:
    """String as it is; an array gives its first element if that is a string; numbers and booleans as text; else null."""
    v = _get(record, f"$.{field}", "variant")
    kind = _kind(v)
    first = _get(record, f"$.{field}[0]", "variant")
    return (
        F.when(kind.startswith("ARRAY"), F.when(_kind(first) == "STRING", _get(first, "$", "string")))
        .when(kind.startswith("OBJECT") | (kind == "VOID"), None)
        .otherwise(_get(v, "$", "string"))
    )


def strings(record: Column, field: str) -> Column:
    """An array's string elements; a lone string as one element; else none."""
    v = _get(record, f"$.{field}", "variant")
    kind = _kind(v)
    kept = F.transform(F.filter(_get(v, "$", "array<variant>"), lambda x: _kind(x) == "STRING"), lambda x: _get(x, "$", "string"))
    none = F.array().cast("array<string>")
    return F.when(kind == "STRING", F.array(_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.coalesce(kept, none)).otherwise(none)


def modified(record: Column, field: str = "ddmudate") -> Column:
    """The greatest string of a multi-valued date, compared as text; a lone string too."""
    return F.array_max(strings(record, field))


def artifact_list(record: Column) -> Column:
    """The artifacts of a record: its ``artifact`` holds JSON texts of arrays, or objects; what can't be read adds nothing."""
    v = _get(record, "$.artifact", "variant")
    kind = _kind(v)
    elements = F.when(kind == "STRING", F.array(v)).when(kind.startswith("ARRAY"), _get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))

    def read(x: Column) -> Column:
        is_text = _kind(x) == "STRING"
        parsed = F.try_parse_json(_get(x, "$", "string"))
        body = F.when(is_text, parsed).otherwise(x)
        many = _get(body, "$", "array<variant>")
        return F.coalesce(F.when(_kind(body).startswith("OBJECT"), F.array(body)).otherwise(many), F.array().cast("array<variant>"))

    objects = F.filter(F.flatten(F.transform(elements, read)), lambda x: _kind(x).startswith("OBJECT"))
    return F.transform(
        objects,
        lambda x: F.struct(_get(x, "$.name", "string").alias("name"), _get(x, "$.mediaType", "string").alias("media_type"), _get(x, "$.size", "bigint").alias("size"), _get(x, "$.md5", "string").alias("md5")),
    )


def media_types(artifacts: Column) -> Column:
    """Distinct media types in the order of their first artifact."""
    return F.array_distinct(F.filter(F.transform(artifacts, lambda a: a["media_type"]), lambda t: t.isNotNull()))


def search_text(texts: list[Column], lists: list[Column]) -> Column:
    """Non-empty texts, then lists joined by blanks, all joined by one blank."""
    parts = [F.nullif(t, F.lit("")) for t in texts] + [F.nullif(F.array_join(x, " "), F.lit("")) for x in lists]
    return F.concat_ws(" ", *parts)


def digest(texts: list[Column], lists: list[Column], keys: Column) -> Column:
    """16 hex digits over the given texts, lists and sorted artifact keys; nulls count as empty.

    Only equality of digests matters. ``bn``, sizes and media types are left out
    on purpose: a change of these alone is no new version.
    """
    fields = [F.coalesce(t, F.lit("")) for t in texts] + [F.array_join(F.coalesce(x, F.array().cast("array<string>")), ELEMENT) for x in lists] + [F.array_join(F.sort_array(keys), ELEMENT)]
    return F.substring(F.md5(F.concat_ws(UNIT, *fields)), 1, 16)


def withdrawn(record: Column) -> Column:
    """Whether policy redacts a record; only JSON booleans count."""
    gone, published = (_get(record, f"$.{f}", "variant") for f in ("deaccessioned", "published"))
    flag = lambda v, wanted: (_kind(v) == "BOOLEAN") & (_get(v, "$", "boolean") == F.lit(wanted))
    return F.coalesce(flag(gone, True), F.lit(False)) | F.coalesce(flag(published, False), F.lit(False))


def map_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``documents`` columns, plus ``artifacts`` (array of structs) and ``redacted``, of each JSON record; unreadable records drop out."""
    r = F.col("__r")
    rows = records.select(F.try_parse_json(F.col(column)).alias("__r")).where("__r IS NOT NULL")
    rows = rows.select(
        *[scalar(r, f).alias(c) for c, f in SCALAR_FIELDS.items()], F.coalesce(scalar(r, "ti"), scalar(r, "filename")).alias("title"), *[strings(r, f).alias(c) for c, f in LIST_FIELDS.items()],
        artifact_list(r).alias("artifacts"), modified(r).alias("ddmudate"), withdrawn(r).alias("redacted"),
    )
    keys = F.array_distinct(F.transform("artifacts", lambda a: F.concat(F.coalesce(a["name"], F.lit("")), F.lit("\0"), F.coalesce(a["md5"], F.lit("")))))
    digested = ["id", "title", "industry", "collection", "genre", "date_sent", "date_received", "topic", "description", "keywords", "conversation"]
    return rows.withColumns({
        "artifact_types": media_types(F.col("artifacts")),
        "artifact_count": F.size("artifacts").cast("long"),
        "search_text": search_text([F.col(c) for c in ("title", "bn", "topic", "description", "keywords")], [F.col(c) for c in ("authors", "custodian", "recipients")]),
        "digest": digest([F.col(c) for c in digested], [F.col(c) for c in LIST_FIELDS], keys),
    })


def explode_artifacts(mapped: DataFrame) -> DataFrame:
    """One ``artifacts`` row per artifact; documents without any yield none."""
    return mapped.select("id", F.explode("artifacts").alias("a")).select("id", "a.name", "a.media_type", "a.size", "a.md5")
