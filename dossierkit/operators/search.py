"""Keyword search: BM25 over whole texts, ranked by the terms found, with provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SEARCHED, items, text
from ..session import materialise

K1, B = 1.2, 0.75
_TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0))


def terms(query: str) -> list[str]:
    """Distinct lower-case words of a query in their order; none of a blank one."""
    return list(dict.fromkeys(query.lower().split()))


def query_tokens(query: str) -> list[str]:
    """The query cut into index terms, as texts are."""
    import regex

    return list(dict.fromkeys(regex.findall(_TOKEN, query.lower())))


def _equals(word: str):  # noqa: ANN202
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, key: str, body: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the rows that hold a term of the query.

    For texts without a stored index (``textindex``). Only the query's terms are
    counted, within each row, in one pass over the texts; statistics and scores
    come from the counts. Null texts count as no document; a query without terms
    finds nothing.
    """
    words = query_tokens(query)
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    found = docs.where(F.col(body).isNotNull()).select(key, tokens(F.col(body)).alias("__t"))
    tf = [F.size(F.filter("__t", _equals(w))).alias(f"__f{i}") for i, w in enumerate(words)]
    counted = materialise(found.select(key, F.size("__t").alias("__len"), *tf), "term-counts")
    sums = counted.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"__d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        f, d = F.col(f"__f{i}").cast("double"), F.col(f"__d{i}")
        idf = F.log(1 + (F.col("__n") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__len") / F.col("__avg")))).otherwise(0.0)
    return counted.join(F.broadcast(sums)).where(F.greatest(*[F.col(f"__f{i}") for i in range(len(words))], F.lit(0)) > 0).select(key, score.alias("score"))


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Inverted index (term, key, tf, doc_len), to be written sorted by term."""
    counted = docs.where(F.col(body).isNotNull()).select(key, tokens(F.col(body)).alias("t"))
    rows = counted.select(key, F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return rows.groupBy("term", key, "doc_len").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class SearchParams:
    query: str
    media_type: str | None = None
    limit: int = 10
    offset: int = 0


def field_text(field: str) -> Column:
    """A searched field as one lower-case text, lists joined by blanks."""
    from ..schema import LISTS

    return F.lower(F.array_join(items(field), " ")) if field in LISTS else F.coalesce(F.lower(text(field)), F.lit(""))


def keyword_search(docs: DataFrame, params: SearchParams, hits: DataFrame | None = None) -> DataFrame:
    """Ranked hits: id, score, matched_fields.

    The best max(4 * (offset + limit), 50) rows by BM25 over ``search_text`` are
    candidates; their score is the number of distinct query terms found, as
    substrings, in any searched field; equal scores keep the order of BM25.
    ``hits`` (id, score) come from a stored index; without one the texts are read.
    """
    wanted = terms(params.query)
    if hits is None:
        hits = bm25(docs.select("id", "search_text").dropDuplicates(["id"]), "id", "search_text", params.query)
    best = hits.orderBy(F.desc(F.round("score", 9)), "id").limit(max(4 * (params.offset + params.limit), 50))
    # wide rows of the candidates only
    rows = docs.join(F.broadcast(best.withColumnRenamed("score", "bm25")), "id").dropDuplicates(["id"])
    if params.media_type is not None:
        rows = rows.where(F.array_contains(items("artifact_types"), params.media_type))
    fields = {f: field_text(f) for f in SEARCHED}
    all_text = F.concat_ws(" ", *fields.values())
    score = sum((F.contains(all_text, F.lit(w)).cast("int") for w in wanted[1:]), F.contains(all_text, F.lit(wanted[0])).cast("int")) if wanted else F.lit(0)
    holds = [F.when(F.greatest(*[F.contains(t, F.lit(w)) for w in wanted], F.lit(False)), F.lit(f)) for f, t in fields.items()] if wanted else [F.lit(None).cast("string")]
    scored = rows.select("id", score.alias("score"), F.array_compact(F.array(*holds)).alias("matched_fields"), F.round("bm25", 9).alias("bm25"))
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), F.desc("bm25"), "id").offset(params.offset).limit(params.limit).select("id", "score", "matched_fields")


def snippet(c: Column, most: int = 280) -> Column:
    """White-space runs as one blank; over ``most`` bytes cut back to a character and marked with an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    # the longest prefix of at most ``most`` bytes: the cut bytes that form a whole character are dropped
    cut = F.regexp_replace(F.decode(F.substring(F.encode(one, "UTF-8"), 1, most), "ISO-8859-1"), "[À-ÿ][\x80-¿]*$", "")
    whole = F.decode(F.substring(F.encode(one, "UTF-8"), 1, most), "ISO-8859-1")
    bytes_ = F.encode(F.when(F.length(F.decode(F.substring(F.encode(one, "UTF-8"), most + 1, 1), "ISO-8859-1")).isNotNull() & F.decode(F.substring(F.encode(one, "UTF-8"), most + 1, 1), "ISO-8859-1").rlike("[\x80-¿]"), cut).otherwise(whole), "ISO-8859-1")
    return F.when(F.octet_length(one) > most, F.concat(F.decode(bytes_, "UTF-8"), F.lit("…"))).otherwise(one)
