"""Building the archive and keeping it current by digests.

A run changes documents, artifacts, derived rows and the watermark in one
transaction of the store: whatever step it dies in, the archive is as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import artifact_keys
from .store import Store
from .textindex import rows as index_rows


def classify(incoming: DataFrame, stored: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(id, class) of incoming rows (id, digest, redacted): redacted, new, unchanged or changed; null ids are left out.

    A row is redacted by its flag, or, where the incoming ``artifacts`` are given,
    if it has none.
    """
    rows = incoming.where(F.col("id").isNotNull()).select("id", "digest", F.coalesce("redacted", F.lit(False)).alias("redacted"))
    if artifacts is not None:
        rows = rows.join(artifacts.select("id", F.lit(True).alias("has")).distinct(), "id", "left").withColumn("redacted", F.col("redacted") | F.col("has").isNull()).drop("has")
    known = stored.where(F.col("digest").isNotNull()).groupBy("id").agg(F.min("digest").alias("known"))
    kind = F.when(F.col("redacted"), "redacted").when(F.col("known").isNull(), "new").when(F.col("known") == F.col("digest"), "unchanged").otherwise("changed")
    return rows.join(known, "id", "left").select("id", kind.alias("class")).distinct()


def invalidated(classes: DataFrame, incoming_artifacts: DataFrame, stored_artifacts: DataFrame) -> DataFrame:
    """Ids whose derived rows are stale: redacted, or changed with another set of artifacts; an edit of metadata alone is not."""
    sets = [a.groupBy("id").agg(F.sort_array(F.collect_set(artifact_keys())).alias(n)) for a, n in ((incoming_artifacts, "new_set"), (stored_artifacts, "old_set"))]
    changed = classes.where(F.col("class") == "changed").join(sets[0], "id", "left").join(sets[1], "id", "left")
    other = changed.where(~F.col("new_set").eqNullSafe(F.col("old_set"))).select("id")
    return other.unionByName(classes.where(F.col("class") == "redacted").select("id")).distinct()


def dry_run(incoming: DataFrame, incoming_artifacts: DataFrame, stored: DataFrame, stored_artifacts: DataFrame) -> DataFrame:
    """(id, class) by artifact sets alone, so that an edit of metadata shows as unchanged; nothing is written."""
    sets = [a.groupBy("id").agg(F.sort_array(F.collect_set(artifact_keys())).alias(n)) for a, n in ((incoming_artifacts, "new_set"), (stored_artifacts, "old_set"))]
    rows = incoming.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_or(F.coalesce("redacted", F.lit(False))).alias("redacted"))
    rows = rows.join(sets[0], "id", "left").join(stored.select("id", F.lit(True).alias("stored")).distinct(), "id", "left").join(sets[1], "id", "left")
    none = F.array().cast("array<string>")
    kind = (
        F.when(F.col("redacted") | F.col("new_set").isNull(), "redacted").when(F.col("stored").isNull(), "new")
        .when(F.coalesce("new_set", none) == F.coalesce("old_set", none), "unchanged").otherwise("changed")
    )
    return rows.select("id", kind.alias("class"))


def text_refetches(plan: DataFrame, incoming_artifacts: DataFrame) -> DataFrame:
    """One row: how many text artifacts a run by ``plan`` (id, class) would fetch and embed again, those of new and changed documents."""
    texts = incoming_artifacts.where(F.col("media_type") == "text/plain").select("id", "name", "md5").distinct()
    return texts.join(plan.where(F.col("class").isin("new", "changed")).select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("text_artifacts"))


def delete_derived(store: Store, ids: DataFrame, tables: tuple[str, ...] = ("documents", "chunks", "raw_artifacts")) -> dict[str, int]:
    """Delete the rows of the ids (first column) from each table, in one commit; the number deleted, 0 where a table is absent."""
    keys = {"chunks": "doc_id"}
    wanted = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    out, t = {}, store.begin()
    for name in tables:
        out[name] = 0
        if store.exists(name):
            rows, key = store.read(name), keys.get(name, "id")
            out[name] = rows.join(wanted, rows[key] == wanted["__id"], "left_semi").count()
            if out[name]:
                t.merge(name, None, wanted, key)
    t.commit()
    return out


def upsert(stored: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with those of the delta's keys replaced by the delta's."""
    return stored.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def delete(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def watermark(rows: DataFrame, column: str = "ddmudate") -> DataFrame:
    """One row: the greatest modification date, compared as text; null over no rows."""
    return rows.agg(F.max(column).alias("watermark"))


def store_sizes(artifacts: DataFrame, chunked: DataFrame, stored_raw: DataFrame | None) -> DataFrame:
    """One row: number and bytes of text and raw artifacts, in all and really stored.

    Text: logical are the ``text/plain`` rows; real those whose (id, name) has
    chunks (columns doc_id, artifact_name). Raw: logical are rows of another
    known type; real those in the raw store that are not text by type or name.
    """
    text = F.coalesce(F.col("media_type") == "text/plain", F.lit(False))
    ocr = text | F.coalesce(F.lower("name").endswith(".ocr"), F.lit(False))
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))
    rows = artifacts.join(chunked.select(F.col("doc_id").alias("id"), F.col("artifact_name").alias("name"), F.lit(True).alias("cut")).distinct(), ["id", "name"], "left")
    real = F.lit(None).cast("boolean")
    if stored_raw is not None:
        rows = rows.join(stored_raw.select("id", "name", F.lit(True).alias("kept")).distinct(), ["id", "name"], "left")
        real = F.coalesce("kept", F.lit(False)) & ~text
    raw = F.col("media_type").isNotNull() & ~text

    def sums(name: str, when: Column) -> list[Column]:
        return [F.sum(F.when(when, 1).otherwise(0)).cast("long").alias(f"{name}_count"), F.coalesce(F.sum(F.when(when, size)), F.lit(0)).cast("long").alias(f"{name}_bytes")]

    both = [*sums("text_logical", text), *sums("text_real", ocr & F.coalesce("cut", F.lit(False))), *sums("raw_logical", raw)]
    if stored_raw is None:
        return rows.agg(*both).withColumns({"raw_real_count": F.lit(None).cast("long"), "raw_real_bytes": F.lit(None).cast("long")})
    return rows.agg(*both, *sums("raw_real", real))


@dataclass(frozen=True)
class ApplyStats:
    scanned: int
    new: int
    changed: int
    unchanged: int
    redacted: int
    invalidated: int
    watermark: str | None


DERIVED = ("chunks", "raw_artifacts")
#: Tables of the full-text index over ``search_text``.
INDEXED = ("documents_postings", "documents_lengths")
#: Those of the index over chunks, which a full-text build brings and the loss of chunks takes away.
CHUNK_INDEX = ("chunks_postings", "chunks_lengths")


def build(store: Store, documents: DataFrame, artifacts: DataFrame, force: bool = False, drop_redacted: bool = False) -> None:
    """Full build, in one transaction. Refuses to overwrite unless ``force``; stale derived tables go with it."""
    if store.exists("documents") and not force:
        raise FileExistsError("the archive exists; pass force to build it again")
    rows = documents.where(F.col("id").isNotNull())
    if drop_redacted and "redacted" in documents.columns:
        rows = rows.where(~F.coalesce("redacted", F.lit(False)))
        artifacts = artifacts.join(rows.select("id").distinct(), "id", "left_semi")
    t = store.begin()
    t.put("documents", rows.drop("redacted"))
    t.put("artifacts", artifacts)
    for name in (*DERIVED, *INDEXED, *CHUNK_INDEX, "_meta"):
        t.drop(name)
    t.put("_ingest_state", watermark(rows))
    t.commit()


def apply(store: Store, documents: DataFrame, artifacts: DataFrame, since: str | None = None, everything: bool = False) -> ApplyStats:
    """Incremental run over records modified at or after ``since`` (else the stored watermark), or over all that are given.

    Only the rows that change are written. Documents, artifacts, their full-text
    index, derived rows and the watermark, which never falls, come into force together. Running it again
    changes nothing.
    """
    known = store.read("_ingest_state").first() if store.exists("_ingest_state") else None
    mark = known["watermark"] if known else None
    bound = None if everything else since if since is not None else mark
    rows = documents if bound is None else documents.where(F.col("ddmudate") >= bound)
    rows = rows.dropDuplicates(["id"])
    parts = artifacts.join(rows.select("id"), "id", "left_semi")
    old_docs, old_parts = store.read("documents"), store.read("artifacts")
    classes = classify(rows, old_docs, parts).persist()
    try:
        counts = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
        totals = rows.agg(F.count("*"), F.max("ddmudate")).first()
        scanned, seen = totals[0], totals[1]
        stale = invalidated(classes, parts, old_parts).persist()
        n_stale = stale.count()
        written = classes.where(F.col("class").isin("new", "changed"))
        gone = classes.where(F.col("class") == "redacted")
        delta = rows.drop("redacted").join(written.select("id"), "id", "left_semi")
        touched = written.select("id").unionByName(gone.select("id"))
        t = store.begin()
        if counts.keys() & {"new", "changed", "redacted"}:
            t.merge("documents", delta.select(*old_docs.columns), touched)
            t.merge("artifacts", parts.join(written.select("id"), "id", "left_semi").select(*old_parts.columns), touched)
            if store.exists(INDEXED[0]):
                fresh = index_rows(delta, "id", "search_text")
                for name, part in zip(INDEXED, (fresh.postings, fresh.documents), strict=True):
                    t.merge(name, part, touched, "key")
        for name, key in zip(DERIVED, ("doc_id", "id"), strict=True):
            if n_stale and store.exists(name):
                t.merge(name, None, stale, key)
                for part in CHUNK_INDEX if name == "chunks" else ():
                    t.drop(part)
        best = max(x for x in (mark, seen) if x is not None) if mark or seen else None
        if best != mark or known is None:
            t.put("_ingest_state", documents.sparkSession.createDataFrame([(best,)], "watermark string"))
        t.commit()
        stale.unpersist()
    finally:
        classes.unpersist()
    return ApplyStats(scanned, *(counts.get(k, 0) for k in ("new", "changed", "unchanged", "redacted")), n_stale, best)
