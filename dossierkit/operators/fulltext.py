"""Building the chunk table: read text artifacts, cut, embed, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunks
from ..functions.embed import Embedder, embed_column
from . import textindex
from .store import Store
from .lookup import text_artifacts


@dataclass(frozen=True)
class IndexStats:
    documents: int
    chunks: int
    missing: int


def build_fulltext(store: Store, texts: DataFrame, embedder: Embedder, size: int = 2048, overlap: int = 256, force: bool = False, resume: bool = False) -> IndexStats:
    """Chunks of every text artifact in ``texts`` (id, name, text), embedded.

    ``resume`` keeps the documents that have chunks and adds the others; chunks
    and the table that describes them come into force together, so a document
    has all its chunks or none.
    Artifacts without a text are counted, not fatal.
    """
    if force and resume:
        raise ValueError("force and resume exclude each other")
    if store.exists("chunks") and not (force or resume):
        raise FileExistsError("chunks exist; pass force or resume")
    todo = text_artifacts(store.read("artifacts")).select("id", "name").distinct()
    old = store.read("chunks") if resume and store.exists("chunks") else None
    if old is not None:
        todo = todo.join(old.select(F.col("doc_id").alias("id")), "id", "left_anti")
    named = todo.join(texts.select("id", "name", "text"), ["id", "name"], "left")
    missing = named.where("text IS NULL").count()
    keyed = named.where("text IS NOT NULL").select(F.to_json(F.struct("id", "name")).alias("key"), "text")
    parts = F.from_json("key", "id string, name string")
    cut = chunks(keyed, "key", "text", size, overlap).select(parts["id"].alias("doc_id"), "chunk_idx", parts["name"].alias("artifact_name"), F.col("chunk").alias("text"))
    fresh = embed_column(cut, "text", embedder)
    t = store.begin()
    if old is None:
        t.put("chunks", fresh)
    else:
        t.merge("chunks", fresh)
    done = t.read("chunks")
    n = done.agg(F.count("*"), F.count_distinct("doc_id")).first()
    dim = done.select(F.size("vector")).first()
    meta = [(embedder.model, dim[0] if dim else 0, size, overlap, n[1], n[0])]
    index = textindex.rows(done.select(textindex.chunk_key().alias("key"), "text"), "key", "text")
    t.put("chunks_postings", index.postings, "bucket")
    t.put("chunks_lengths", index.documents)
    t.put("_meta", done.sparkSession.createDataFrame(meta, "embed_model string, dim int, chunk_bytes int, chunk_overlap int, documents long, chunks long").withColumn("built_at", F.unix_timestamp()))
    t.commit()
    return IndexStats(n[1], n[0], missing)


def build_raw(store: Store, fetched: DataFrame, with_text: bool = True) -> dict[str, int]:
    """Add the bytes in ``fetched`` (id, name, data) of candidates that the raw store lacks; stored, skipped, missing."""
    from .artifacts import to_store
    from .lookup import raw_candidates

    candidates = raw_candidates(store.read("artifacts"), with_text).dropDuplicates(["id", "name"])
    old = store.read("raw_artifacts") if store.exists("raw_artifacts") else None
    todo = candidates if old is None else to_store(candidates, old)
    found = todo.join(fetched.select("id", "name", "data").dropDuplicates(["id", "name"]), ["id", "name"]).select("id", "name", "media_type", "size", "md5", "data")
    total, open_ = candidates.count(), todo.count()
    t = store.begin()
    before = 0 if old is None else old.count()
    t.merge("raw_artifacts", found)
    t.commit()
    stored = store.read("raw_artifacts").count() - before
    return {"stored": stored, "skipped": total - open_, "missing": open_ - stored}
