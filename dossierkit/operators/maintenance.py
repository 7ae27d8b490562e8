"""Counts, statistics, layout and compaction of an archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textindex
from .store import Store

#: Columns by which the files of a table are laid out, so that their minima and maxima prune.
SORTED_BY = {"documents": ["id", "bn", "conversation"], "artifacts": ["id", "name", "media_type"], "raw_artifacts": ["id", "name"], "chunks": ["doc_id", "artifact_name", "chunk_idx"]}


def counts(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: number of documents, artifacts, text artifacts, and artifacts to store raw."""
    d = documents.agg(F.count("*").alias("documents"))
    a = artifacts.agg(F.count("*").alias("artifacts"), F.count_if(F.col("media_type") == "text/plain").alias("text_artifacts"), F.count_if(F.col("media_type") != "text/plain").alias("raw_artifacts"))
    return d.join(F.broadcast(a))


def sample_document(documents: DataFrame, since: str | None = None) -> DataFrame:
    """The document of the smallest id, or the smallest modified at or after ``since``."""
    rows = documents if since is None else documents.where(F.col("ddmudate") >= since)
    return rows.orderBy("id").limit(1)


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents with chunks, chunks, and their bytes of text."""
    return chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.octet_length("text")).alias("bytes"))


def compact(store: Store, table: str, rows_per_file: int = 1_000_000, bytes_per_file: int = 256 << 20) -> int:
    """Rewrite a table in few files sorted by its keys, of about so many rows or stored bytes, whichever are fewer; the rows stay the same."""
    df = store.read(table)
    files = max(1, -(-df.count() // rows_per_file), -(-store.size(table) // bytes_per_file))
    keys = [c for c in SORTED_BY.get(table, df.columns[:1]) if c in df.columns]
    return store.write(table, df.repartitionByRange(files, *keys).sortWithinPartitions(*keys))


def index_documents(store: Store) -> None:
    """Build the full-text index over ``search_text``; ``apply`` keeps it current."""
    docs = store.read("documents").select("id", "search_text").dropDuplicates(["id"])
    textindex.store(store, "documents", textindex.rows(docs, "id", "search_text"))


def format_bytes(n: float) -> str:
    """Bytes in binary units with one decimal."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PiB"


def format_count(n: int) -> str:
    """Counts in thousands and millions with one decimal."""
    return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}K" if n >= 1_000 else str(n)
