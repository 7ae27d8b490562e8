"""The eight tools of the archive: plain callables over a set of tables.

Only here rows reach the driver: never more than a tool's bound, or one document's
artifacts and neighbourhood, which come a partition at a time.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embed import Embedder, HashingEmbedder
from .operators import artifacts as A
from .operators import lookup as L
from .operators import textindex
from .operators import vectors as V
from .operators.graph import related
from .operators.search import SearchParams, bm25, keyword_search, snippet
from .operators.textindex import TextIndex
from .operators.store import Store
from .operators.sqlguard import SqlResult, describe_schema, run_sql
from .schema import DOCUMENTS


@dataclass
class Archive:
    """Tables of an archive; ``chunks``, ``raw``, ``files`` and the stored full-text indexes (of documents by id, of chunks by key) may be missing."""

    spark: SparkSession
    documents: DataFrame
    artifacts: DataFrame
    chunks: DataFrame | None = None
    raw: DataFrame | None = None
    files: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    embed_model: str | None = None  # model the chunks were embedded with
    text_index: TextIndex | None = None
    chunk_index: TextIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, store: Store, files: DataFrame | None = None, embedder: Embedder | None = None) -> Archive:
        """The archive in a store, with its indexes as far as they are built."""
        got = {n: store.read(n) if store.exists(n) else None for n in ("chunks", "raw_artifacts", "_meta")}
        meta = got["_meta"].first() if got["_meta"] is not None else None
        model = meta["embed_model"] if meta else None
        return cls(
            spark, store.read("documents"), store.read("artifacts"), got["chunks"], got["raw_artifacts"], files, embedder or HashingEmbedder(), model,
            textindex.stored(store, "documents"), textindex.stored(store, "chunks"),
        )

    def _tables(self) -> dict[str, DataFrame]:
        known = {"documents": self.documents, "artifacts": self.artifacts}
        return known | ({"chunks": self.chunks} if self.chunks is not None else {})

    def _columns(self) -> list[str]:
        return [c for c in DOCUMENTS.names if c in self.documents.columns]

    def search_documents(self, query: str, media_type: str | None = None, limit: int | None = None, offset: int = 0) -> dict:
        params = SearchParams(query, media_type, A.clamp(limit, A.HITS), max(offset, 0))
        if not query.strip():
            return {"count": 0, "hits": []}
        found = None if self.text_index is None else textindex.search(self.text_index, query).withColumnRenamed("key", "id")
        hits = [r.asDict() for r in keyword_search(self.documents, params, found).collect()]
        rows = self._by_id([h["id"] for h in hits])
        return {"count": len(hits), "hits": [{"document": rows.get(h["id"], {"id": h["id"]}), "score": h["score"], "matched_fields": h["matched_fields"]} for h in hits]}

    def _by_id(self, ids: list[str]) -> dict[str, dict]:
        if not ids:
            return {}
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return {r["id"]: r.asDict() for r in L.get_many(self.documents.select(*self._columns()).dropDuplicates(["id"]), wanted).drop("pos").collect()}

    def hybrid_search(self, query: str, limit: int | None = None, factor: int = 5) -> dict:
        """Keyword and vector ranking of chunks, fused, the best chunk of each document; missing documents keep their hit."""
        if self.chunks is None:
            return {"error": "the full-text index is not built"}
        n = A.clamp(limit, A.HITS)
        if not query.strip():
            return {"count": 0, "hits": []}
        if self.embed_model is not None and self.embed_model != self.embedder.model:
            return {"error": f"chunks were embedded with {self.embed_model}, not {self.embedder.model}"}
        keyed = self.chunks.withColumn("key", textindex.chunk_key())
        scored = bm25(keyed, "key", "text", query) if self.chunk_index is None else textindex.search(self.chunk_index, query)
        words = scored.orderBy(F.desc(F.round("score", 9)), "key").limit(factor * n)
        from pyspark.sql import Window

        by_words = words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "key"))).select("key", "rank")
        asked = self.spark.createDataFrame([(0, [float(x) for x in self.embedder.embed([query])[0]])], "key long, vector array<float>")
        near = V.nearest(asked, keyed.select("key", "vector"), "key", "vector", factor * n).select("key", "rank")
        fused = V.fuse([by_words, near], ["key"]).orderBy(F.desc("score"), "key").limit(factor * n)
        hits = keyed.join(F.broadcast(fused), "key").select("doc_id", "artifact_name", snippet(F.col("text")).alias("snippet"), "score", "key")
        best = V.collapse(hits, "doc_id", [F.desc("score"), "key"]).orderBy(F.desc("score"), "key").limit(n)
        found = [r.asDict() for r in best.drop("key").collect()]
        rows = self._by_id([h["doc_id"] for h in found])
        return {"count": len(found), "hits": [{"document": rows.get(h["doc_id"], {"id": h["doc_id"]}), **{k: h[k] for k in ("score", "artifact_name", "snippet")}} for h in found]}

    def _data(self, wanted: DataFrame) -> DataFrame | None:
        none = self.spark.createDataFrame([], "id string, name string, data binary")
        if self.raw is None and self.files is None:
            return None
        return A.resolve_tiers(wanted, self.raw if self.raw is not None else none, self.files if self.files is not None else none)

    def get_artifact_text(self, id: str, name: str, media_type: str | None = None, offset: int = 0, max_bytes: int | None = None) -> dict:
        wanted = self.spark.createDataFrame([(id, name, media_type)], "id string, name string, media_type string")
        data = self._data(wanted)
        configured = data is not None
        rows = data.where("data IS NOT NULL") if configured else self.spark.createDataFrame([], "id string, name string, data binary")
        return A.read_text(wanted, rows, max(offset, 0), A.clamp(max_bytes, A.TEXT_PAGE), configured).first().asDict()

    def get_artifact_bytes(self, id: str, name: str, offset: int = 0, max_bytes: int | None = None) -> dict:
        wanted = self.spark.createDataFrame([(id, name)], "id string, name string")
        data = self._data(wanted)
        if data is None:
            return {"id": id, "name": name, "status": "not_configured"}
        tier = data.first()
        if tier["tier"] is None:
            return {"id": id, "name": name, "status": "missing"}
        page = A.read_bytes(data, max(offset, 0), A.clamp(max_bytes, A.BYTE_PAGE)).first().asDict()
        return page | {"status": "loaded", "tier": tier["tier"]}

    def run_sql(self, sql: str, limit: int | None = None) -> SqlResult:
        return run_sql(self.spark, sql, self._tables(), A.clamp(limit, A.SQL_ROWS))

    def describe_schema(self) -> list[dict]:
        return [r.asDict() for r in describe_schema(self.spark, self._tables()).orderBy("table_name", "position").collect()]

    def get_document(self, id: str | None = None, bn: str | None = None) -> dict:
        key = id or bn
        if not key:
            raise ValueError("id or bn must be given")
        found = L.resolve(self.documents, self.spark.createDataFrame([(key,)], "key string")).first()
        if found is None:
            return {"found": False, "document": None, "artifacts": []}
        document = self._by_id([found["id"]])[found["id"]]
        parts = self.artifacts.where(F.col("id") == found["id"]).distinct().orderBy("name")
        return {"found": True, "document": document, "artifacts": [r.asDict() for r in parts.toLocalIterator()]}

    def get_related(self, start: str, depth: int = 1, most: int | None = None) -> dict:
        """The graph around a document, whole; with ``most``, its first edges and nodes by depth, kind and id, the true counts, and whether it was cut."""
        graph = related(self.documents, start, depth)
        edges = graph.edges.orderBy("depth", "from_id", "kind", "reference", "neighbor_id")
        nodes = self.documents.select(*self._columns()).dropDuplicates(["id"]).join(graph.nodes, "id", "left_semi").orderBy("id")
        n_edges, n_nodes = graph.edges.count(), graph.nodes.count()
        if most is not None:
            edges, nodes = edges.limit(most), nodes.limit(most)
        shown = {"nodes": {r["id"]: r.asDict() for r in nodes.toLocalIterator()}, "edges": [r.asDict() for r in edges.toLocalIterator()]}
        return {"edge_count": n_edges, "node_count": n_nodes, "truncated": most is not None and max(n_edges, n_nodes) > most, "graph": shown}


TOOLS = ("search_documents", "hybrid_search", "get_artifact_text", "get_artifact_bytes", "run_sql", "describe_schema", "get_document", "get_related")


def as_json(result: object) -> object:
    return asdict(result) if isinstance(result, SqlResult) else result
