"""Text and vector search over the archive and the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunks
from ..operators import search as S
from ..operators import textindex
from ..operators import vectors as V
from ..session import intermediates, table

QUERY = "nationwide rebate of the litigation team"
META_QUERY = "complaint Quarterly golbeck marketing"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(10)


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, d: str, name: str, key: str, body: str) -> textindex.TextIndex:
    """The stored full-text index of a table, built once an application."""
    built = spark.sparkContext.__dict__.setdefault("_dossierkit_indexes", {})
    path = built.get((d, name, body))
    if path is None:
        path = f"{intermediates(spark)}/index-{uuid.uuid4().hex}"
        textindex.save(textindex.rows(table(spark, d, name).select(key, body).dropDuplicates([key]), key, body), path)
        built[d, name, body] = path
    return textindex.load(spark, path)


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same scores as ``bm25_scores``, from a stored index: only the asked terms' postings are read."""
    return textindex.search(_index(spark, d, "documents", "doc_id", "text"), QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _keyword(spark: SparkSession, d: str, params: S.SearchParams) -> DataFrame:
    hits = textindex.search(_index(spark, d, "doc_meta", "id", "search_text"), params.query).withColumnRenamed("key", "id")
    return S.keyword_search(table(spark, d, "doc_meta"), params, hits)


def keyword_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, S.SearchParams(META_QUERY, limit=20, offset=5))


def keyword_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, S.SearchParams(META_QUERY, media_type="text/plain", limit=20))


def keyword_search_unindexed(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "doc_meta"), S.SearchParams(META_QUERY, limit=20, offset=5))


def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", S.snippet(F.col("text")).alias("snippet"))


def chunk_utf8(spark: SparkSession, d: str) -> DataFrame:
    return chunks(table(spark, d, "documents"), "doc_id", "text")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(_queries(spark, d), table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(_queries(spark, d), table(spark, d, "embeddings"), "vec_id", "embedding", 10, "cosine")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """BM25 on the corpus fused with the vectors nearest to vector 0; vec_id stands for doc_id."""
    text = bm25_topk(spark, d).select("doc_id", F.row_number().over(_by_score()).alias("rank"))
    vec = V.nearest(table(spark, d, "embeddings").where("vec_id = 0"), table(spark, d, "embeddings"), "vec_id", "embedding", 50).select(F.col("vec_id").alias("doc_id"), "rank")
    return V.fuse([text, vec], ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))


def _by_score():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "doc_id")


def _best_chunk(cut: DataFrame) -> DataFrame:
    cut = cut.withColumn("key", F.concat("doc_id", F.lit("#"), "chunk_idx"))
    hits = S.bm25(cut, "key", "chunk", QUERY).select(F.split("key", "#")[0].cast("long").alias("doc_id"), F.split("key", "#")[1].cast("int").alias("chunk_idx"), F.round("score", 6).alias("score"))
    return V.collapse(hits, "doc_id", [F.desc("score"), "chunk_idx"])


def hybrid_collapse_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Each document's best chunk for the query, of every text."""
    return _best_chunk(chunk_utf8(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector ranking, 50 each, fused, hydrated, and the best hit of each source; vec_id stands for doc_id."""
    vectors = table(spark, d, "embeddings")
    best = bm25_indexed(spark, d).orderBy(F.desc("score"), "doc_id").limit(50)
    words = best.select("doc_id", F.row_number().over(_by_score()).alias("rank"))
    near = V.nearest(vectors.where("vec_id = 0"), vectors, "vec_id", "embedding", 50).select(F.col("vec_id").alias("doc_id"), "rank")
    fused = V.fuse([words, near], ["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))
    full = V.hydrate(fused, table(spark, d, "documents"), "doc_id", {"lang": "", "source": ""})
    return V.collapse(full, "source", [F.desc("score"), "doc_id"])


def hybrid_hydrate_left(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors with their documents; a vector without one is kept with defaults."""
    hits = vector_topk_l2(spark, d).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return V.hydrate(hits, table(spark, d, "documents"), "doc_id", {"lang": "", "source": "", "n_chars": 0})


_TOKENS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"
_TERMS = ["nationwide", "rebate", "of", "the", "litigation", "team"]


def _bm25_sql(rows: str, key: str, words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"(CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END)" for i in range(len(words)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"""tok AS (SELECT {key}, t, len(t) AS dl, {tf} FROM ({rows})),
st AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM tok),
bm AS (SELECT {key}, {score} AS score FROM tok, st WHERE {some})"""


_DOC_BM = _bm25_sql(f"SELECT doc_id, {_TOKENS.format(t='text')} AS t FROM documents WHERE text IS NOT NULL", "doc_id", _TERMS)
# bytes as hex digits: a byte whose first digit is 8, 9, A or B goes on with a character
_BLANK = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _forward(p: str) -> str:
    """SQL for the first byte at or after ``p`` that begins a character of the text of hex digits ``h``."""
    on = lambda i: f"substr(h, 2 * ({p} + {i}) + 1, 1) IN ('8', '9', 'A', 'B')"
    return f"({p} + CASE WHEN NOT {on(0)} THEN 0 WHEN NOT {on(1)} THEN 1 WHEN NOT {on(2)} THEN 2 ELSE 3 END)"


_BACK = "CASE " + " ".join(f"WHEN substr(h, 2 * (280 - {k}) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN {k}" for k in range(3)) + " ELSE 3 END"
_CHUNK_SQL = f"""hexed AS (SELECT doc_id, hex(encode(b)) AS h, strlen(b) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS b FROM documents WHERE text IS NOT NULL) WHERE b <> ''),
cuts(doc_id, chunk_idx, s) AS (SELECT doc_id, 0, CAST(0 AS BIGINT) FROM hexed UNION ALL SELECT c.doc_id, chunk_idx + 1, CAST({_forward('(c.s + 1792)')} AS BIGINT) FROM cuts c JOIN hexed USING (doc_id)
  WHERE {_forward('least(c.s + 2048, n)')} < n),
chunked AS (SELECT doc_id, chunk_idx, decode(unhex(substr(h, 2 * s + 1, 2 * (CAST({_forward('least(s + 2048, n)')} AS BIGINT) - s)))) AS chunk FROM cuts JOIN hexed USING (doc_id))"""


def _search_sql(media: str, limit: int, offset: int) -> str:
    words = ["complaint", "quarterly", "golbeck", "marketing"]
    bm = _bm25_sql(f"SELECT id, {_TOKENS.format(t='search_text')} AS t FROM base WHERE search_text IS NOT NULL", "id", words)
    texts = {f: f"coalesce(lower({f}), '')" for f in ("title", "bn", "topic", "description", "keywords")} | {
        f: f"lower(array_to_string(list_filter({f}, lambda x: x IS NOT NULL AND x <> ''), ' '))" for f in ("authors", "custodian", "recipients")
    }
    cols = ", ".join(f"coalesce({t}, '') AS x_{f}" for f, t in texts.items())
    every = " || ' ' || ".join(f"x_{f}" for f in texts)
    score = " + ".join(f"CAST(contains({every}, '{w}') AS INTEGER)" for w in words)
    found = ", ".join(f"CASE WHEN {' OR '.join(f"contains(x_{f}, '{w}')" for w in words)} THEN '{f}' END" for f in texts)
    want = max(4 * (limit + offset), 50)
    return f"""WITH base AS (SELECT DISTINCT ON (id) * FROM doc_meta), {bm},
best AS (SELECT id, round(score, 9) AS bm25 FROM bm ORDER BY round(score, 9) DESC, id LIMIT {want}),
txt AS (SELECT id, bm25, {cols} FROM base JOIN best USING (id) {media}),
sc AS (SELECT id, bm25, {score} AS score, list_filter([{found}], lambda x: x IS NOT NULL) AS matched_fields FROM txt)
SELECT id, score, matched_fields FROM sc WHERE score > 0 ORDER BY score DESC, bm25 DESC, id LIMIT {limit} OFFSET {offset}"""


def _knn_sql(distance: str) -> str:
    return f"""SELECT query_id, vec_id, distance, rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id, {distance} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, v.vec_id) AS INTEGER) AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""


_L2 = "round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_COS = "round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scores, bm25_indexed, keyword_search_ranked, keyword_search_filtered, keyword_search_unindexed, term_document_frequency, snippets, chunk_utf8, vector_topk_l2, vector_topk_cosine, rrf_fusion,
        hybrid_collapse_utf8, hybrid_hydrate_left, hybrid_search,
    )
}

SQL = {
    "bm25_topk": f"WITH {_DOC_BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 10",
    "bm25_scores": f"WITH {_DOC_BM} SELECT doc_id, round(score, 6) AS score FROM bm",
    "keyword_search_ranked": _search_sql("", 20, 5),
    "keyword_search_filtered": _search_sql("WHERE list_contains(artifact_types, 'text/plain')", 20, 0),
    "term_document_frequency": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "bm25_indexed": f"WITH {_DOC_BM} SELECT doc_id, round(score, 6) AS score FROM bm",
    "keyword_search_unindexed": _search_sql("", 20, 5),
    "chunk_utf8": f"WITH RECURSIVE {_CHUNK_SQL} SELECT doc_id, chunk_idx, chunk FROM chunked",
    "snippets": f"""SELECT doc_id, CASE WHEN n <= 280 THEN s ELSE decode(unhex(substr(h, 1, 2 * (280 - {_BACK})))) || '…' END AS snippet
FROM (SELECT doc_id, s, hex(encode(s)) AS h, strlen(s) AS n FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{000B}}]+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL))""",
    "vector_topk_l2": _knn_sql(_L2),
    "vector_topk_cosine": _knn_sql(_COS),
    "rrf_fusion": f"""WITH {_DOC_BM},
t AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10),
v AS (SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id = 0 QUALIFY rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc_id""",
    "hybrid_collapse_utf8": f"""WITH RECURSIVE {_CHUNK_SQL}, {_bm25_sql(f"SELECT doc_id, chunk_idx, {_TOKENS.format(t='chunk')} AS t FROM chunked", "doc_id, chunk_idx", _TERMS)}
SELECT doc_id, chunk_idx, score FROM (SELECT doc_id, chunk_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, chunk_idx) AS k FROM bm) WHERE k = 1""",
    "hybrid_search": f"""WITH {_DOC_BM},
t AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50),
v AS (SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id = 0 QUALIFY rank <= 50),
f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc_id),
h AS (SELECT f.doc_id, score, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM f LEFT JOIN documents d ON d.doc_id = f.doc_id)
SELECT doc_id, score, lang, source FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1""",
    "hybrid_hydrate_left": f"""WITH hits AS ({_knn_sql(_L2)})
SELECT query_id, h.vec_id AS doc_id, rank, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars, 0) AS n_chars FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id""",
}
