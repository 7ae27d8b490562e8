"""Lookups, mapping, incremental maintenance, artifacts, graph and SQL over the archive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fnv import with_fnv1a
from ..operators import ann
from ..operators import artifacts as A
from ..operators import ingest as I
from ..operators import lookup as L
from ..operators import maintenance
from ..operators import mapping as M
from ..operators import vectors as V
from ..operators.graph import related
from ..operators.sqlguard import describe_schema, frame, run_sql
from ..schema import LISTS, items, size
from ..session import intermediates, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Lookups


@query("SELECT DISTINCT id, bn, title FROM doc_meta WHERE genre = 'memo' AND bn IS NOT NULL")
def documents_where(spark: SparkSession, d: str) -> DataFrame:
    return L.where(table(spark, d, "doc_meta"), (F.col("genre") == "memo") & F.col("bn").isNotNull(), ["id", "bn", "title"]).distinct()


@query("SELECT DISTINCT id, bn, title FROM doc_meta WHERE id = (SELECT min(id) FROM doc_meta)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc_meta")
    return L.where(docs, F.col("id") == docs.agg(F.min("id")).first()[0], ["id", "bn", "title"]).distinct()


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Positions and neighbours of all edges, in the order of the edges: many repeated, some missing."""
    return table(spark, d, "graph_edges").select(F.col("edge_no").alias("pos"), F.lower(F.trim("neighbor_id")).alias("id"))


@query("""WITH w AS (SELECT lower(trim(neighbor_id)) AS id, min(edge_no) AS pos FROM graph_edges WHERE neighbor_id IS NOT NULL GROUP BY 1)
SELECT DISTINCT d.id, d.title, w.pos FROM doc_meta d JOIN w ON w.id = d.id ORDER BY pos""")
def get_many_ordered(spark: SparkSession, d: str) -> DataFrame:
    return L.get_many(table(spark, d, "doc_meta").select("id", "title").distinct(), _wanted(spark, d)).select("id", "title", "pos")


@query("SELECT DISTINCT lower(trim(neighbor_id)) AS id FROM graph_edges WHERE lower(trim(neighbor_id)) IN (SELECT id FROM doc_meta)")
def existing_ids(spark: SparkSession, d: str) -> DataFrame:
    return L.existing(table(spark, d, "doc_meta"), _wanted(spark, d))


@query("SELECT DISTINCT id, digest FROM doc_meta WHERE digest IS NOT NULL AND id IN (SELECT lower(trim(neighbor_id)) FROM graph_edges)")
def document_digests(spark: SparkSession, d: str) -> DataFrame:
    return L.digests(table(spark, d, "doc_meta"), _wanted(spark, d))


@query("SELECT id, list_sort(list(DISTINCT coalesce(name, '') || chr(0) || coalesce(md5, ''))) AS keys FROM artifacts GROUP BY id")
def artifact_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return L.artifact_digests(table(spark, d, "artifacts"))


@query("""WITH keys AS (SELECT DISTINCT key FROM (SELECT bn AS key FROM withdrawals UNION ALL SELECT from_id FROM graph_edges UNION ALL SELECT reference FROM graph_edges) WHERE key IS NOT NULL),
bybn AS (SELECT bn AS key, min(id) AS id FROM doc_meta WHERE bn IS NOT NULL GROUP BY bn)
SELECT k.key, coalesce(i.id, b.id) AS id FROM keys k LEFT JOIN (SELECT DISTINCT id FROM doc_meta) i ON i.id = k.key LEFT JOIN bybn b ON b.key = k.key WHERE coalesce(i.id, b.id) IS NOT NULL""")
def resolve_id_or_bn(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "graph_edges")
    keys = table(spark, d, "withdrawals").select(F.col("bn").alias("key")).unionByName(edges.select(F.col("from_id").alias("key"))).unionByName(edges.select(F.col("reference").alias("key")))
    return L.resolve(table(spark, d, "doc_meta"), keys)


@query("SELECT DISTINCT d.id, d.conversation FROM doc_meta d WHERE conversation IN (SELECT reference FROM graph_edges WHERE kind = 'conversation')")
def documents_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    threads = table(spark, d, "graph_edges").where("kind = 'conversation'").select("reference")
    return L.by_conversations(table(spark, d, "doc_meta"), threads).select("id", "conversation")


@query("SELECT DISTINCT d.id, d.bn FROM doc_meta d WHERE bn IN (SELECT reference FROM graph_edges WHERE kind <> 'conversation')")
def documents_by_bns(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "graph_edges").where("kind <> 'conversation'").select("reference")
    return L.by_bns(table(spark, d, "doc_meta"), asked).select("id", "bn")


@query("""SELECT DISTINCT d.id, d.title, a.name, a.media_type, CASE WHEN a.size IS NOT NULL THEN greatest(a.size, 0) END AS size FROM doc_meta d JOIN artifacts a ON a.id = d.id""")
def documents_with_artifacts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc_meta").select("id", "title")
    return docs.join(table(spark, d, "artifacts").select("id", "name", "media_type", size("size").alias("size")), "id").distinct()


@query("SELECT DISTINCT id, list_filter(attachments, lambda x: x IS NOT NULL AND x <> '') AS attachments FROM doc_meta WHERE len(list_filter(attachments, lambda x: x IS NOT NULL AND x <> '')) > 0")
def nonempty_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_meta").select("id", items("attachments").alias("attachments")).where(F.size("attachments") > 0).distinct()


@query("SELECT id, name, media_type FROM artifacts WHERE media_type = 'text/plain' ORDER BY id NULLS FIRST, name NULLS FIRST")
def text_artifact_scan(spark: SparkSession, d: str) -> DataFrame:
    return L.text_artifacts(table(spark, d, "artifacts"))


@query("SELECT * FROM artifacts WHERE media_type <> 'text/plain'")
def raw_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.raw_candidates(table(spark, d, "artifacts"), with_text=False)


# Mapping


def _ls(c: str) -> str:
    return f"array_to_string(list_filter({c}, lambda x: x IS NOT NULL AND x <> ''), ' ')"


@query(f"""SELECT DISTINCT id, concat_ws(' ', nullif(title, ''), nullif(bn, ''), nullif(topic, ''), nullif(description, ''), nullif(keywords, ''), nullif({_ls('authors')}, ''), nullif({_ls('custodian')}, ''),
nullif({_ls('recipients')}, '')) AS search_text FROM doc_meta""")
def search_text_concat(spark: SparkSession, d: str) -> DataFrame:
    text = M.search_text([F.col(c) for c in ("title", "bn", "topic", "description", "keywords")], [items(c) for c in ("authors", "custodian", "recipients")])
    return table(spark, d, "doc_meta").select("id", text.alias("search_text")).distinct()


_DIGESTED = ["id", "title", "industry", "collection", "genre", "date_sent", "date_received", "topic", "description", "keywords", "conversation"]


@query(f"""WITH k AS (SELECT id, list_sort(list(DISTINCT coalesce(name, '') || chr(0) || coalesce(md5, ''))) AS keys FROM artifacts GROUP BY id)
SELECT DISTINCT d.id, substr(md5(concat_ws(chr(31), {', '.join(f"coalesce(d.{c}, '')" for c in _DIGESTED)}, {', '.join(f"coalesce(array_to_string(list_filter(d.{c}, lambda x: x IS NOT NULL AND x <> ''), chr(30)), '')" for c in LISTS)},
coalesce(array_to_string(keys, chr(30)), ''))), 1, 16) AS digest FROM doc_meta d LEFT JOIN k ON k.id = d.id""")
def document_digest(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "doc_meta").join(L.artifact_digests(table(spark, d, "artifacts")), "id", "left")
    digest = M.digest([F.col(c) for c in _DIGESTED], [items(c) for c in LISTS], F.coalesce("keys", F.array().cast("array<string>")))
    return keyed.select("id", digest.alias("digest")).distinct()


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Source records as a search server gives them, made of the archive's own rows: artifacts as JSON texts in a list."""
    arts = table(spark, d, "artifacts").distinct().groupBy("id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("name", F.col("media_type").alias("mediaType"), "size", "md5")))).alias("j")
    )
    docs = table(spark, d, "doc_meta").distinct().join(arts, "id", "left")
    record = F.to_json(F.struct(
        "id", "bn", F.col("title").alias("ti"), "industry", F.array("collection").alias("collection"), "genre", F.array("date_sent").alias("datesent"), F.array("date_received").alias("datereceived"), "topic",
        F.col("description").alias("desc"), F.col("keywords").alias("kw"), "conversation", "custodian", F.col("authors").alias("au"), F.col("recipients").alias("rc"), "cc", F.col("attachments").alias("attachment"),
        "related", F.col("mentions").alias("men"), F.array("ddmudate").alias("ddmudate"), F.array("j").alias("artifact"),
    ))
    return docs.select(record.alias("record"))


@query("SELECT DISTINCT id, name, media_type, size, md5 FROM artifacts WHERE id IN (SELECT id FROM doc_meta)")
def explode_artifacts_json(spark: SparkSession, d: str) -> DataFrame:
    return M.explode_artifacts(M.map_records(_records(spark, d))).distinct()


@query("""WITH a AS (SELECT DISTINCT id, name, media_type, size, md5 FROM artifacts),
k AS (SELECT id, count(*) AS n, list_sort(list(DISTINCT media_type) FILTER (media_type IS NOT NULL)) AS types FROM a GROUP BY id)
SELECT DISTINCT d.id, d.bn, d.title, d.collection, d.date_sent, list_filter(d.authors, lambda x: x IS NOT NULL) AS authors, d.ddmudate, coalesce(k.n, 0) AS artifact_count, coalesce(k.types, []) AS artifact_types
FROM doc_meta d LEFT JOIN k ON k.id = d.id""")
def map_records(spark: SparkSession, d: str) -> DataFrame:
    return M.map_records(_records(spark, d)).select("id", "bn", "title", "collection", "date_sent", "authors", "ddmudate", "artifact_count", F.sort_array("artifact_types").alias("artifact_types")).distinct()


# Incremental maintenance: stored are the rows that reached the archive before 2021, incoming the others and the withdrawn


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gone = table(spark, d, "withdrawals").select("id", F.lit(True).alias("w")).distinct()
    docs = table(spark, d, "doc_meta").distinct().join(gone, "id", "left").withColumn("redacted", F.coalesce("w", F.lit(False))).drop("w")
    stored = docs.where("ingested_at < timestamp '2021-01-01'").drop("redacted")
    # an edit of the title gives emails another digest
    edited = F.when(F.col("conversation").isNotNull(), F.concat(F.lit("x"), F.col("digest"))).otherwise(F.col("digest"))
    incoming = docs.where("ingested_at >= timestamp '2020-01-01' OR redacted").withColumn("digest", edited)
    return stored, incoming


_SPLIT_SQL = """WITH docs AS (SELECT DISTINCT d.*, d.id IN (SELECT id FROM withdrawals) AS redacted FROM doc_meta d),
stored AS (SELECT * FROM docs WHERE ingested_at < TIMESTAMP '2021-01-01'),
incoming AS (SELECT * EXCLUDE (digest), CASE WHEN conversation IS NOT NULL THEN 'x' || digest ELSE digest END AS digest FROM docs WHERE ingested_at >= TIMESTAMP '2020-01-01' OR redacted),
classes AS (SELECT DISTINCT i.id, CASE WHEN i.redacted OR i.id NOT IN (SELECT id FROM artifacts) THEN 'redacted' WHEN s.digest IS NULL THEN 'new' WHEN s.digest = i.digest THEN 'unchanged' ELSE 'changed' END AS class
  FROM incoming i LEFT JOIN (SELECT id, min(digest) AS digest FROM stored GROUP BY id) s ON s.id = i.id)
"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _split(spark, d)
    return I.classify(incoming, stored, table(spark, d, "artifacts"))


@query(_SPLIT_SQL + "SELECT id, class FROM classes")
def apply_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@query(_SPLIT_SQL + "SELECT class, count(*) AS n FROM classes GROUP BY class")
def counts_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query(_SPLIT_SQL + """SELECT id, digest, title FROM stored WHERE id NOT IN (SELECT id FROM classes WHERE class IN ('new', 'changed', 'redacted'))
UNION SELECT id, digest, title FROM incoming WHERE id IN (SELECT id FROM classes WHERE class IN ('new', 'changed'))""")
def apply_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _split(spark, d)
    classes = _classes(spark, d)
    delta = incoming.drop("redacted").join(classes.where(F.col("class").isin("new", "changed")), "id", "left_semi")
    kept = I.delete(I.upsert(stored, delta.select(*stored.columns)), classes.where(F.col("class") == "redacted").select("id"))
    return kept.select("id", "digest", "title").distinct()


@query("SELECT * FROM artifacts WHERE id NOT IN (SELECT id FROM withdrawals)")
def apply_delete(spark: SparkSession, d: str) -> DataFrame:
    return I.delete(table(spark, d, "artifacts"), table(spark, d, "withdrawals").select("id"))


# stored artifacts without a checksum stand for files that came anew
_SETS_SQL = """, new_sets AS (SELECT id, list_sort(list(DISTINCT coalesce(name, '') || chr(0) || coalesce(md5, ''))) AS keys FROM artifacts GROUP BY id),
old_sets AS (SELECT id, list_sort(list(DISTINCT coalesce(name, '') || chr(0) || coalesce(md5, ''))) AS keys FROM artifacts WHERE md5 IS NOT NULL GROUP BY id)
"""


@query(_SPLIT_SQL + _SETS_SQL + """SELECT DISTINCT c.id FROM classes c LEFT JOIN new_sets n ON n.id = c.id LEFT JOIN old_sets o ON o.id = c.id
WHERE class = 'redacted' OR (class = 'changed' AND n.keys IS DISTINCT FROM o.keys)""")
def apply_invalidate(spark: SparkSession, d: str) -> DataFrame:
    arts = table(spark, d, "artifacts")
    return I.invalidated(_classes(spark, d), arts, arts.where("md5 IS NOT NULL"))


@query(_SPLIT_SQL + _SETS_SQL + """SELECT i.id, CASE WHEN bool_or(i.redacted) OR any_value(n.keys) IS NULL THEN 'redacted' WHEN NOT bool_or(i.id IN (SELECT id FROM stored)) THEN 'new'
WHEN coalesce(any_value(n.keys), []) = coalesce(any_value(o.keys), []) THEN 'unchanged' ELSE 'changed' END AS class
FROM incoming i LEFT JOIN new_sets n ON n.id = i.id LEFT JOIN old_sets o ON o.id = i.id GROUP BY i.id""")
def dry_run_plan(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _split(spark, d)
    arts = table(spark, d, "artifacts")
    return I.dry_run(incoming, arts, stored, arts.where("md5 IS NOT NULL"))


@query(_SPLIT_SQL + _SETS_SQL + """, plan AS (SELECT i.id, CASE WHEN bool_or(i.redacted) OR any_value(n.keys) IS NULL THEN 'redacted' WHEN NOT bool_or(i.id IN (SELECT id FROM stored)) THEN 'new'
WHEN coalesce(any_value(n.keys), []) = coalesce(any_value(o.keys), []) THEN 'unchanged' ELSE 'changed' END AS class
FROM incoming i LEFT JOIN new_sets n ON n.id = i.id LEFT JOIN old_sets o ON o.id = i.id GROUP BY i.id)
SELECT count(*) AS text_artifacts FROM (SELECT DISTINCT id, name, md5 FROM artifacts WHERE media_type = 'text/plain' AND id IN (SELECT id FROM plan WHERE class IN ('new', 'changed')))""")
def dry_run_refetches(spark: SparkSession, d: str) -> DataFrame:
    return I.text_refetches(dry_run_plan(spark, d), table(spark, d, "artifacts"))


@query("SELECT max(ddmudate) AS watermark FROM doc_meta")
def watermark_max_string(spark: SparkSession, d: str) -> DataFrame:
    return I.watermark(table(spark, d, "doc_meta"))


_CUT = "SELECT DISTINCT id, name FROM artifact_text WHERE status = 'text_loaded'"


@query(f"""WITH cut AS ({_CUT}), raw AS (SELECT DISTINCT id, name FROM artifacts WHERE md5 IS NOT NULL),
a AS (SELECT a.*, greatest(coalesce(size, 0), 0) AS sz, coalesce(media_type = 'text/plain', false) AS is_text, (a.id, a.name) IN (SELECT (id, name) FROM cut) AS cut, (a.id, a.name) IN (SELECT (id, name) FROM raw) AS kept FROM artifacts a)
SELECT count(*) FILTER (is_text) AS text_logical_count, CAST(coalesce(sum(sz) FILTER (is_text), 0) AS BIGINT) AS text_logical_bytes,
count(*) FILTER ((is_text OR coalesce(lower(name) LIKE '%.ocr', false)) AND cut) AS text_real_count, CAST(coalesce(sum(sz) FILTER ((is_text OR coalesce(lower(name) LIKE '%.ocr', false)) AND cut), 0) AS BIGINT) AS text_real_bytes,
count(*) FILTER (media_type IS NOT NULL AND NOT is_text) AS raw_logical_count, CAST(coalesce(sum(sz) FILTER (media_type IS NOT NULL AND NOT is_text), 0) AS BIGINT) AS raw_logical_bytes,
count(*) FILTER (kept AND NOT is_text) AS raw_real_count, CAST(coalesce(sum(sz) FILTER (kept AND NOT is_text), 0) AS BIGINT) AS raw_real_bytes FROM a""")
def store_sizes(spark: SparkSession, d: str) -> DataFrame:
    chunked = table(spark, d, "artifact_text").where("status = 'text_loaded'").select(F.col("id").alias("doc_id"), F.col("name").alias("artifact_name"))
    arts = table(spark, d, "artifacts")
    return I.store_sizes(arts, chunked, arts.where("md5 IS NOT NULL").select("id", "name"))


@query("SELECT DISTINCT id, name FROM artifacts a WHERE media_type = 'text/plain' AND NOT EXISTS (SELECT 1 FROM artifact_text t WHERE t.id = a.id AND status = 'text_loaded')")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "artifact_text").where("status = 'text_loaded'").select("id")
    return L.text_artifacts(table(spark, d, "artifacts")).join(done, "id", "left_anti").select("id", "name").distinct()


@query("SELECT DISTINCT id, name FROM artifacts a WHERE media_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM artifact_text t WHERE t.id = a.id AND t.name = a.name)")
def raw_to_store(spark: SparkSession, d: str) -> DataFrame:
    return A.to_store(L.raw_candidates(table(spark, d, "artifacts")), table(spark, d, "artifact_text")).select("id", "name").distinct()


# Artifacts


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact_text").where("text IS NOT NULL").select("id", "name", F.encode("text", "UTF-8").alias("data")).distinct()


# a page of bytes as hex digits: what is left of a character at either end reads as a replacement character
@query("""WITH t AS (SELECT DISTINCT id, name, media_type FROM artifacts), b AS (SELECT DISTINCT id, name, strlen(text) AS n, hex(encode(text)[101:612]) AS h FROM artifact_text WHERE text IS NOT NULL),
r AS (SELECT t.*, n, h, length(h) // 2 AS m, CASE WHEN NOT (coalesce(media_type = 'text/plain', false) OR coalesce(lower(t.name) LIKE '%.ocr', false)) THEN 'unsupported_artifact_type' WHEN n IS NULL THEN 'artifact_file_missing' ELSE 'text_loaded' END AS status
  FROM t LEFT JOIN b ON b.id = t.id AND b.name = t.name),
l AS (SELECT *, CASE WHEN substr(h, 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 5, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS lead,
  CASE WHEN substr(h, 2 * m - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 2 * m - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 WHEN substr(h, 2 * m - 5, 1) NOT IN ('8', '9', 'A', 'B') THEN 3 ELSE 4 END AS back FROM r),
c AS (SELECT *, CASE WHEN m > lead AND CASE substr(h, 2 * (m - back) + 1, 1) WHEN 'C' THEN 2 WHEN 'D' THEN 2 WHEN 'E' THEN 3 WHEN 'F' THEN 4 ELSE 1 END > back THEN back ELSE 0 END AS tail FROM l)
SELECT id, name, status, CASE WHEN status = 'text_loaded' THEN repeat('\ufffd', lead) || decode(unhex(substr(h, 2 * lead + 1, 2 * (m - lead - tail)))) || CASE WHEN tail > 0 THEN '\ufffd' ELSE '' END END AS text,
CASE WHEN status = 'text_loaded' THEN least(100, n) END AS text_offset, CASE WHEN status = 'text_loaded' THEN least(least(100, n) + 512, n) - least(100, n) END AS returned_bytes,
CASE WHEN status = 'text_loaded' THEN n END AS total_bytes, CASE WHEN status = 'text_loaded' THEN least(least(100, n) + 512, n) < n END AS truncated FROM c""")
def artifact_text_page(spark: SparkSession, d: str) -> DataFrame:
    page = A.read_text(table(spark, d, "artifacts").select("id", "name", "media_type").distinct(), _bytes(spark, d), 100, 512)
    return page.select("id", "name", "status", "text", "text_offset", "returned_bytes", "total_bytes", "truncated")


@query("""SELECT DISTINCT id, name, to_base64(encode(text)[1:300]) AS data_base64, least(300, strlen(text)) AS returned_bytes, strlen(text) AS total_bytes, 300 < strlen(text) AS truncated
FROM artifact_text WHERE text IS NOT NULL""")
def artifact_bytes_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Of every text; a page may cut a character."""
    return A.read_bytes(_bytes(spark, d), 0, 300)


@query("""SELECT DISTINCT a.id, a.name, CASE WHEN r.name IS NOT NULL THEN 'raw' WHEN f.name IS NOT NULL THEN 'artifact_store' END AS tier FROM artifacts a
LEFT JOIN (SELECT DISTINCT id, name FROM artifact_text WHERE source = 'raw') r ON r.id = a.id AND r.name = a.name
LEFT JOIN (SELECT DISTINCT id, name FROM artifact_text WHERE source = 'artifact_store') f ON f.id = a.id AND f.name = a.name""")
def tier_resolution(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "artifact_text").select("id", "name", "source", F.encode("text", "UTF-8").alias("data"))
    return A.resolve_tiers(table(spark, d, "artifacts").select("id", "name").distinct(), data.where("source = 'raw'"), data.where("source = 'artifact_store'")).select("id", "name", "tier")


@query("SELECT DISTINCT id, name, concat_ws('/', 'artifacts', nullif(array_to_string(list_filter(string_split(substr(id, 1, 4), ''), lambda c: c <> ''), '/'), ''), id, name) AS key FROM artifacts")
def fanout_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifacts").select("id", "name", A.fanout_key(F.col("id"), F.col("name")).alias("key")).distinct()


# Graph


def _start(spark: SparkSession, d: str) -> str:
    """The document with most mentions; of several the smallest id."""
    return table(spark, d, "doc_meta").orderBy(F.desc(F.size(items("mentions"))), "id").first()["id"]


def _graph_sql(depth: int) -> str:
    base = """WITH base AS (SELECT DISTINCT ON (id) id, nullif(bn, '') AS bn, nullif(conversation, '') AS conversation, list_filter(attachments, lambda x: x IS NOT NULL AND x <> '') AS a,
 list_filter(related, lambda x: x IS NOT NULL AND x <> '') AS r, list_filter(mentions, lambda x: x IS NOT NULL AND x <> '') AS m FROM doc_meta),
bybn AS (SELECT bn, min(id) AS neighbor_id FROM base WHERE bn IS NOT NULL GROUP BY bn),
refs AS (SELECT id AS from_id, 'attachment' AS kind, unnest(a) AS reference FROM base UNION ALL SELECT id, 'related', unnest(r) FROM base UNION ALL SELECT id, 'mention', unnest(m) FROM base),
alledges AS (SELECT from_id, kind, reference, neighbor_id FROM refs LEFT JOIN bybn ON bybn.bn = refs.reference
 UNION ALL SELECT x.id, 'conversation', x.conversation, y.id FROM base x JOIN base y ON y.conversation = x.conversation),
f1 AS (SELECT id FROM base ORDER BY len(m) DESC, id LIMIT 1),
e1 AS (SELECT *, 1 AS depth FROM alledges WHERE from_id IN (SELECT id FROM f1))"""
    for h in range(2, depth + 1):
        seen = " UNION ".join(f"SELECT id FROM f{i}" for i in range(1, h))
        base += f""",
f{h} AS (SELECT DISTINCT neighbor_id AS id FROM e{h - 1} WHERE neighbor_id IS NOT NULL AND neighbor_id NOT IN ({seen})),
e{h} AS (SELECT *, {h} AS depth FROM alledges WHERE from_id IN (SELECT id FROM f{h}))"""
    return base + " " + " UNION ALL ".join(f"SELECT * FROM e{h}" for h in range(1, depth + 1))


def _graph(depth: int):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return related(table(spark, d, "doc_meta"), _start(spark, d), depth).edges

    return run


for _depth in (1, 2, 3):
    QUERIES[f"graph_related_depth{_depth}"] = _graph(_depth)
    SQL[f"graph_related_depth{_depth}"] = _graph_sql(_depth)


@query(f"SELECT DISTINCT neighbor_id AS id FROM ({_graph_sql(2)}) WHERE neighbor_id IS NOT NULL UNION SELECT from_id FROM ({_graph_sql(1)})")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return related(table(spark, d, "doc_meta"), _start(spark, d), 2).nodes


# Guarded SQL


def _guarded(name: str, sql: str, tables: tuple[str, ...], oracle: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return frame(spark, sql, {t: table(spark, d, t) for t in tables})

    QUERIES[name] = run
    SQL[name] = oracle or sql


_guarded("sql_join_agg", """SELECT n_name, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_quantity) AS avg_qty
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name, l_returnflag HAVING count(*) > 1""", ("lineitem", "orders", "customer", "nation"))
_guarded("sql_cube", """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
         ("lineitem",))
_guarded("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", ("orders",))
_guarded("sql_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", ("part",))
_guarded("sql_window", """SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""", ("orders",))
_guarded("sql_setops", """SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier INTERSECT SELECT p_partkey FROM part""", ("customer", "orders", "supplier", "part"))
_guarded("sql_unnest", "SELECT kind, who, count(*) AS n FROM (SELECT 'author' AS kind, explode(authors) AS who FROM doc_meta UNION ALL SELECT 'cc', explode(cc) FROM doc_meta) GROUP BY kind, who", ("doc_meta",),
         "SELECT kind, who, count(*) AS n FROM (SELECT 'author' AS kind, unnest(authors) AS who FROM doc_meta UNION ALL SELECT 'cc', unnest(cc) FROM doc_meta) GROUP BY kind, who")
_guarded("sql_semi_anti", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
         ("customer", "orders"))
_guarded("sql_outer_joins", """SELECT r_name, n_name, count(c_custkey) AS n FROM region FULL OUTER JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY r_name, n_name""",
         ("region", "nation", "customer"))
_guarded("sql_scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)", ("part",))
_guarded("sql_theta_join", "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey", ("supplier",))
_guarded("sql_cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", ("region",))
_guarded("sql_case_strings", """SELECT genre, count(*) AS n, sum(CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END) AS untitled, max(length(title)) AS longest, min(lower(trim(title))) AS first_title FROM doc_meta GROUP BY genre""",
         ("doc_meta",), """SELECT genre, count(*) AS n, CAST(sum(CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END) AS BIGINT) AS untitled, max(length(title)) AS longest, min(lower(trim(title))) AS first_title FROM doc_meta GROUP BY genre""")


_CAPPED = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > {q} ORDER BY l_quantity DESC, l_orderkey, l_linenumber"


@query(f"""SELECT * FROM (SELECT 'cut' AS asked, (SELECT count(*) > 200 FROM ({_CAPPED.format(q=10)})) AS truncated, l_orderkey, l_linenumber, l_quantity FROM ({_CAPPED.format(q=10)}) LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'whole', (SELECT count(*) > 200 FROM ({_CAPPED.format(q=10)} LIMIT 7)), * FROM ({_CAPPED.format(q=10)} LIMIT 7))""")
def sql_row_cap(spark: SparkSession, d: str) -> DataFrame:
    """Rows and truncation flag of run_sql, for a statement over the bound and one under it."""
    tables = {"lineitem": table(spark, d, "lineitem")}
    rows = []
    for asked, sql in (("cut", _CAPPED.format(q=10)), ("whole", _CAPPED.format(q=10) + " LIMIT 7")):
        got = run_sql(spark, sql, tables)
        rows += [(asked, got.truncated, r["l_orderkey"], r["l_linenumber"], float(r["l_quantity"])) for r in got.rows]
    return spark.createDataFrame(rows, "asked string, truncated boolean, l_orderkey long, l_linenumber long, l_quantity double")


_guarded("sql_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, y)", ("region",))


@query()
def sql_describe_schema(spark: SparkSession, d: str) -> DataFrame:
    return describe_schema(spark, {t: table(spark, d, t) for t in ("doc_meta", "artifacts", "documents")})


# Counts, samples, index


@query("""SELECT (SELECT count(*) FROM doc_meta) AS documents, count(*) AS artifacts, count(*) FILTER (media_type = 'text/plain') AS text_artifacts, count(*) FILTER (media_type <> 'text/plain') AS raw_artifacts FROM artifacts""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.counts(table(spark, d, "doc_meta"), table(spark, d, "artifacts"))


@query("SELECT id, title, ddmudate FROM doc_meta WHERE ddmudate >= '2020-06-01' ORDER BY id LIMIT 1")
def sample_document(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.sample_document(table(spark, d, "doc_meta"), "2020-06-01").select("id", "title", "ddmudate")


@query("SELECT count(DISTINCT id) AS documents, count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM artifact_text WHERE text IS NOT NULL")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.index_stats(table(spark, d, "artifact_text").where("text IS NOT NULL").select(F.col("id").alias("doc_id"), "text"))


@query()
def fnv1a_digest(spark: SparkSession, d: str) -> DataFrame:
    return with_fnv1a(table(spark, d, "doc_meta").select("id", "search_text"), "search_text", "fnv").select("id", "fnv").distinct()


def _vector_index(spark: SparkSession, d: str) -> ann.Index:
    """The stored vector index of the embeddings, built once an application."""
    built = spark.sparkContext.__dict__.setdefault("_dossierkit_indexes", {})
    path = built.get((d, "embeddings"))
    if path is None:
        path = f"{intermediates(spark)}/vectors-{uuid.uuid4().hex}"
        ann.save(ann.build(table(spark, d, "embeddings"), "vec_id", "embedding"), path)
        built[d, "embeddings"] = path
    return ann.load(spark, path)


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(_vector_index(spark, d), table(spark, d, "embeddings").where("vec_id % 100 = 0"), 10)


@query()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row: the share of the exact ten nearest that the index finds, over all queries."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0")
    exact = V.nearest(asked, vectors, "vec_id", "embedding", 10).select("query_id", "vec_id")
    found = ann.search(_vector_index(spark, d), asked, 10).select("query_id", "vec_id", F.lit(1.0).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("recall"), F.count("*").alias("n"))


# Streaming


@query("""SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY user_id, event_type""")
def stream_keyed_counts(spark: SparkSession, d: str) -> DataFrame:
    """A streaming aggregation over the events, run to its end."""
    root = f"{intermediates(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")

    # each batch gives all counts up to then; a batch that is repeated overwrites its own folder
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    batches = [int(x.getPath().getName()) for x in out.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(out)]
    return spark.read.parquet(f"{root}/out/{max(batches)}")


_MAPPED_SQL = """WITH k AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, name, media_type, size, md5 FROM artifacts) GROUP BY id)
SELECT DISTINCT d.id, d.title, d.ddmudate, coalesce(k.n, 0) AS artifact_count FROM doc_meta d LEFT JOIN k ON k.id = d.id WHERE d.id IS NOT NULL"""


@query("SELECT * FROM (" + _MAPPED_SQL + ") WHERE artifact_count > 0")
def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """The archive's records, written out in pages and applied as a stream of small batches; what is then stored.

    An incremental run takes a record without artifacts for a withdrawn one, so
    only documents with artifacts are compared.
    """
    from ..streaming.apply import stream_apply as start

    root = f"{intermediates(spark)}/apply-{uuid.uuid4().hex}"
    _records(spark, d).repartition(4, "record").write.text(f"{root}/records")
    records = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{root}/records").withColumnRenamed("value", "record")
    store = I.Store(spark, f"{root}/store")
    start(records, store, f"{root}/checkpoint").awaitTermination()
    return store.read("documents").where("artifact_count > 0").select("id", "title", "ddmudate", "artifact_count")


@query("SELECT * FROM (" + _MAPPED_SQL + ") WHERE id NOT IN (SELECT id FROM withdrawals WHERE id IS NOT NULL)")
def full_build(spark: SparkSession, d: str) -> DataFrame:
    """The archive built whole from its records, without the withdrawn ones."""
    gone = table(spark, d, "withdrawals").select("id", F.lit(True).alias("gone")).distinct()
    mapped = M.map_records(_records(spark, d))
    documents = mapped.drop("artifacts", "redacted").join(gone, "id", "left").withColumnRenamed("gone", "redacted").distinct()
    store = I.Store(spark, f"{intermediates(spark)}/build-{uuid.uuid4().hex}")
    I.build(store, documents, M.explode_artifacts(mapped), drop_redacted=True)
    return store.read("documents").select("id", "title", "ddmudate", "artifact_count")


@query("""SELECT DISTINCT id, bn IS NULL OR coalesce(genre, '') = 'memo' AS redacted FROM doc_meta WHERE id IS NOT NULL""")
def policy_flag(spark: SparkSession, d: str) -> DataFrame:
    """The policy flag of records that carry it in every way: as booleans, as texts (which don't count), or not at all."""
    docs = table(spark, d, "doc_meta").where("id IS NOT NULL").select("id", "bn", "genre").distinct()
    record = F.when(F.col("bn").isNull(), F.to_json(F.struct("id", F.lit(True).alias("deaccessioned")))).when(F.col("genre") == "memo", F.to_json(F.struct("id", F.lit(False).alias("published"))))
    record = record.when(F.col("genre").isNull(), F.to_json(F.struct("id"))).otherwise(F.to_json(F.struct("id", F.lit("true").alias("deaccessioned"), F.lit(True).alias("published"))))
    return M.map_records(docs.select(record.alias("record"))).select("id", "redacted").distinct()


@query("SELECT DISTINCT id, coalesce(list_sort(list(DISTINCT media_type) FILTER (media_type IS NOT NULL)), []) AS types, count(*) AS n FROM (SELECT DISTINCT id, name, media_type FROM artifacts) GROUP BY id")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts stored in one table by several changes, layer on layer: what is then in force."""
    rows = table(spark, d, "artifacts").select("id", "name", "media_type").distinct()
    store = I.Store(spark, f"{intermediates(spark)}/layers-{uuid.uuid4().hex}")
    store.write("artifacts", rows.withColumn("media_type", F.lit("stale")))
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for i in range(3):
        t = store.begin()
        t.merge("artifacts", rows.where(part == i), rows.where(part == i).select("id"))
        t.commit()
    found = store.read("artifacts").groupBy("id").agg(F.sort_array(F.collect_set("media_type")).alias("types"), F.count("*").alias("n"))
    return found
