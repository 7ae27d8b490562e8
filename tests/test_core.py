import base64
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from dossierkit.functions.chunks import chunks, cut
from dossierkit.functions.embed import HashingEmbedder
from dossierkit.operators import artifacts as A
from dossierkit.operators import lookup as L
from dossierkit.operators.fulltext import build_fulltext, build_raw
from dossierkit.operators.graph import related
from dossierkit.operators import textindex
from dossierkit.operators.ingest import apply, build, classify
from dossierkit.operators.maintenance import index_documents
from dossierkit.operators.store import Store
from dossierkit.operators.mapping import explode_artifacts, map_records
from dossierkit.operators.search import SearchParams, bm25, keyword_search, snippet, terms
from dossierkit.operators.sqlguard import Refused, run_sql, validate
from dossierkit.operators.vectors import hydrate, nearest
from dossierkit.plans import archive_queries, search_queries
from dossierkit.tools import TOOLS, Archive


def record(id_, title="t", at="2026-01-01T00:00:00Z", arts=(("a.ocr", "m1"),), **more):
    inner = json.dumps([{"name": f"{id_}.{n}", "size": 5, "mediaType": "text/plain", "md5": m} for n, m in arts])
    return json.dumps({"id": id_, "ti": title, "ddmudate": [at], "artifact": [inner]} | more)


def frame(spark, *records):
    return spark.createDataFrame([(r, 1) for r in records], "record string, id int")


def test_mapping_rules(spark):
    sample = record("abcd1234", bn="X-1", collection=["C1"], datesent=["2008 March 05"], au=["A", 3, "B"], rc="lone", custodian={"x": 1}, genre=7, topic=[5], published=False, ddmudate=["2026-01-01T00:00:00Z", "2026-05-01T00:00:00Z"])
    rows = map_records(frame(spark, sample, "not json", record("b", ti=None, filename="f.pdf", artifact="[broken", deaccessioned="true"))).orderBy("id").collect()
    a, b = rows
    assert a["collection"] == "C1" and a["date_sent"] == "2008 March 05" and a["authors"] == ["A", "B"] and a["recipients"] == ["lone"] and a["custodian"] == []
    assert a["genre"] == "7" and a["topic"] is None and a["redacted"] and a["ddmudate"] == "2026-05-01T00:00:00Z"
    assert a["artifact_count"] == 1 and a["artifact_types"] == ["text/plain"] and len(a["digest"]) == 16 and a["search_text"] == "t X-1 A B lone"
    assert b["title"] == "f.pdf" and b["artifact_count"] == 0 and not b["redacted"]
    other = map_records(frame(spark, sample.replace("m1", "m2"), sample.replace("X-1", "X-2"))).collect()
    assert other[0]["digest"] != a["digest"] and other[1]["digest"] == a["digest"]
    assert explode_artifacts(map_records(frame(spark, sample))).first().asDict() == {"id": "abcd1234", "name": "abcd1234.a.ocr", "media_type": "text/plain", "size": 5, "md5": "m1"}


def test_apply_keeps_the_archive_current(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = map_records(frame(spark, record("a"), record("b"), record("c"), record("g")))
    build(store, first.drop("artifacts"), explode_artifacts(first))
    with pytest.raises(FileExistsError):
        build(store, first.drop("artifacts"), explode_artifacts(first))
    texts = spark.createDataFrame([(x, f"{x}.a.ocr", "some words " * 400) for x in "abc"], "id string, name string, text string")
    stats = build_fulltext(store, texts, HashingEmbedder())
    assert (stats.documents, stats.missing) == (3, 1)
    assert build_fulltext(store, texts, HashingEmbedder(), resume=True).chunks == stats.chunks
    later = "2026-02-01T00:00:00Z"
    delta = map_records(frame(spark, record("a"), record("b", title="new title", at=later), record("c", at=later, arts=(("a.ocr", "m9"),)), record("d", at=later), record("g", deaccessioned=True), record("n", artifact=[])))
    args = (delta.drop("artifacts"), explode_artifacts(delta))
    got = apply(store, *args)
    assert (got.scanned, got.new, got.changed, got.unchanged, got.redacted, got.invalidated, got.watermark) == (6, 1, 2, 1, 2, 3, later)
    docs = {r["id"]: r["title"] for r in store.read("documents").collect()}
    assert docs == {"a": "t", "b": "new title", "c": "t", "d": "t"}
    assert {r["id"] for r in store.read("artifacts").collect()} == {"a", "b", "c", "d"}
    assert {r["doc_id"] for r in store.read("chunks").select("doc_id").distinct().collect()} == {"a", "b"}
    again = apply(store, *args, everything=True)
    assert (again.new, again.changed) == (0, 0) and store.read("documents").count() == 4
    assert apply(store, delta.drop("artifacts").limit(0), explode_artifacts(delta).limit(0)).watermark == later


def test_classification_order(spark):
    rows = spark.createDataFrame([("a", "1", False), ("b", "1", True), ("c", "2", False), (None, "1", False), ("e", "1", None)], "id string, digest string, redacted boolean")
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("z", None)], "id string, digest string")
    assert {r["id"]: r["class"] for r in classify(rows, stored).collect()} == {"a": "unchanged", "b": "redacted", "c": "changed", "e": "new"}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from dossierkit.session import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077", None))
    assert shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x" and shared_folder(session("local[2]", None)).startswith("file:///")


def test_lookups(spark):
    docs = spark.createDataFrame([("a", "B1", "x"), ("b", "B2", None), ("c", "a", "z")], "id string, bn string, digest string")
    wanted = spark.createDataFrame([(0, "c"), (1, "nope"), (2, "a"), (3, "c"), (4, None)], "pos int, id string")
    assert [r["id"] for r in L.get_many(docs, wanted).collect()] == ["c", "a"]
    assert {r["id"] for r in L.existing(docs, wanted).collect()} == {"a", "c"}
    keys = spark.createDataFrame([("a",), ("B2",), ("q",)], "key string")
    assert {r["key"]: r["id"] for r in L.resolve(docs, keys).collect()} == {"a": "a", "B2": "b"}


def test_pages_and_tiers(spark):
    arts = spark.createDataFrame([("a", "a.ocr", None), ("b", "b.pdf", "application/pdf"), ("c", "c.ocr", "text/plain")], "id string, name string, media_type string")
    data = spark.createDataFrame([("a", "a.ocr", b"hello world"), ("b", "b.pdf", b"%PDF"), ("d", "d", "é".encode())], "id string, name string, data binary")
    got = {r["id"]: r for r in A.read_text(arts, data, 6, 100).collect()}
    assert got["a"]["text"] == "world" and got["a"]["truncated"] is False and got["a"]["total_bytes"] == 11
    assert got["b"]["status"] == "unsupported_artifact_type" and got["c"]["status"] == "artifact_file_missing"
    assert {r["status"] for r in A.read_text(arts, data, configured=False).collect()} == {"artifact_root_not_configured"}
    page = {r["id"]: r for r in A.read_bytes(data, 0, 5).collect()}
    assert base64.b64decode(page["a"]["data_base64"]) == b"hello" and page["a"]["truncated"]
    cut_char = A.read_text(arts.limit(0).unionByName(spark.createDataFrame([("d", "d", "text/plain")], arts.schema)), data, 0, 1).first()
    assert cut_char["text"] == "�"
    tiers = {r["id"]: r["tier"] for r in A.resolve_tiers(arts, data.where("id = 'a'"), data).collect()}
    assert tiers == {"a": "raw", "b": "artifact_store", "c": None}
    assert arts.select(A.fanout_key(F.lit("mskf0352"), F.lit("mskf0352.ocr"))).first()[0] == "artifacts/m/s/k/f/mskf0352/mskf0352.ocr"
    assert A.clamp(None, A.HITS) == 10 and A.clamp(99, A.HITS) == 50 and A.clamp(0, A.HITS) == 1


def test_objects_from_a_folder(spark, tmp_path):
    p = tmp_path / "artifacts/a/b/c/d/abcd1/abcd1.ocr"
    p.parent.mkdir(parents=True)
    p.write_bytes(b"text")
    wanted = spark.createDataFrame([("abcd1", "abcd1.ocr"), ("zz", "no")], "id string, name string")
    assert [r.asDict() for r in A.read_objects(spark, str(tmp_path), wanted).collect()] == [{"id": "abcd1", "name": "abcd1.ocr", "data": b"text"}]
    store = Store(spark, str(tmp_path / "store"))
    store.write("artifacts", spark.createDataFrame([("abcd1", "abcd1.ocr", "text/plain", 4, "m"), ("zz", "no", "image/png", 1, "m")], "id string, name string, media_type string, size long, md5 string"))
    fetched = A.read_objects(spark, str(tmp_path), wanted)
    assert build_raw(store, fetched) == {"stored": 1, "skipped": 0, "missing": 1}
    assert build_raw(store, fetched) == {"stored": 0, "skipped": 1, "missing": 1}


def test_chunker_and_snippet(spark):
    assert cut("hello world", 2048, 256) == ["hello world"] and cut(" \n", 10, 2) == [] and cut(None, 10, 2) == []
    parts = cut("abcdefghij" * 10, 40, 10)
    assert len(parts) > 1 and all(len(x.encode()) <= 40 for x in parts) and sum(map(len, parts)) > 100
    assert all(len(x.encode()) <= 43 for x in cut("aé漢🙂" * 100, 40, 10))
    df = spark.createDataFrame([(1, "é" * 3000), (2, None)], "k long, t string")
    assert chunks(df, "k", "t").count() == 4
    with pytest.raises(ValueError):
        chunks(df, "k", "t", 10, 10)
    texts = ["a\n\n   b\tc", "x " * 400, "é" * 200, "é" * 141, "a" + "漢" * 200, "y" * 280]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(snippet(F.col("t"))).collect()]
    want = []
    for t in texts:
        s = " ".join(t.split())
        want.append(s if len(s.encode()) <= 280 else s.encode()[:280].decode(errors="ignore") + "…")
    assert got == want


def test_search(spark):
    assert terms("Foo foo BAR") == ["foo", "bar"] and terms("  ") == []
    rows = [("a", "Quarterly Report", ["Jane Doe"], ["text/plain"], "Quarterly Report Jane Doe"), ("b", "Other", [None, ""], ["application/pdf"], "other report"), ("c", None, None, None, None)]
    docs = spark.createDataFrame(rows, "id string, title string, authors array<string>, artifact_types array<string>, search_text string")
    for c in ("bn", "topic", "description", "keywords"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    docs = docs.withColumns({c: F.array().cast("array<string>") for c in ("custodian", "recipients")})
    hits = keyword_search(docs, SearchParams("report JANE")).collect()
    assert [(h["id"], h["score"]) for h in hits] == [("a", 2), ("b", 0)][:1] and hits[0]["matched_fields"] == ["title", "authors"]
    assert keyword_search(docs, SearchParams("report", media_type="application/pdf")).count() == 0
    assert bm25(docs, "id", "search_text", "!!").count() == 0 and bm25(docs.limit(0), "id", "search_text", "report").count() == 0
    vec = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)] + [(99, None)], "k long, v array<float>")
    near = nearest(vec.where("k = 3"), vec, "k", "v", 3)
    assert [r["k"] for r in near.orderBy("rank").collect()] == [3, 2, 4]
    filled = hydrate(spark.createDataFrame([("a", 1), ("q", 2)], "id string, rank int"), docs, "id", {"title": ""}).collect()
    assert {(r["id"], r["title"]) for r in filled} == {("a", "Quarterly Report"), ("q", "")}


def test_stored_text_index(spark, tmp_path):
    from dossierkit.operators import textindex

    rows = [(f"k{i}", t) for i, t in enumerate(["the annual audit", "audit of the audit", "nothing", "", None, "Été à la Mühle", "the " * 50])]
    docs = spark.createDataFrame(rows, "k string, t string")
    textindex.save(textindex.rows(docs, "k", "t"), str(tmp_path / "i"))
    index = textindex.load(spark, str(tmp_path / "i"))
    for query in ("audit", "the AUDIT", "mühle nothing", "!!", "", "absent"):
        want = {r["k"]: round(r["score"], 9) for r in bm25(docs, "k", "t", query).collect()}
        assert {r["key"]: round(r["score"], 9) for r in textindex.search(index, query).collect()} == want, query
    plan = textindex.search(index, "audit")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert textindex.search(textindex.rows(docs.limit(0), "k", "t"), "audit").count() == 0


def test_graph(spark):
    rows = [("a", "A", "t", ["B", "X", "B"], ["A"]), ("b", "B", "t", [], []), ("c", "C", None, None, ["A", None, ""]), ("d", "B", None, ["C"], [])]
    docs = spark.createDataFrame(rows, "id string, bn string, conversation string, attachments array<string>, related array<string>").withColumn("mentions", F.array().cast("array<string>"))
    g = related(docs.union(docs), "a", 1)
    got = sorted((r["kind"], r["reference"], r["neighbor_id"]) for r in g.edges.collect())
    assert got == sorted([("attachment", "B", "b"), ("attachment", "B", "b"), ("attachment", "X", None), ("related", "A", "a"), ("conversation", "t", "a"), ("conversation", "t", "b")], key=lambda x: (x[0], x[1], x[2] or "")) or len(got) == 6
    assert {r["id"] for r in g.nodes.collect()} == {"a", "b"}
    assert related(docs, "C", 2).edges.where("depth = 2").count() == 6
    assert related(docs, "nope", 3).edges.count() == 0 and related(docs, "nope").nodes.count() == 0


ACCEPT = [
    "SELECT * FROM documents", "  select count(*) from artifacts  ", "WITH t AS (SELECT 1) SELECT * FROM t", "EXPLAIN SELECT 1", "VALUES (1), (2)", "SELECT 1 UNION ALL SELECT 2", "SELECT 1;", "(SELECT 1)",
    "SELECT ';' AS x FROM documents", "SELECT id, row_number() OVER (PARTITION BY bn ORDER BY id) FROM documents WHERE id IN (SELECT id FROM artifacts)", "SELECT explode(authors) FROM documents",
]
REJECT = [
    "INSERT INTO documents VALUES (1)", "UPDATE documents SET id = 1", "DELETE FROM documents", "DROP TABLE documents", "CREATE TABLE x (i int)", "WITH t AS (SELECT 1) INSERT INTO documents SELECT * FROM t",
    "EXPLAIN DROP TABLE x", "SELECT 1; SELECT 2", "", "  ", "SELECT * FROM (", "not sql at all", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/x`", "SET a=b", "ADD JAR x", "CACHE TABLE documents",
    "SELECT * FROM secrets", "SELECT * FROM documents WHERE id IN (SELECT id FROM secrets)", "WITH t AS (SELECT java_method('java.lang.System', 'getenv', 'HOME')) SELECT * FROM t", "SHOW TABLES", "SELECT * FROM range(10)",
    "SELECT (SELECT max(x) FROM secrets) FROM documents", "SELECT TRANSFORM (id) USING 'cat' FROM documents",
]


def test_sql_guard(spark):
    docs = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", None, None)], "id string, bn string, authors array<string>")
    tables = {"documents": docs, "artifacts": docs.select("id")}
    for sql in ACCEPT:
        validate(spark, sql, list(tables))
        assert run_sql(spark, sql, tables).error is None, sql
    for sql in REJECT:
        with pytest.raises(Refused):
            validate(spark, sql, list(tables))
        assert run_sql(spark, sql, tables).error
    got = run_sql(spark, "SELECT id, bn, authors FROM documents ORDER BY id", tables, 1)
    assert got.rows == [{"id": "a", "bn": "A", "authors": ["x", "y"]}] and got.truncated and got.columns == ["id", "bn", "authors"]
    assert run_sql(spark, "SELECT bn FROM documents WHERE id = 'b'", tables).rows == [{"bn": None}]


def test_tools(spark, tmp_path):
    mapped = map_records(frame(spark, record("a", title="annual audit"), record("b", title="other audit", attachment=["A9"], bn="B9"), record("c", bn="A9")))
    docs, arts = mapped.drop("artifacts", "redacted"), explode_artifacts(mapped)
    texts = [(x, 0, f"{x}.a.ocr", t) for x, t in (("a", "the annual audit went well"), ("b", "nothing to see"), ("gone", "annual audit of another"))]
    e = HashingEmbedder()
    chunk = spark.createDataFrame([(*r, e.embed([r[3]])[0].tolist()) for r in texts], "doc_id string, chunk_idx int, artifact_name string, text string, vector array<float>")
    raw = spark.createDataFrame([("a", "a.a.ocr", b"hello world")], "id string, name string, data binary")
    archive = Archive(spark, docs, arts, chunk, raw)
    assert len(TOOLS) == 8 and all(callable(getattr(archive, t)) for t in TOOLS)
    assert [h["document"]["id"] for h in archive.search_documents("annual audit")["hits"]] == ["a", "b"]
    hybrid = archive.hybrid_search("annual audit")
    assert {h["document"]["id"] for h in hybrid["hits"]} == {"a", "b", "gone"} and hybrid["hits"][0]["document"]["id"] != "b"
    assert archive.get_artifact_text("a", "a.a.ocr", "text/plain", 0, 5)["text"] == "hello"
    assert archive.get_artifact_bytes("a", "a.a.ocr")["tier"] == "raw" and archive.get_artifact_bytes("b", "x")["status"] == "missing"
    assert archive.get_document(bn="A9")["document"]["id"] == "c" and not archive.get_document(id="zz")["found"]
    with pytest.raises(ValueError):
        archive.get_document()
    assert archive.get_related("b")["edge_count"] == 1
    assert archive.run_sql("SELECT count(*) AS n FROM documents").rows == [{"n": 3}]
    assert {r["table_name"] for r in archive.describe_schema()} == {"documents", "artifacts", "chunks"}
    cut = archive.get_related("a", most=0)
    assert cut["truncated"] == (cut["edge_count"] > 0 or cut["node_count"] > 0) and cut["graph"] == {"nodes": {}, "edges": []} and not archive.get_related("a")["truncated"]
    store = Store(spark, str(tmp_path))
    build(store, docs, arts)
    t = store.begin()
    t.put("chunks", chunk)
    t.commit()
    index_documents(store)
    textindex.store(store, "chunks", textindex.rows(chunk.select(textindex.chunk_key().alias("key"), "text"), "key", "text"))
    opened = Archive.open(spark, store)
    assert opened.text_index is not None and opened.chunk_index is not None
    assert opened.search_documents("annual audit") == archive.search_documents("annual audit")
    assert [h["score"] for h in opened.hybrid_search("annual audit")["hits"]] == [h["score"] for h in hybrid["hits"]]
    assert "error" in Archive(spark, docs, arts).hybrid_search("x")


def test_index_recall(spark, tmp_path):
    import numpy as np

    from dossierkit.operators import ann

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    asked = df.where("k % 100 = 0")
    exact = {tuple(r) for r in nearest(asked, df, "k", "v", 10).select("query_id", "k").collect()}
    got = {tuple(r) for r in ann.search(ann.build(df, "k", "v"), asked, 10).select("query_id", "k").collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    index = ann.build(df, "k", "v")
    ann.save(index, str(tmp_path / "index"))
    kept = ann.search(ann.load(spark, str(tmp_path / "index")), asked, 10)
    assert {tuple(r) for r in kept.select("query_id", "k").collect()} == got
    one = ann.search(ann.load(spark, str(tmp_path / "index")), df.where("k = 0"), 3, probes=1)
    assert one.count() == 3 and "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString()
    few = df.where("k < 100")
    assert {tuple(r) for r in ann.search(ann.build(few, "k", "v"), asked, 3).select("query_id", "k").collect()} == {tuple(r) for r in nearest(asked, few, "k", "v", 3).select("query_id", "k").collect()}


def test_maintenance(spark, tmp_path):
    from dossierkit.functions.fnv import fnv1a, with_fnv1a
    from dossierkit.operators.maintenance import compact, format_bytes, format_count, sample_document

    assert [int(x) for x in fnv1a([b"", b"a", b"foobar"])] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    df = spark.createDataFrame([("b", "a", "2"), ("a", None, "1")], "id string, t string, ddmudate string")
    assert {r["id"]: r["h"] for r in with_fnv1a(df, "t", "h").collect()} == {"b": "af63dc4c8601ec8c", "a": None}
    assert sample_document(df).first()["id"] == "a" and sample_document(df, "2").first()["id"] == "b"
    store = Store(spark, str(tmp_path))
    store.write("documents", df.repartition(4))
    compact(store, "documents")
    assert store.version("documents") == 2 and [r["id"] for r in store.read("documents").collect()] == ["a", "b"]
    assert format_bytes(1536) == "1.5 KiB" and format_bytes(5) == "5 B" and format_count(2_500_000) == "2.5M"


def test_best_chunk_of_every_text(spark, tmp_path):
    texts = {1: "Die Mühle of Köln. " * 60 + "größe litigation team " * 90, 2: "été the rebate of the team", 3: "plain text of the nationwide rebate", 4: "ohne Treffer: Straße", 5: None, 6: " \n", 7: "漢é " * 700 + "of the litigation"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {(k, i): re.findall(r"[^\W_]+", c.lower()) for k, t in texts.items() for i, c in enumerate(cut(t, 2048, 256))}
    mean = sum(map(len, words.values())) / len(words)
    want: dict[int, tuple] = {}
    for (k, i), w in words.items():
        score = 0.0
        for q in search_queries.QUERY.split():
            df, f = sum(q in x for x in words.values()), w.count(q)
            score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if score and (k not in want or (-round(score, 6), i) < want[k]):
            want[k] = (-round(score, 6), i)
    got = {r["doc_id"]: (-r["score"], r["chunk_idx"]) for r in search_queries.QUERIES["hybrid_collapse_utf8"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 7} and got[7][1] > 0
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-5 for k in want)


def test_byte_pages_of_every_text(spark, tmp_path):
    texts = {"a": "plain " * 60, "b": "é" * 100, "c": "x" + "漢" * 100, "d": "", "e": None, "f": "y" * 299 + "é"}
    rows = [(k, f"{k}.ocr", t) for k, t in texts.items()]
    spark.createDataFrame(rows + rows[:2], "id string, name string, text string").write.parquet(str(tmp_path / "artifact_text.parquet"))
    got = sorted(tuple(r) for r in archive_queries.QUERIES["artifact_bytes_utf8"](spark, str(tmp_path)).collect())
    raw = {k: t.encode() for k, t in texts.items() if t is not None}
    assert got == [(k, f"{k}.ocr", base64.b64encode(b[:300]).decode(), min(300, len(b)), len(b), len(b) > 300) for k, b in sorted(raw.items())]
