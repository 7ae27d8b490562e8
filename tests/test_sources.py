import json

from dossierkit.operators.store import Store
from dossierkit.sources.records import RecordPages
from dossierkit.streaming.apply import keyed_maximum, stream_apply


def _page(path, name, *records):
    (path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_pages(spark, tmp_path):
    spark.dataSource.register(RecordPages)
    _page(tmp_path, "0.jsonl", {"id": "a", "ddmudate": ["2020-01-01", "2020-03-01"], "ti": "x", "heavy": "y"}, "broken {", "[1]")
    _page(tmp_path, "1.jsonl", {"id": "b", "ddmudate": "2020-02-01"}, {"ddmudate": 5})
    read = spark.read.format("record_pages").option("path", str(tmp_path))
    rows = read.load().collect()
    assert {(r["id"], r["modified"]) for r in rows} == {("a", "2020-03-01"), ("b", "2020-02-01"), (None, None)}
    assert read.load().rdd.getNumPartitions() == 2
    lean = read.option("since", "2020-03-01").option("fields", "ti").load().collect()
    assert [json.loads(r["record"]) for r in lean] == [{"id": "a", "ddmudate": ["2020-01-01", "2020-03-01"], "ti": "x"}]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("record_pages").option("path", str(empty)).load().count() == 0


def test_stream_applies_page_by_page(spark, tmp_path):
    spark.dataSource.register(RecordPages)
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()

    def run():
        stream = spark.readStream.format("record_pages").option("path", str(source)).load()
        stream_apply(stream, store, str(tmp_path / "checkpoint")).awaitTermination()

    art = [json.dumps([{"name": "n", "mediaType": "text/plain", "size": 1, "md5": "m"}])]
    _page(source, "0.jsonl", {"id": "a", "ti": "one", "ddmudate": ["1"], "artifact": art}, {"id": "b", "ti": "two", "ddmudate": ["1"], "artifact": art})
    run()
    assert {r["id"]: r["title"] for r in store.read("documents").collect()} == {"a": "one", "b": "two"}
    _page(source, "1.jsonl", {"id": "a", "ti": "new", "ddmudate": ["2"], "artifact": art}, {"id": "a", "ti": "old", "ddmudate": ["0"], "artifact": art}, {"id": "b", "deaccessioned": True})
    run()
    run()
    assert {r["id"]: r["title"] for r in store.read("documents").collect()} == {"a": "new"}


def test_windows_drop_late_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.sql("select timestamp '2020-01-01 10:00:00' ts, 'k' k, 1.0 v union all select timestamp '2020-01-01 11:00:00', 'k', 3.0 union all select timestamp '2020-01-05 00:00:00', 'k', 2.0")
    rows.coalesce(1).write.parquet(str(tmp_path / "in/x"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/x"))
    q = keyed_maximum(stream, "k", "ts", "v").writeStream.format("memory").queryName("tops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["top"]) for r in spark.table("tops").collect()] == [(2, 3.0)]
