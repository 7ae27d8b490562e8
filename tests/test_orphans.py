from datetime import datetime

from dossierkit.operators import bloom
from dossierkit.operators.orphans import Parents, archive_orphans, bates_key, find_orphans, orphan_report
from pyspark.sql import functions as F


def at(day):
    return datetime(2020, 1, day)


def _archive(spark):
    docs = [
        ("a", "ARV-00000001", at(1), ["arv 1", "ARV_0002", "NVS-1", None, "", "  ", "ARV-3", "ARV-00000004-A"], None, []),
        ("a", "ARV-00000001", at(1), ["arv 1", "ARV_0002", "NVS-1", None, "", "  ", "ARV-3", "ARV-00000004-A"], None, []),
        ("b", "ARV-00000002", at(5), ["ARV-1"], ["ARV-3"], [None]),
        ("c", "ARV-00000003", at(2), None, None, None),
        ("d", None, None, [], [], ["ARV-2"]),
        ("e", "ARV-00000004", None, [], [], []),
    ]
    schema = "id string, bn string, ingested_at timestamp, attachments array<string>, related array<string>, mentions array<string>"
    edges = [(1, " B ", at(9)), (2, "zz", at(9)), (3, "b", at(4)), (4, None, at(9)), (5, "C", at(9)), (6, "e", at(1)), (2, "zz", at(9)), (7, "", at(9))]
    gone = [("c", None), ("x", "ARV-3")]
    return (
        spark.createDataFrame(docs, schema).withColumn("key", F.lit(1)),
        spark.createDataFrame(edges, "edge_no long, neighbor_id string, observed_at timestamp").withColumn("field", F.lit("x")),
        spark.createDataFrame(gone, "id string, bn string"),
    )


def test_archive(spark):
    docs, edges, gone = _archive(spark)
    found = archive_orphans(docs, edges, gone)
    got = {(r["src_table"], r["row_key"], r["field"], r["ref_value"]) for r in found.collect()}
    assert got == {
        ("doc_meta", "a", "attachments", "ARV_0002"), ("doc_meta", "a", "attachments", "NVS-1"), ("doc_meta", "a", "attachments", "ARV-3"), ("doc_meta", "a", "attachments", "ARV-00000004-A"),
        ("doc_meta", "b", "related", "ARV-3"),
        ("graph_edges", "2", "neighbor_id", "zz"), ("graph_edges", "3", "neighbor_id", "b"), ("graph_edges", "5", "neighbor_id", "C"),
    }
    report = {(r["field"], r["month"]): r["n_orphans"] for r in orphan_report(found).collect()}
    assert report == {("attachments", "2020-01"): 4, ("related", "2020-01"): 1, ("neighbor_id", "2020-01"): 3}
    assert archive_orphans(docs.limit(0), edges, gone.limit(0)).count() == 5
    assert archive_orphans(docs.limit(0), edges.limit(0), gone).count() == 0


def test_same_result_whatever_the_filter_lets_through(spark):
    parents = spark.range(0, 3000, 2).select(F.col("id").cast("string").alias("key"), F.lit(at(1)).alias("there_from"))
    refs = spark.range(0, 3000).select(F.when(F.col("id") < 1000, F.lit("7")).otherwise(F.col("id").cast("string")).alias("key"), F.lit(at(2)).alias("seen_at"), "id")
    want = {r["id"] for r in refs.join(parents, "key", "left_anti").collect()}
    for n_blocks in (1, 4, 1024):
        got = find_orphans(refs, Parents(parents, parents.select("key").limit(0)), n_blocks)
        assert {r["id"] for r in got.collect()} == want


def test_filter_holds_every_key(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    n = bloom.blocks_for(5000)
    built = bloom.build(keys, "k", n)
    assert built.count() <= n
    assert bloom.probe(keys, "k", built, n, "m").where("m").count() == 5000
    strangers = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("k"))
    assert bloom.probe(strangers, "k", built, n, "m").where("m").count() < 2000
    assert bloom.blocks_for(10**12) == bloom.MAX_BLOCKS


def test_bates_keys(spark):
    forms = ["CRN-MDL-00000257", "crnmdl 257", "CRN_MDL_0257", "CRNMDL00000257"]
    keys = {r[0] for r in spark.createDataFrame([(f,) for f in forms], "c string").select(bates_key(F.col("c"))).collect()}
    assert keys == {"CRNMDL|257|"}
