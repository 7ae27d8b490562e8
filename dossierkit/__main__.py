"""python -m dossierkit ingest|stats: build the archive, keep it current, and look at it."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load
from .functions.embed import HashingEmbedder
from .operators import ingest as I
from .operators.artifacts import read_objects
from .operators.fulltext import build_fulltext, build_raw
from .operators.maintenance import counts, format_bytes, format_count, index_documents, index_stats, sample_document
from .operators.mapping import explode_artifacts, map_records
from .session import ship
from .sources.records import RecordPages


def _records(spark: SparkSession, config: Config, since: str | None) -> DataFrame:
    spark.dataSource.register(RecordPages)
    reader = spark.read.format("record_pages").option("path", config.source)
    return (reader if since is None else reader.option("since", since)).load()


def _files(spark: SparkSession, config: Config, store: I.Store) -> DataFrame:
    return read_objects(spark, config.objects, store.read("artifacts").select("id", "name"), config.object_prefix, config.fanout)


def ingest(spark: SparkSession, config: Config, args: argparse.Namespace) -> dict:
    """One run; without an archive a plain run builds it whole."""
    store = I.Store(spark, config.store)
    mapped = map_records(_records(spark, config, args.since)).dropDuplicates(["id"])
    documents, artifacts = mapped.drop("artifacts"), explode_artifacts(mapped)
    if args.sample_doc:
        found = sample_document(documents, args.since).first()
        return {"sample": found.asDict() if found else None}
    if args.dry_run:
        plan = I.dry_run(documents, artifacts, store.read("documents"), store.read("artifacts"))
        return {r["class"]: r["n"] for r in plan.groupBy("class").agg(F.count("*").alias("n")).collect()}
    out: dict = {}
    if args.force or not store.exists("documents"):
        I.build(store, documents, artifacts, force=args.force)
        index_documents(store)
        out["built"] = store.read("documents").count()
    else:
        out["applied"] = asdict(I.apply(store, documents, artifacts, since=args.since))
    if args.full_text:
        data = _files(spark, config, store)
        texts = data.select("id", "name", F.make_valid_utf8(F.col("data").cast("string")).alias("text"))
        mode = {"resume": True} if store.exists("chunks") and not args.force else {"force": True}
        out["full_text"] = asdict(build_fulltext(store, texts, HashingEmbedder(config.embed_dimensions), config.chunk_bytes, config.chunk_overlap, **mode))
    if args.store_raw:
        out["raw"] = build_raw(store, _files(spark, config, store), config.text_in_raw and not args.no_text_in_raw)
    return out


def stats(spark: SparkSession, config: Config) -> dict:
    """What the archive holds."""
    store = I.Store(spark, config.store)
    artifacts = store.read("artifacts")
    out = {k: format_count(v) for k, v in counts(store.read("documents"), artifacts).first().asDict().items()}
    chunked = store.read("chunks") if store.exists("chunks") else spark.createDataFrame([], "doc_id string, artifact_name string, text string")
    sizes = I.store_sizes(artifacts, chunked, store.read("raw_artifacts") if store.exists("raw_artifacts") else None).first().asDict()
    out |= {k: None if v is None else format_bytes(v) if k.endswith("bytes") else format_count(v) for k, v in sizes.items()}
    if store.exists("chunks"):
        out["index"] = index_stats(chunked).first().asDict()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dossierkit", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--store")
    p.add_argument("--source")
    p.add_argument("--objects")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("ingest")
    for flag in ("--force", "--update", "--dry-run", "--full-text", "--store-raw", "--no-text-in-raw", "--sample-doc"):
        run.add_argument(flag, action="store_true")
    run.add_argument("--since")
    sub.add_parser("stats")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    config = load(args.config, store=args.store, source=args.source, objects=args.objects)
    spark = spark or SparkSession.builder.appName("dossierkit").getOrCreate()
    ship(spark)
    result = ingest(spark, config, args) if args.command == "ingest" else stats(spark, config)
    print(json.dumps(result, ensure_ascii=False, default=str))
    return result


if __name__ == "__main__":
    main()
