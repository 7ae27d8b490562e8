"""Incremental apply as a stream: each micro-batch of records is one run of apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Store, apply, build
from ..operators.mapping import explode_artifacts, map_records


def stream_apply(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Start a query that maps each batch of JSON ``record`` texts and applies it to the archive.

    The checkpoint's offsets replace the stored watermark as the lower bound.
    Applying a batch again finds every digest unchanged, so a batch that is
    repeated after a failure does no harm. Only a stream's first batch may build
    the archive: if a later one finds none, something removed it, and the stream
    stops instead of beginning a new one with what the batch happens to hold.
    """

    def run(batch: DataFrame, number: int) -> None:
        mapped = map_records(batch)
        newest = F.row_number().over(_newest())
        mapped = mapped.withColumn("__k", newest).where("__k = 1").drop("__k").persist()
        try:
            documents, artifacts = mapped.drop("artifacts"), explode_artifacts(mapped)
            if store.exists("documents"):
                apply(store, documents, artifacts, everything=True)
            elif number == 0:
                build(store, documents, artifacts)
            else:
                raise RuntimeError(f"no archive under {store.root} though the stream is at batch {number}")
        finally:
            mapped.unpersist()

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy(F.desc_nulls_last("ddmudate"), "digest")


def keyed_maximum(events: DataFrame, key: str, time: str, value: str, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Number and greatest value of a key in each window of event time, late events up to ``delay``."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.max(value).alias("top")).select(F.col("window.start").alias("start"), key, "n", "top")
