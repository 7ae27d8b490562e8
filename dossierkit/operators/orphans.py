"""Problem 4: references to records that do not exist.

A broadcast Bloom filter of the parent keys proves the definite orphans; only
the filter-positive references go through the exact join, after which the two
parts are put together and aggregated.

Defined cases: null, empty and blank references are not references; a row whose
time is null cannot precede its target; a target whose time is null was always
there; a key on several rows is there from the earliest of them; exact
duplicate rows give one result row; an empty parent table makes every
reference an orphan; further columns of the inputs are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import bloom

#: A key that more than 1/200 of all references name is joined by broadcast: at most 200 such keys exist.
HOT_SHARE = 200


def bates_key(c: Column) -> Column:
    """Letters | number without leading zeros | rest, of a Bates number in any spelling; null for blanks."""
    clean = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    key = F.concat(
        F.regexp_extract(clean, r"^(\p{L}*)0*(\p{Nd}*)(.*)$", 1), F.lit("|"),
        F.regexp_extract(clean, r"^(\p{L}*)0*(\p{Nd}*)(.*)$", 2), F.lit("|"),
        F.regexp_extract(clean, r"^(\p{L}*)0*(\p{Nd}*)(.*)$", 3),
    )
    return F.when(clean != "", key)


def id_key(c: Column) -> Column:
    """Id without letter case and outer blanks; null for blanks."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


@dataclass(frozen=True)
class Parents:
    """Keys that can be referred to, with the time from which each is there, and the withdrawn keys."""

    rows: DataFrame  # key, there_from
    withdrawn: DataFrame  # key


def live_parents(p: Parents) -> DataFrame:
    """One row per key that is not withdrawn: key, there_from (null: always)."""
    first = p.rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("there_from").alias("first_at"), F.bool_or(F.col("there_from").isNull()).alias("always")
    )
    first = first.select("key", F.when(~F.col("always"), F.col("first_at")).alias("there_from"))
    return first.join(p.withdrawn.where(F.col("key").isNotNull()).select("key").distinct(), "key", "left_anti")


def find_orphans(refs: DataFrame, parents: Parents, n_blocks: int | None = None) -> DataFrame:
    """Rows of ``refs`` (key, seen_at and any other columns) that have no target.

    ``refs.key`` must be non-null. The broadcast filter holds at most
    ``bloom.MAX_BLOCKS`` blocks (64 MB); with ever more keys it lets more
    references through to the exact join, never fewer.
    """
    # both are used several times below: as tables they are computed once
    live = materialise(live_parents(parents), "live-parents")
    n_live = live.count()
    n_blocks = n_blocks or bloom.blocks_for(n_live)
    # a filter so full that it proves nothing is left out: then every reference is verified
    probed = bloom.probe(refs, "key", bloom.build(live, "key", n_blocks), n_blocks, "maybe") if bloom.is_worth(n_live, n_blocks) else refs.withColumn("maybe", F.lit(True))
    flagged = materialise(probed, "flagged-references")
    definite = flagged.where(~F.col("maybe")).drop("maybe")
    positive = flagged.where("maybe").drop("maybe")

    # Positive references to one hot key would all meet in one task: such keys,
    # at most HOT_SHARE of them by construction, are verified by broadcast.
    least = flagged.count() / HOT_SHARE
    hot = positive.groupBy("key").count().where(F.col("count") > least).select("key", F.lit(True).alias("hot"))
    marked = positive.join(F.broadcast(hot), "key", "left")

    hot_live = live.withColumn("known", F.lit(True)).join(F.broadcast(hot.select("key")), "key", "left_semi")
    late = F.col("known").isNull() | F.coalesce(F.col("there_from") > F.col("seen_at"), F.lit(False))
    of_hot = marked.where("hot").drop("hot").join(F.broadcast(hot_live), "key", "left")
    of_rest = marked.where(F.col("hot").isNull()).drop("hot").join(live.withColumn("known", F.lit(True)), "key", "left")
    verified = of_hot.unionByName(of_rest).where(late).drop("known", "there_from")
    return definite.unionByName(verified)


LIST_FIELDS = ("attachments", "related", "mentions")


def archive_orphans(doc_meta: DataFrame, graph_edges: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Orphan references of the archive: src_table, row_key, field, ref_value, seen_at (one row per referring row version)."""
    listed = doc_meta.select(
        F.lit("doc_meta").alias("src_table"), F.col("id").alias("row_key"), F.col("ingested_at").alias("seen_at"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("refs")) for f in LIST_FIELDS])).alias("e"),
    )
    bates = (
        listed.select("src_table", "row_key", "seen_at", F.col("e.field").alias("field"), F.explode("e.refs").alias("ref_value"))
        .withColumn("key", bates_key(F.col("ref_value")))
        .where(F.col("key").isNotNull())
        .distinct()
    )
    edges = (
        graph_edges.select(
            F.lit("graph_edges").alias("src_table"), F.col("edge_no").cast("string").alias("row_key"), F.col("observed_at").alias("seen_at"),
            F.lit("neighbor_id").alias("field"), F.col("neighbor_id").alias("ref_value"), id_key(F.col("neighbor_id")).alias("key"),
        )
        .where(F.col("key").isNotNull())
        .distinct()
    )
    by_bates = Parents(
        doc_meta.select(bates_key(F.col("bn")).alias("key"), F.col("ingested_at").alias("there_from")),
        withdrawals.select(bates_key(F.col("bn")).alias("key")),
    )
    by_id = Parents(
        doc_meta.select(id_key(F.col("id")).alias("key"), F.col("ingested_at").alias("there_from")),
        withdrawals.select(id_key(F.col("id")).alias("key")),
    )
    return find_orphans(bates, by_bates).unionByName(find_orphans(edges, by_id)).drop("key")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of distinct orphan references per table, field and month of the referring row (null month: no time)."""
    return (
        orphans.groupBy("src_table", "field", F.date_format("seen_at", "yyyy-MM").alias("month"))
        .agg(F.count_distinct("row_key", "ref_value").alias("n_orphans"))
    )
