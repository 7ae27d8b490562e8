"""Problem 8: filling containers of a fixed capacity with texts.

Conflict-constrained best fit: items come largest first; the open bins of a
group are kept in the order of their residual capacity and carry bitmaps of the
sources and duplicate clusters they hold. The search starts at the tightest bin
that has room and goes on to its successors until one is compatible; if none is,
a new bin is opened. Two near-duplicate texts (five-word shingles, a likeness of
0.8, and what such texts connect) never share a bin, nor do two of one source,
but for a source of more items than ``SPREAD`` of the bins that its group needs:
a bin then holds as many of its items as spread them evenly.

Groups are formed by a hash of the item, sized by the total over all items, so
a hot source or cluster spreads over every group; a group fills thousands of
bins, and what its last bins leave open is small against it.

Defined cases: an item over the capacity is cut into full containers and a rest
that is packed like any item; items of no tokens (null and empty texts) go into
any bin; exact duplicate rows are one item; null sources conflict with none; rows
without a doc_id are left out; a cluster of more items than bins gets more bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .neardup import LikenessRule, NearDuplicates, clusters, near_duplicates
from .tokens import VOCABULARY, encode


@dataclass(frozen=True)
class PackRule:
    capacity: int = 2048
    group_tokens: int = 2048 * 1500  # tokens of the items of one group


#: Share of the bins needed up to which a source's items lie in bins of their own.
SPREAD = 0.25
#: Near-duplicates among the items: at the threshold a pair is found with a probability of 0.9998, above it more.
ALIKE = LikenessRule("word", 5, 0.8, 3, 12, 1)


def pack(sizes: list[int], sources: list, clusters: list, rule: PackRule) -> list[int]:
    """Bin of each item; all sizes are at most the capacity, items come in descending size."""
    bit_of_source: dict = {}
    bit_of_cluster: dict = {}
    needed = max(1, -(-sum(sizes) // rule.capacity))
    # items of a source that a bin may hold: one, or what spreads a source of more items than bins
    most = {s: max(1, -(-n // max(1, int(SPREAD * needed)))) for s, n in Counter(x for x in sources if x is not None).items()}
    held: Counter = Counter()
    has_source: list[int] = []  # sources of which the bin holds as many items as it may
    has_cluster: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None or not size else 1 << bit_of_source.setdefault(source, len(bit_of_source))
        c = 0 if cluster is None or not size else 1 << bit_of_cluster.setdefault(cluster, len(bit_of_cluster))
        k = next((k for k in range(bisect_left(open_bins, (size, -1)), len(open_bins)) if not (has_cluster[open_bins[k][1]] & c or has_source[open_bins[k][1]] & s)), None)
        if k is None:
            residual, b = rule.capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        else:
            residual, b = open_bins.pop(k)
        if s:
            held[b, source] += 1
            if held[b, source] >= most[source]:
                has_source[b] |= s
        has_cluster[b] |= c
        placed.append(b)
        if residual > size or not size:
            insort(open_bins, (residual - size, b))
    return placed


def containers(documents: DataFrame, rule: PackRule | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, part_no, n_tokens, container): every text, or each part of one over the capacity, in its container."""
    rule = rule or PackRule()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    marks = texts.select("doc_id", "source", F.xxhash64(F.col("text")).alias("cluster"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("filled")).distinct()
    found = near_duplicates(documents.select(F.lit("text").alias("field"), F.col("doc_id").cast("long").cast("string").alias("key"), "text"), {"text": ALIKE})
    found = NearDuplicates(found.members, materialise(found.pairs, "pack-pairs"))
    alike = found.members.join(clusters(found), ["field", "rep"], "left").select(F.col("key").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("cluster", "rep")).alias("near"))
    alike = alike.groupBy("doc_id").agg(F.min("near").alias("near"))
    # a doc_id that stands for several texts keeps one item for each size; the first source of an item counts
    marks = marks.groupBy("doc_id").agg(F.min("source").alias("source"), F.min(F.when(F.col("filled"), F.col("cluster"))).alias("cluster"))
    # texts of fewer words than a shingle are alike if they are equal
    marks = marks.join(alike, "doc_id", "left").select("doc_id", "source", F.coalesce("near", "cluster").alias("cluster"))
    sized = materialise(encode(texts, path, counts_only=True).join(marks, "doc_id"), "pack-sizes")

    full = F.when(F.col("n_tokens") > rule.capacity, F.floor(F.col("n_tokens") / rule.capacity)).otherwise(F.lit(0)).cast("int")
    parts = sized.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * rule.capacity)
    total = parts.agg(F.sum("rest"), F.count("*")).first()
    n_groups = max(1, -(-int(total[0] or 0) // rule.group_tokens))
    items = parts.where((F.col("rest") > 0) | (F.col("full") == 0)).select(
        "doc_id", F.col("full").alias("part_no"), F.col("rest").cast("int").alias("n_tokens"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).cast("long").alias("pack_group"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        sources = [None if pd.isna(x) else x for x in pdf["source"]]
        clusters = [None if pd.isna(x) else x for x in pdf["cluster"]]
        bins = pack(pdf["n_tokens"].tolist(), sources, clusters, rule)
        out = pdf[["doc_id", "part_no", "n_tokens"]].copy()
        out["container"] = [f"{g}-{b}" for g, b in zip(pdf["pack_group"], bins, strict=True)]
        return out

    kind = "doc_id long, part_no int, n_tokens int, container string"
    packed = items.groupBy("pack_group").applyInPandas(run, kind)
    whole = (
        parts.where(F.col("full") > 0)
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"))
        .select("doc_id", "part_no", F.lit(rule.capacity).alias("n_tokens"), F.concat(F.lit("full-"), F.col("doc_id"), F.lit("-"), F.col("part_no")).alias("container"))
    )
    return packed.unionByName(whole)


def fill_report(placed: DataFrame, capacity: int = PackRule.capacity) -> DataFrame:
    """One row: containers, items, tokens, and the share of the space that is used."""
    bins = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.max("used").alias("fullest"),
    )
