"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import archive_orphans, orphan_report
from ..session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_orphans(*(table(spark, sf_dir, t) for t in ("doc_meta", "graph_edges", "withdrawals")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("src_table", "row_key", "field", "ref_value").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


_BATES = r"""(CASE WHEN regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}]', '', 'g') <> '' THEN
  regexp_extract(regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}]', '', 'g'), '^(\p{{L}}*)0*(\p{{Nd}}*)(.*)$', 1) || '|' ||
  regexp_extract(regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}]', '', 'g'), '^(\p{{L}}*)0*(\p{{Nd}}*)(.*)$', 2) || '|' ||
  regexp_extract(regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}]', '', 'g'), '^(\p{{L}}*)0*(\p{{Nd}}*)(.*)$', 3) END)"""
_ID = "nullif(lower(trim({c})), '')"


def _bates(c: str) -> str:
    return _BATES.format(c=c)


_ORPHANS = f"""
WITH listed AS (
  SELECT id, ingested_at AS seen_at, 'attachments' AS field, unnest(attachments) AS ref_value FROM doc_meta
  UNION SELECT id, ingested_at, 'related', unnest(related) FROM doc_meta
  UNION SELECT id, ingested_at, 'mentions', unnest(mentions) FROM doc_meta),
refs AS (
  SELECT 'doc_meta' AS src_table, id AS row_key, field, ref_value, seen_at, {_bates('ref_value')} AS k FROM listed
  UNION
  SELECT 'graph_edges', CAST(edge_no AS VARCHAR), 'neighbor_id', neighbor_id, observed_at, {_ID.format(c='neighbor_id')} FROM graph_edges),
parents AS (
  SELECT 'doc_meta' AS src_table, {_bates('bn')} AS k, coalesce(ingested_at, TIMESTAMP '1900-01-01') AS since FROM doc_meta
  UNION ALL SELECT 'graph_edges', {_ID.format(c='id')}, coalesce(ingested_at, TIMESTAMP '1900-01-01') FROM doc_meta),
gone AS (
  SELECT 'doc_meta' AS src_table, {_bates('bn')} AS k FROM withdrawals
  UNION SELECT 'graph_edges', {_ID.format(c='id')} FROM withdrawals),
live AS (
  SELECT src_table, k, min(since) AS there_from FROM parents p
  WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.src_table = p.src_table AND g.k = p.k)
  GROUP BY src_table, k),
orphans AS (
  SELECT r.src_table, r.row_key, r.field, r.ref_value, r.seen_at FROM refs r
  LEFT JOIN live l ON l.src_table = r.src_table AND l.k = r.k
  WHERE r.k IS NOT NULL AND (l.k IS NULL OR l.there_from > r.seen_at))
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _ORPHANS + "SELECT DISTINCT src_table, row_key, field, ref_value FROM orphans",
    "p4_report": _ORPHANS
    + "SELECT src_table, field, strftime(seen_at, '%Y-%m') AS month, count(DISTINCT (row_key, ref_value)) AS n_orphans FROM orphans GROUP BY ALL",
}
