"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .emails import unwritten_lines, written_text


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten_lines(table(spark, sf_dir, "artifact_text"), table(spark, sf_dir, "doc_meta"))


def p2_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_text(table(spark, sf_dir, "artifact_text"), table(spark, sf_dir, "doc_meta"))


QUERIES = {"p2_found": p2_found, "p2_written": p2_written}
SQL: dict[str, str] = {}
