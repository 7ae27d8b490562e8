"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .scans import defects, repaired


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "artifact_text"))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "artifact_text"))


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
SQL: dict[str, str] = {}
