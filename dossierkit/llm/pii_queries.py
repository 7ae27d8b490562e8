"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .pii import find, redact


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
