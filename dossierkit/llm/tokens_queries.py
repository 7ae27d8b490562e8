"""Queries of problem 7; SQL cannot express them, tests compare with direct encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .tokens import encode


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
