"""Queries of problem 8; an order-dependent heuristic has no SQL, tests check its invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .packing import containers, fill_report


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(containers(table(spark, sf_dir, "documents")))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
