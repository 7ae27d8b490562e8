"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .names import link_fields


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_fields(table(spark, sf_dir, "doc_meta"), table(spark, sf_dir, "party_registry"))


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each party, the number of its spellings and of the places where they stand."""
    found = p6_found(spark, sf_dir)
    return found.groupBy("party_id").agg(F.count_distinct("written_name").alias("n_spellings"), F.count("*").alias("n_places"))


QUERIES = {"p6_found": p6_found, "p6_spellings": p6_spellings}
SQL: dict[str, str] = {}
