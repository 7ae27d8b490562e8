"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .pieces import pieces


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the texts that the splitter cuts."""
    cut = pieces(table(spark, sf_dir, "artifact_text"), "name", "text", with_text=False)
    return cut.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("name").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the texts over the limit, in order."""
    cut = pieces(table(spark, sf_dir, "artifact_text"), "name", "text")
    return cut.where(F.col("n_pieces") > 1).distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": r"SELECT DISTINCT name FROM artifact_text WHERE strlen(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) > 2048",
}
