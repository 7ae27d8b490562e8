"""Queries of problem 1; tests compare with brute force over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .neardup import TEXT, TITLE, NearDuplicates, all_pairs, near_duplicates


def _found(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    texts = table(spark, sf_dir, "artifact_text").select(F.lit("text").alias("field"), F.col("name").alias("key"), "text")
    titles = table(spark, sf_dir, "doc_meta").select(F.lit("title").alias("field"), F.col("id").alias("key"), F.col("title").alias("text"))
    return near_duplicates(texts.unionByName(titles), {"text": TEXT, "title": TITLE})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(_found(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's class of exact copies, and the number of other classes that the class is like."""
    found = _found(spark, sf_dir)
    ends = found.pairs.select("field", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("links"))
    return found.members.join(ends, ["field", "rep"], "left").select("field", "key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
SQL: dict[str, str] = {}
