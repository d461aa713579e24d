"""Problem 9: pages of keywords, links or tags instead of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.stuffing import stuffed_pages
from lorekiln.plans.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stuffed pages with the shares they are judged by."""
    got = stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select(F.col("doc").alias("doc_id"), *[F.round(c, 4).alias(c) for c in ("loose", "short", "repeated")])


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores}
ORACLES: dict[str, str] = {}
