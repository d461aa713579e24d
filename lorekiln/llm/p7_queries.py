"""Problem 7: all texts in containers of 1 024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.packing import pack, token_count
from lorekiln.plans.session import table

CAPACITY = 1024


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", token_count(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).filter((F.col("pieces") > 1) & (F.col("piece") == 0)).select(F.col("item").alias("doc_id"))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of one over 1 024 tokens, with its container."""
    p = _packed(spark, sf_dir)
    return p.select(F.col("item").alias("doc_id"), "pieces", "piece", F.col("size").alias("tokens"), F.col("bin").alias("bin_id"))


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could hold the tokens, the fullest and the share of space left."""
    fill = _packed(spark, sf_dir).groupBy("bin").agg(F.sum("size").alias("used"))
    return fill.agg(F.count(F.lit(1)).alias("bins"), F.ceil(F.sum("used") / CAPACITY).alias("least_bins"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("space_left"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was packed: texts, pieces, tokens, the least number of containers, and how many containers hold too much."""
    p = _packed(spark, sf_dir)
    fill = p.groupBy("bin").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"))
    return p.agg(F.countDistinct("item").alias("texts"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("size").cast("long")).alias("tokens"), F.ceil(F.sum("size") / CAPACITY).alias("least_bins")).join(F.broadcast(fill))


QUERIES = {"p7_found": p7_found, "p7_bins": p7_bins, "p7_use": p7_use, "p7_totals": p7_totals}
_COUNT = r"len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\p{Z}\x{85}\x{1c}-\x{1f}]+'))"
ORACLES = {
    "p7_totals": f"WITH t AS (SELECT {_COUNT} AS n FROM documents WHERE text IS NOT NULL) SELECT count(*) AS texts, sum(ceil(n / {CAPACITY}))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, ceil(sum(n) / {CAPACITY})::BIGINT AS least_bins, 0::BIGINT AS overfull FROM t WHERE n > 0",
    "p7_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\p{Z}\x{85}\x{1c}-\x{1f}]+')) > 1024"}
