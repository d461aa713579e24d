"""Problem 8: evaluation passages that stand in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.leakage import find_leaks
from lorekiln.plans.session import table

RUN = 12


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "eval_id", "passage", RUN)
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("eval_id"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items")
    n = p8_found(spark, sf_dir).groupBy("eval_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("eval_id", "suite").join(n, "eval_id", "left").select("eval_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
_SQL = r"""
WITH n AS (SELECT doc_id AS id, regexp_extract_all(lower(strip_accents(nfc_normalize(text))), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT eval_id, suite, regexp_extract_all(lower(strip_accents(nfc_normalize(passage))), '[\pL\pN]+') AS w FROM eval_items),
er AS (SELECT DISTINCT eval_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT eval_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e)),
dr AS (SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM n)),
found AS (SELECT DISTINCT id AS doc_id, eval_id FROM dr JOIN er USING (g))
"""
ORACLES = {
    "p8_found": _SQL + "SELECT doc_id, eval_id FROM found",
    "p8_items": _SQL + "SELECT eval_id, suite, count(doc_id) AS documents FROM e LEFT JOIN found USING (eval_id) GROUP BY eval_id, suite",
}
