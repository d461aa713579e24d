"""Problem 3: the most similar concepts of every concept in the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.neighbours import neighbour_lists
from lorekiln.llm.vectors import usable_vectors
from lorekiln.plans.session import table

DIM, K, LEAST = 64, 10, 0.92


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "concept_vectors").select(F.col("concept_id").alias("id")).distinct()
    concepts = table(spark, sf_dir, "concepts").select("id", "embedding")
    return usable_vectors(concepts, "id", "embedding", DIM).join(listed, "id", "left_semi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = neighbour_lists(_listed(spark, sf_dir), DIM, K, LEAST)
    return lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


QUERIES = {"p3_found": p3_found}
#: All pairs: for small tables only.
ORACLES = {
    "p3_found": """WITH c AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS e FROM concepts WHERE len(embedding) = 64 AND id IN (SELECT concept_id FROM concept_vectors)),
u AS (SELECT * FROM c WHERE len(list_filter(e, lambda x: isfinite(x))) = 64 AND list_inner_product(e, e) > 0),
p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM u a, u b WHERE a.id <> b.id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS n FROM p WHERE cos >= 0.92)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 10"""
}
