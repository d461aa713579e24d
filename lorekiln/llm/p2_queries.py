"""Problem 2: groups of mutually similar concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.clustering import describe_clusters, similarity_clusters
from lorekiln.plans.session import table

#: Members of a cluster have a mean cosine of 0.5 to 0.6; a group far above that is one concept in several versions.
DIM, COPIES = 64, 0.8


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(table(spark, sf_dir, "concepts"), "id", "embedding", DIM, "namespace", copies=COPIES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _clusters(spark, sf_dir)
    a = got.select(F.col("id").alias("id_a"), F.col("cluster").alias("ca"))
    b = got.select(F.col("id").alias("id_b"), F.col("cluster").alias("cb"))
    probes = table(spark, sf_dir, "cluster_probes").select("id_a", "id_b").distinct()
    return probes.join(a, "id_a").join(b, "id_b").filter(F.col("ca") == F.col("cb")).select("id_a", "id_b")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size, its namespaces and its three most typical concepts."""
    d = describe_clusters(_clusters(spark, sf_dir))
    return d.select("cluster", "size", F.col("n_notes").alias("n_namespaces"), F.array_join("notes", ",").alias("namespaces"), F.array_join("typical", ",").alias("typical"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
ORACLES: dict[str, str] = {}
