"""Problem 5: concepts that carry almost the same markdown and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.near_duplicates import NearDuplicates, link_groups, near_duplicates
from lorekiln.plans.session import table


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return near_duplicates(table(spark, sf_dir, "concepts"), "id", "markdown", "tags", similarity=0.6, tag_similarity=0.5, shingle=3, least_words=20)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparable concept with its class of equal texts and the class's number of links to other classes."""
    return _near(spark, sf_dir).degrees()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept that has a near-duplicate, with its group (connected through links and copies)."""
    near = _near(spark, sf_dir)
    groups = link_groups(near.links, "rep_a", "rep_b")
    own = near.members.select("id", "rep").join(groups, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("group", "rep").alias("group_id"))
    size = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1)
    return own.join(size, "group_id").select("id", "group_id", "group_size")


QUERIES = {"p5_found": p5_found, "p5_links": p5_links, "p5_groups": p5_groups}
_SQL = r"""
WITH RECURSIVE c AS (SELECT DISTINCT ON (id) id, regexp_extract_all(markdown, '[\pL\pN]+') AS w0, TRY_CAST(tags AS JSON) AS j FROM concepts WHERE markdown IS NOT NULL),
d AS (SELECT id, list_transform(w0, lambda x: lower(x)) AS w, list_sort(list_distinct(list_transform(TRY_CAST(j AS VARCHAR[]), lambda t: lower(trim(t, E' \t\n\r'))))) AS t FROM c WHERE len(w0) >= 20 AND json_type(j) = 'ARRAY' AND json_array_length(j) > 0),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY id),
x AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT a AS id_a, b AS id_b FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b JOIN d da ON da.id = a JOIN d db ON db.id = b
  WHERE 5 * k >= 3 * (na.n + nb.n - k) AND 2 * len(list_intersect(da.t, db.t)) >= len(list_distinct(list_concat(da.t, db.t)))),
m AS (SELECT d.id, min(d.id) OVER (PARTITION BY h, t) AS class_id, count(*) OVER (PARTITION BY h, t) - 1 AS copies FROM d JOIN n USING (id)),
l AS (SELECT DISTINCT u.class_id AS a, v.class_id AS b FROM (SELECT id_a, id_b FROM p UNION ALL SELECT id_b, id_a FROM p) JOIN m u ON u.id = id_a JOIN m v ON v.id = id_b WHERE u.class_id <> v.class_id),
r AS (SELECT DISTINCT id_a AS a, id_b AS b FROM (SELECT id_a, id_b FROM p UNION ALL SELECT id_b, id_a FROM p) UNION SELECT r.a, q.b FROM r JOIN (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p) q ON r.b = q.a)
"""
#: Every shared shingle is joined: for small tables only.
ORACLES = {
    "p5_found": _SQL + "SELECT id_a, id_b FROM p",
    "p5_links": _SQL + "SELECT id, class_id, copies, coalesce(k, 0) AS links FROM m LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY 1) ON a = class_id",
    "p5_groups": _SQL + "SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM (SELECT a AS id, min(b) AS group_id FROM r GROUP BY 1)",
}
