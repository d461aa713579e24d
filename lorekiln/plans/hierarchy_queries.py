"""Queries over commits: parent links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators.hierarchy import build_hierarchy, expand_descendants, expand_paths
from lorekiln.plans.session import table


def commit_key(col):
    """One spelling of a commit id: trimmed, lower-cased, with the prefix ``cmt_`` where only its digits are given."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"\s+", "")), "^cmt[_-]?", "")
    return F.when(bare != "", F.concat(F.lit("cmt_"), bare))


def commit_links(commits: DataFrame) -> DataFrame:
    """One row per commit; of repeated commits the row stored last counts (ties: the smaller parent, none last)."""
    rows = commits.select(commit_key("commit_id").alias("id"), commit_key("parent_commit_id").alias("up"), "stored_at")
    rank = F.struct(F.col("stored_at").isNotNull().alias("a"), F.col("stored_at").alias("b"))
    rows = rows.filter(F.col("id").isNotNull()).withColumn("rank", rank)
    latest = rows.groupBy("id", "rank").agg(F.min("up").alias("up")).groupBy("id").agg(F.max_by("up", "rank").alias("up"))
    return latest.select(F.col("id").alias("node"), "up")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_hierarchy(commit_links(table(spark, sf_dir, "commits")), "node", "up")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select(F.col("node").alias("commit_id"), F.col("root").alias("root_id"), F.col("depth").alias("tree_depth"))


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with its whole path and its descendants as a preorder interval of its root's tree; -1 on and before loops."""
    tree = _tree(spark, sf_dir)
    paths = expand_paths(tree).withColumnRenamed("node", "n")
    cols = tree.join(paths, F.col("node") == F.col("n"), "left")
    return cols.select(
        F.col("node").alias("commit_id"), F.col("root").alias("root_id"), F.col("depth").alias("tree_depth"), "in_cycle", F.array_join("path", "/").alias("path"),
        *[F.coalesce(c, F.lit(-1)).alias(n) for n, c in (("descendants", F.col("size") - 1), ("first_label", F.col("pre")), ("last_label", F.col("pre") + F.col("size") - 1))],
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a commit and one of its descendants."""
    return expand_descendants(_tree(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}

_BASE = r"""
WITH RECURSIVE spelt AS (
  SELECT regexp_replace(lower(regexp_replace(commit_id, '\s+', '', 'g')), '^cmt[_-]?', '') AS i,
         regexp_replace(lower(regexp_replace(parent_commit_id, '\s+', '', 'g')), '^cmt[_-]?', '') AS p, stored_at FROM commits),
rows_ AS (SELECT 'cmt_' || i AS id, CASE WHEN p <> '' THEN 'cmt_' || p END AS up, stored_at FROM spelt WHERE i <> ''),
latest AS (SELECT id, up FROM (SELECT id, up, row_number() OVER (PARTITION BY id ORDER BY stored_at DESC NULLS LAST, up ASC NULLS LAST) AS r FROM rows_) WHERE r = 1),
link AS (SELECT a.id, b.id AS up FROM latest a LEFT JOIN latest b ON a.up = b.id),
down AS (SELECT id, id AS root, 0::BIGINT AS depth, id AS path FROM link WHERE up IS NULL
         UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM link l JOIN down d ON l.up = d.id),
lost AS (SELECT id, up FROM link WHERE id NOT IN (SELECT id FROM down)),
walk AS (SELECT id AS start, id, 0 AS n FROM lost UNION ALL SELECT w.start, l.up, w.n + 1 FROM walk w JOIN lost l ON w.id = l.id WHERE w.n < (SELECT 2 * count(*) FROM lost)),
loops AS (SELECT start AS id, min(id) AS root FROM walk WHERE n >= (SELECT count(*) FROM lost) GROUP BY start)
"""
ORACLES = {
    "p4_found": _BASE + "SELECT id AS commit_id, root AS root_id, depth AS tree_depth FROM down UNION ALL SELECT id, root, -1 FROM loops",
    "p4_descendants": _BASE + """, pairs AS (SELECT up AS ancestor, id AS descendant FROM link WHERE up IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT l.up, p.descendant FROM pairs p JOIN link l ON l.id = p.ancestor WHERE l.up IS NOT NULL) SELECT ancestor, descendant FROM pairs""",
    # labels: a node's own, then its heaviest child's subtree, then the other children's by the first byte of the id's md5
    "p4_hierarchy": _BASE + """, pairs AS (SELECT up AS ancestor, id AS descendant FROM link WHERE up IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT l.up, p.descendant FROM pairs p JOIN link l ON l.id = p.ancestor WHERE l.up IS NOT NULL),
sz AS (SELECT d.id, d.root, d.depth, d.path, l.up, 1 + coalesce(k, 0) AS size FROM down d JOIN link l USING (id) LEFT JOIN (SELECT ancestor AS id, count(*) AS k FROM pairs GROUP BY 1) USING (id)),
sib AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY size DESC, id) AS heavy FROM sz),
off AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY up ORDER BY (heavy > 1)::INT, substr(md5(id), 1, 2), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sib),
pre AS (SELECT id, 0::HUGEINT AS n FROM off WHERE up IS NULL UNION ALL SELECT o.id, p.n + 1 + o.before FROM off o JOIN pre p ON o.up = p.id)
SELECT id AS commit_id, root AS root_id, depth AS tree_depth, false AS in_cycle, path, size - 1 AS descendants, n::BIGINT AS first_label, (n + size - 1)::BIGINT AS last_label FROM off JOIN pre USING (id)
UNION ALL SELECT id, root, -1, true, NULL, -1, -1, -1 FROM loops""",
}
