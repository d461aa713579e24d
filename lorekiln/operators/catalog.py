"""The concept table: lookup, listing, representations, statistics, changes since a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import has_all, parse_tags, tag_like

REPRESENTATIONS = {"vector": "embedding", "markdown": "markdown", "thoughtform": "thoughtform"}


def load_concepts(raw: DataFrame) -> DataFrame:
    """One row per id (repeats of a row are dropped) with the tags also as a list."""
    return raw.dropDuplicates(["id"]).withColumn("tag_list", parse_tags(F.col("tags")))


PRESENCE = {"has_md": "markdown", "has_tf": "thoughtform", "has_vec": "embedding"}


def flags(df: DataFrame) -> list:
    """The presence flags, worked out unless the table has them."""
    return [F.col(n) if n in df.columns else F.col(c).isNotNull().cast("int").alias(n) for n, c in PRESENCE.items()]


def headers(raw: DataFrame) -> DataFrame:
    """One row per id with presence flags instead of representations: what listing and counting need.

    Dropping repeats then moves a few small columns, not texts and vectors.
    """
    rows = raw.select("id", "namespace", "version", "created_at", "updated_at", "tags", *flags(raw)).dropDuplicates(["id"])
    return rows.withColumn("tag_list", parse_tags(F.col("tags")))


def lookup(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, namespace and presence flags of the wanted ids; no ids, no rows."""
    return concepts.join(ids.select("id").distinct(), "id", "left_semi").select("id", "namespace", "version", *flags(concepts))


def represent(concepts: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """id and a JSON document of the wanted representations that are there; columns not wanted are never read."""
    cols = [F.col(REPRESENTATIONS[r]).alias(r) for r in (wanted or REPRESENTATIONS)]
    return concepts.select("id", F.to_json(F.struct(*cols)).alias("document"))


def filter_concepts(concepts: DataFrame, namespace: str | None = "default", tags: tuple[str, ...] = (), tag_mode: str = "exact") -> DataFrame:
    if namespace is not None:
        concepts = concepts.filter(F.col("namespace") == namespace)
    if tags and tag_mode == "like":
        for t in tags:
            concepts = concepts.filter(tag_like(F.col("tags"), t))
    elif tags:
        concepts = concepts.filter(has_all(F.col("tag_list"), list(tags)))
    return concepts


def list_page(concepts: DataFrame, namespace: str | None = "default", tags: tuple[str, ...] = (), limit: int = 50, offset: int = 0, tag_mode: str = "exact") -> DataFrame:
    """A page by time of change, latest first, ids breaking ties, each row with the number of all rows that match."""
    rows = filter_concepts(concepts, namespace, tags, tag_mode)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = rows.select("id", "namespace", "version", "updated_at", *flags(rows)).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def stats(concepts: DataFrame, index: DataFrame, by_namespace: bool = False) -> DataFrame:
    """Concepts, index rows and representations, counted in one pass over each table."""
    concepts = concepts.select("id", "namespace", *flags(concepts))
    counts = [F.count(F.lit(1)).alias("concepts"), *[F.coalesce(F.sum(n), F.lit(0)).alias(c) for n, c in PRESENCE.items()]]
    if not by_namespace:
        return concepts.agg(*counts).join(F.broadcast(index.agg(F.count(F.lit(1)).alias("vectors"))))
    per = index.select(F.col("concept_id").alias("id")).join(concepts.select("id", "namespace"), "id").groupBy("namespace").agg(F.count(F.lit(1)).alias("vectors"))
    own = concepts.groupBy("namespace").agg(*counts)
    return own.join(per.withColumnRenamed("namespace", "ns"), F.col("namespace").eqNullSafe(F.col("ns")), "left").drop("ns").fillna(0, ["vectors"])


def delta_since(concepts: DataFrame, since_ms: int) -> DataFrame:
    """Concepts with a structured form that changed after a time."""
    return concepts.filter((F.col("updated_at") > since_ms) & F.col("thoughtform").isNotNull())


def kv_latest(kv: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value written for each key."""
    return kv.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
