"""Changes of the concept table as functions of the old table and the changes; plain Parquet has no row updates.

A result is a new table: write it elsewhere, then swap; never over the one that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import union_tags

COLUMNS = ("id", "namespace", "version", "created_at", "updated_at", "tag_list", "markdown", "thoughtform", "embedding")


def _changes(changes: DataFrame) -> DataFrame:
    """Changes with all columns, null where a change does not name one, each with the prefix n_."""
    have = set(changes.columns)
    kinds = {"tag_list": "array<string>", "embedding": "array<float>", "expected_version": "int"}
    cols = [(F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string"))).alias(f"n_{c}") for c in ("namespace", "tag_list", "markdown", "thoughtform", "embedding", "expected_version")]
    return changes.select("id", *cols, F.lit(True).alias("changed"))


def save(concepts: DataFrame, changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(new table, rejected): insert or merge one change per id.

    A change adds one to the version, overwrites the fields it names and adds its tags; it cannot move a concept to another
    namespace. Rejected (id, current_version): a change that expects another version than the current one, 0 if none.
    """
    both = concepts.select(*COLUMNS).join(_changes(changes), "id", "full_outer")
    current = F.coalesce("version", F.lit(0))
    wrong = F.col("changed") & F.col("n_expected_version").isNotNull() & (F.col("n_expected_version") != current)
    both = both.withColumn("wrong", F.coalesce(wrong, F.lit(False))).withColumn("hit", F.coalesce("changed", F.lit(False)) & ~F.col("wrong"))
    take = lambda c: F.when(F.col("hit"), F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c)
    new = both.filter(F.col("version").isNotNull() | F.col("hit")).select(
        "id", F.when(F.col("version").isNull(), F.coalesce("n_namespace", F.lit("default"))).otherwise(F.col("namespace")).alias("namespace"),
        F.when(F.col("hit"), current + 1).otherwise(F.col("version")).alias("version"), F.when(F.col("version").isNull(), F.lit(now_ms)).otherwise(F.col("created_at")).alias("created_at"),
        F.when(F.col("hit"), F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(F.col("hit"), union_tags(F.col("tag_list"), F.col("n_tag_list"))).otherwise(F.col("tag_list")).alias("tag_list"),
        take("markdown"), take("thoughtform"), take("embedding"),
    )
    return new, both.filter("wrong").select("id", current.alias("current_version"))


def save_batch(concepts: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Many changes, several per id, applied in the order of ``seq``: the last named value of a field stays, each change
    adds one to the version, and all tags are added in order."""
    have = set(changes.columns)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("markdown", "thoughtform", "embedding") if c in have]
    first = [F.min_by(F.coalesce("namespace", F.lit("default")), "seq").alias("namespace")] if "namespace" in have else []
    tags = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag_list").isNotNull(), F.struct("seq", "tag_list")))), lambda x: x["tag_list"]))).alias("tag_list")] if "tag_list" in have else []
    folded = changes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *last, *first, *tags)
    new, _ = save(concepts, folded, now_ms)
    return new.join(folded.select("id", "n"), "id", "left").withColumn("version", F.col("version") + F.coalesce(F.col("n") - 1, F.lit(0)).cast("int")).drop("n")


def decide(existing_ms: Column, incoming_ms: Column, policy: str) -> Column:
    """inserted, updated or skipped. On equal times ``local_first`` updates while ``strict_newer`` and ``pull`` skip;
    ``pull`` writes what has no time."""
    if policy == "local_first":
        skip = existing_ms > incoming_ms
    elif policy == "strict_newer":
        skip = ~(incoming_ms > existing_ms)
    elif policy == "pull":
        skip = existing_ms >= incoming_ms
    else:
        raise ValueError("policy must be local_first, strict_newer or pull")
    return F.when(existing_ms.isNull(), F.lit("inserted")).when(F.coalesce(skip, F.lit(policy == "strict_newer")), F.lit("skipped")).otherwise(F.lit("updated"))


def upsert(concepts: DataFrame, incoming: DataFrame, policy: str) -> DataFrame:
    """id, action, tag_list, markdown, updated_at of each incoming record (id, ts, raw_text, tag_list, entity_types).

    ``local_first`` adds the entity types to the tags and takes the raw text as markdown; ``strict_newer`` replaces the
    tags and leaves the markdown; ``pull`` takes the raw text.
    """
    old = concepts.select("id", F.col("updated_at").alias("o_ms"), F.col("tag_list").alias("o_tags"), F.col("markdown").alias("o_md"))
    rows = incoming.join(old, "id", "left").withColumn("action", decide(F.col("o_ms"), F.col("ts"), policy))
    none = F.array().cast("array<string>")
    if policy == "local_first":
        tags, md = union_tags(F.col("o_tags"), F.col("entity_types")), F.coalesce("raw_text", "o_md")
    elif policy == "strict_newer":
        tags, md = F.coalesce("tag_list", none), F.col("o_md")
    else:
        tags, md = F.coalesce("o_tags", none), F.coalesce("raw_text", "o_md")
    hit = F.col("action") != "skipped"
    return rows.select("id", "action", F.when(hit, tags).otherwise(F.coalesce("o_tags", none)).alias("tag_list"), F.when(hit, md).otherwise(F.col("o_md")).alias("markdown"), F.when(hit, F.col("ts")).otherwise(F.col("o_ms")).alias("updated_at"))


def upsert_counts(decided: DataFrame) -> DataFrame:
    a = F.col("action")
    return decided.agg(F.count_if(a == "inserted").alias("inserted"), F.count_if(a == "updated").alias("updated"), F.count_if(a == "skipped").alias("skipped"), F.count(F.lit(1)).alias("total"))


def delete(concepts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the ids, ids that were not there)."""
    ids = ids.select("id").distinct()
    return concepts.join(ids, "id", "left_anti"), ids.join(concepts.select("id"), "id", "left_anti")


def without_tombstones(entries: DataFrame) -> DataFrame:
    """Of each key the last entry, unless it is a delete marker."""
    last = entries.groupBy("key").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "key"]), "seq").alias("m")).select("key", "m.*")
    return last.filter(~F.coalesce("tombstone", F.lit(False)))
