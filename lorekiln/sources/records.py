"""Reading and writing records: JSON arrays, bundles packed or not, snapshots, key/value repositories, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.hashing import gunzip_bytes
from lorekiln.functions.text import has_all
from lorekiln.operators.store import in_parts
from lorekiln.operators.validate import Rule, validate


def read_records(spark: SparkSession, path: str, schema: str, rules: list[Rule] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid records, (file, position, error)) of files that each hold a JSON array.

    Errors: a file that is not readable or no array (position null), an element that is no object or breaks the rules. If
    ``strict`` the first error ends the job and is named.
    """
    return parse_records(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value"), "value", "file", schema, rules, strict)


def parse_records(raw: DataFrame, content: str, name: str, schema: str, rules: list[Rule] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``read_records``, of texts in a column."""
    rows = raw.select(F.col(name).cast("string").alias("file"), F.col(content).alias("_text"))
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("_text")).startswith("ARRAY"), F.lit(False)) & F.ltrim("_text").startswith("[")
    rows = rows.withColumn("_array", readable)
    whole = rows.filter(~F.col("_array")).select("file", F.lit(None).cast("int").alias("position"), F.lit("not a JSON array").alias("error"))
    items = rows.filter("_array").select("file", F.posexplode(F.from_json("_text", "array<variant>")).alias("position", "_v"))
    items = items.withColumn("_json", F.to_json("_v"))
    shaped = F.coalesce(F.ltrim("_json").startswith("{"), F.lit(False))
    got = items.filter(shaped).select("file", "position", F.from_json("_json", schema).alias("_r"))
    got = got.select("file", "position", "_r.*")
    errors = whole.unionByName(items.filter(~shaped).select("file", "position", F.lit("not an object").alias("error")))
    if rules:
        checked = validate(got, rules)
        why = F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(" "), e["message"])), "; ")
        errors = errors.unionByName(checked.filter(F.size("errors") > 0).select("file", "position", why.alias("error")))
        got = checked.filter(F.size("errors") == 0).drop("errors")
    if strict and (first := errors.orderBy("file", "position").first()):
        raise ValueError(f"{first.file}, element {first.position}: {first.error}")
    return got.drop("file", "position"), errors


def parse_bundles(raw: DataFrame, content: str, element: str) -> DataFrame:
    """Elements of bundles held as bytes, gzip or not: a bare array or an envelope {"thoughtforms": [...]}.

    A bundle with no readable element gives none.
    """
    text = gunzip_bytes(F.col(content).cast("binary")).cast("string")
    rows = raw.withColumn("_text", text)
    bare = F.from_json("_text", f"array<{element}>")
    inside = F.from_json("_text", f"struct<thoughtforms:array<{element}>>")["thoughtforms"]
    keep = [c for c in raw.columns if c != content]
    return rows.select(*keep, F.inline(F.when(F.ltrim("_text").startswith("["), bare).otherwise(inside)))


def read_bundles(spark: SparkSession, path: str, element: str) -> DataFrame:
    return parse_bundles(spark.read.format("binaryFile").load(path).select("path", "content"), "content", element)


def parse_snapshot(raw: DataFrame, content: str, strict: bool = True) -> DataFrame:
    """Concepts of a snapshot {"concepts": [...]}: missing fields are null, tags that are not strings are dropped, an
    element without an id ends the job and names its position; if not ``strict`` it comes out with a null id. ``n``: its position."""
    v = F.try_parse_json(F.col(content))
    items = F.from_json(F.get_json_object(content, "$.concepts"), "array<variant>")
    rows = raw.filter(v.isNotNull()).select(F.posexplode(items).alias("n", "v"))
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    id_ = F.nullif(get("id"), F.lit(""))
    if strict:
        id_ = F.coalesce(id_, F.raise_error(F.concat(F.lit("concept without id at "), F.col("n").cast("string"))))
    tags = F.filter(F.transform(F.try_variant_get("v", "$.tags", "array<variant>"), lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string"))), lambda t: t.isNotNull())
    none = F.array().cast("array<string>")
    return rows.select("n", id_.alias("id"), F.coalesce(get("namespace"), F.lit("default")).alias("namespace"), F.coalesce(tags, none).alias("tag_list"), get("markdown").alias("markdown"), F.try_variant_get("v", "$.embedding", "array<float>").alias("embedding"), F.get_json_object(F.to_json("v"), "$.thoughtform").alias("thoughtform"))


def snapshot(concepts: DataFrame, namespace: str | None = None, with_embedding: bool = False, only_present: bool = False) -> DataFrame:
    """One JSON document per concept, with its size and hash. Write it with ``write.text``; a table is never one document."""
    rows = concepts if namespace is None else concepts.filter(F.col("namespace") == namespace)
    cols = [c for c in ("id", "namespace", "version", "created_at", "updated_at", "tag_list", "markdown", "thoughtform") if c in rows.columns] + (["embedding"] if with_embedding else [])
    doc = F.to_json(F.struct(*cols), {"ignoreNullFields": str(only_present).lower()})
    return rows.select("id", doc.alias("document")).withColumn("bytes", F.octet_length("document")).withColumn("hash", F.sha2("document", 256))


def write_snapshot(concepts: DataFrame, path: str, **options) -> None:
    snapshot(concepts, **options).select("document").write.mode("error").option("compression", "gzip").text(path)


def export_bundle(concepts: DataFrame, since_ms: int | None = None) -> DataFrame:
    """namespace, part, count, last_synced, document: an envelope of the structured forms changed after a time, per
    namespace; a large namespace makes several."""
    rows = concepts.filter(F.col("thoughtform").isNotNull() & F.try_parse_json(F.col("thoughtform")).isNotNull())
    if since_ms is not None:
        rows = rows.filter(F.col("updated_at") > since_ms)
    g = in_parts(rows, "namespace").groupBy("namespace", "part").agg(F.array_sort(F.collect_list(F.struct("updated_at", "id", "thoughtform"))).alias("t"), F.count(F.lit(1)).alias("count"), F.max("updated_at").alias("last_synced"))
    doc = F.concat(F.lit('{"version":"1.0","thoughtforms":['), F.array_join(F.transform("t", lambda x: x["thoughtform"]), ","), F.lit('],"metadata":{"lastSynced":'), F.col("last_synced").cast("string"), F.lit(',"count":'), F.col("count").cast("string"), F.lit("}}"))
    return g.select("namespace", "part", "count", "last_synced", doc.alias("document"))


def to_entries(concepts: DataFrame) -> DataFrame:
    """key, content, content_type, tags: up to two entries of a key/value repository per concept."""
    e = lambda kind, col, mime: F.struct(F.concat(F.lit("concepts/"), F.col("id"), F.lit(f"/{kind}")).alias("key"), F.col(col).alias("content"), F.lit(mime).alias("content_type"), F.col("tag_list").alias("tags"))
    both = F.array(e("markdown", "markdown", "text/markdown"), e("thoughtform", "thoughtform", "application/json"))
    return concepts.select(F.inline(F.filter(both, lambda x: x["content"].isNotNull())))


def tombstones(ids: DataFrame, seq: Column) -> DataFrame:
    """key, content, content_type, tags, tombstone, seq: delete markers of both entries of deleted concepts; ``mutate.without_tombstones`` honours them."""
    keys = F.array(*[F.concat(F.lit("concepts/"), F.col("id"), F.lit(f"/{kind}")) for kind in ("markdown", "thoughtform")])
    return ids.select(F.explode(keys).alias("key"), seq.alias("seq")).select("key", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("content_type"), F.array().cast("array<string>").alias("tags"), F.lit(True).alias("tombstone"), "seq")


def from_entries(entries: DataFrame) -> DataFrame:
    """id, markdown of the markdown entries; other keys are ignored."""
    rows = entries.filter(F.col("key").startswith("concepts/") & F.col("key").endswith("/markdown"))
    return rows.select(F.get(F.split("key", "/"), F.lit(1)).alias("id"), F.col("content").alias("markdown"))


def to_archive(concepts: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """id, content, tags (a map): markdown, else the structured form; only concepts with every required tag."""
    content = F.coalesce("markdown", "thoughtform")
    mime = F.when(F.col("markdown").isNotNull(), "text/markdown").otherwise("application/json")
    marks = F.transform(F.array_distinct(F.coalesce("tag_list", F.array().cast("array<string>"))), lambda t: F.struct(F.concat(F.lit("tag-"), t), F.lit("true")))
    rows = concepts.filter(has_all(F.col("tag_list"), list(required)) & content.isNotNull())
    return rows.select("id", content.alias("content"), F.map_from_entries(F.concat(F.array(F.struct(F.lit("Content-Type"), mime)), marks)).alias("tags"))
