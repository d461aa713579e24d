"""Validation: rules that give an array of errors (path, message, code) for each row, empty if all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.hashing import CHUNK_LIMIT
from lorekiln.functions.timing import is_epoch_ms

#: The values that commits, manifests, chunks and forms may hold.
MODES = ("backup", "merge", "rebase")
COMPRESSIONS, ENCODINGS, ENCRYPTIONS = ("none", "gzip"), ("base64", "raw"), ("none", "aes-gcm")
FORM_SOURCES = ("user_input", "converted", "extracted")
UUID, INSTANT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
Rule = tuple[str, str, str, Column]


def filled(path: str, col: Column) -> Rule:
    return (path, "must not be empty", "too_small", F.coalesce(F.length(col) > 0, F.lit(False)))


def at_least(path: str, col: Column, n: int) -> Rule:
    return (path, f"must have at least {n} characters", "too_small", F.coalesce(F.length(col) >= n, F.lit(False)))


def epoch(path: str, col: Column) -> Rule:
    return (path, "must be a whole number of milliseconds, not negative", "invalid_type", is_epoch_ms(col))


def matches(path: str, col: Column, pattern: str, message: str) -> Rule:
    return (path, message, "invalid_string", F.coalesce(col.rlike(pattern), F.lit(False)))


def one_of(path: str, col: Column, values: tuple[str, ...]) -> Rule:
    return (path, "must be one of " + ", ".join(values), "invalid_enum_value", F.coalesce(col.isin(*values), F.lit(False)))


def between(path: str, col: Column, lo: float, hi: float) -> Rule:
    return (path, f"must be {lo} to {hi}", "out_of_range", F.coalesce(col.between(lo, hi), F.lit(False)))


def every(path: str, col: Column, ok) -> Rule:
    """All elements of an array pass; a null array does not."""
    return (path, "has an element that breaks the rules", "invalid_element", F.coalesce(F.forall(col, lambda e: F.coalesce(ok(e), F.lit(False))), F.lit(False)))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with ``errors``."""
    made = [F.when(~ok, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"), F.lit(code).alias("code"))) for path, message, code, ok in rules]
    return df.withColumn("errors", F.filter(F.array(*made), lambda e: e.isNotNull()))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with errors)."""
    checked = validate(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def require(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows; the first row that breaks a rule ends the job with its errors."""
    checked = validate(df, rules)
    fine = F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(F.to_json("errors")).cast("boolean"))
    return checked.filter(fine).drop("errors")


def record_rules() -> list[Rule]:
    """Records of versions: id, content hash, source, time."""
    return [filled("id", F.col("id")), at_least("metadata.contentHash", F.col("content_hash"), 16), filled("metadata.source", F.col("source")), epoch("metadata.updatedAtMs", F.col("updated_at"))]


def sync_form_rules(f: Column) -> list[Rule]:
    unit = lambda c: c.isNull() | c.between(0.0, 1.0)
    text = lambda c: F.length(c) > 0
    return [
        filled("id", f["id"]), at_least("metadata.contentHash", f["metadata"]["contentHash"], 16), filled("metadata.source", f["metadata"]["source"]),
        epoch("metadata.createdAtMs", f["metadata"]["createdAtMs"]), epoch("metadata.updatedAtMs", f["metadata"]["updatedAtMs"]),
        every("entities", f["entities"], lambda e: text(e["id"]) & text(e["type"]) & e["value"].isNotNull() & unit(e["confidence"])),
        every("relationships", f["relationships"], lambda r: text(r["id"]) & text(r["type"]) & text(r["from"]) & text(r["to"])),
    ]


def live_form_rules(f: Column) -> list[Rule]:
    """Missing entities, relationships, language, source and tags have defaults and break no rule."""
    unit, text = (lambda c: c.between(0.0, 1.0)), (lambda c: c.isNotNull())
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    meta = f["metadata"]
    return [
        matches("id", f["id"], UUID, "must be a UUID"), ("rawText", "must be a text", "invalid_type", f["rawText"].isNotNull()),
        matches("metadata.createdAt", meta["createdAt"], INSTANT, "must be an instant"), matches("metadata.updatedAt", meta["updatedAt"], INSTANT, "must be an instant"),
        one_of("metadata.source", F.coalesce(meta["source"], F.lit(FORM_SOURCES[0])), FORM_SOURCES),
        every("entities", none(f["entities"], ENTITIES), lambda e: text(e["id"]) & text(e["text"]) & text(e["type"]) & unit(e["confidence"]) & e["offset"]["start"].isNotNull() & e["offset"]["end"].isNotNull()),
        every("relationships", none(f["relationships"], RELATIONSHIPS), lambda r: text(r["subjectId"]) & text(r["predicate"]) & text(r["objectId"]) & (r["confidence"].isNull() | unit(r["confidence"]))),
    ]


ENTITIES = "array<struct<id:string,text:string,type:string,confidence:double,offset:struct<start:int,end:int>>>"
RELATIONSHIPS = "array<struct<subjectId:string,predicate:string,objectId:string,confidence:double>>"


def commit_rules(prefix: str = "", mode: str = "sync_mode") -> list[Rule]:
    return [filled(prefix + "commitId", F.col("commit_id")), filled(prefix + "dedupeKey", F.col("dedupe_key")), one_of(prefix + "syncMode", F.col(mode), MODES), epoch(prefix + "createdAtMs", F.col("created_at_ms"))]


def manifest_rules(m: Column) -> list[Rule]:
    return [
        between("manifest.thoughtformCount", m["thoughtformCount"], 0, 2**63 - 1), filled("manifest.payloadHash", m["payloadHash"]), one_of("manifest.compression", m["compression"], COMPRESSIONS),
        one_of("manifest.encryption", m["encryption"], ENCRYPTIONS), between("manifest.chunkCount", m["chunkCount"], 1, 2**31 - 1), between("manifest.chunkSizeMaxBytes", m["chunkSizeMaxBytes"], 1, CHUNK_LIMIT),
    ]


def delta_rules(d: Column) -> list[Rule]:
    return [epoch("delta.sinceUpdatedAtMsExclusive", d["sinceUpdatedAtMsExclusive"]), epoch("delta.untilUpdatedAtMsInclusive", d["untilUpdatedAtMsInclusive"])]


def bundle_rules(b: Column) -> list[Rule]:
    """An envelope: version, id, commit, manifest, delta, forms. ``b`` has the fields of ``bundle.ENVELOPE``."""
    c = b["commit"]
    return [
        ("version", "must be a text", "invalid_type", b["version"].isNotNull()), filled("bundleId", b["bundleId"]), filled("commit.commitId", c["commitId"]), filled("commit.dedupeKey", c["dedupeKey"]),
        one_of("commit.syncMode", c["syncMode"], MODES), epoch("commit.createdAtMs", c["createdAtMs"]), *manifest_rules(b["manifest"]), *delta_rules(b["delta"]),
        ("thoughtforms", "must be an array", "invalid_type", b["thoughtforms"].isNotNull()),
    ]


def chunk_rules() -> list[Rule]:
    return [
        filled("bundleId", F.col("bundle_id")), filled("commitId", F.col("commit_id")), filled("chunkHash", F.col("chunk_hash")), between("chunkIndex", F.col("chunk_index"), 0, 2**31 - 1),
        between("chunkCount", F.col("chunk_count"), 1, 2**31 - 1), between("payload", F.octet_length("payload"), 0, CHUNK_LIMIT),
        ("compressed", "must be true or false", "invalid_type", F.col("compressed").isNotNull()), ("encrypted", "must be true or false", "invalid_type", F.col("encrypted").isNotNull()),
    ]
