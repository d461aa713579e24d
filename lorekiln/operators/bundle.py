"""The bundle pipeline: records to a content-addressed, chunked, checked bundle, and back.

Backup: validate, filter by time, put in canonical order, derive ids from the contents, serialize, compress, encrypt, cut.
A bundle is made per group (a namespace), so a backup of everything is as many tasks as groups; the dedupe key is looked
up before anything is written, and the nonce stays with the bytes, so encrypted backups can be restored. Restore: check
and join the chunks, decrypt, unpack, compare the hash, parse, validate, replay in commit order, keep the last writer of each id.

A bundle is an envelope: version, id, commit (with its parent, author and mode), manifest, delta (the times it covers) and the records
with all their fields. Its hash and the number of its chunks, which it cannot name itself, are those of its commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.hashing import CHUNK_LIMIT, decrypt, encrypt, gunzip_bytes, gzip_bytes, idempotency_key, sha256
from lorekiln.operators.merge import latest_commit
from lorekiln.operators.store import MOST_RECORDS, chunk, dedupe_key, in_parts, reassemble
from lorekiln.operators.validate import Rule, at_least, epoch, filled, validate

#: Fields of a record and their types; those a caller's records lack are null. ``form``: the structured form as JSON text.
RECORD = {
    "ts": "bigint", "id": "string", "hash": "string", "source": "string", "raw_text": "string", "namespace": "string", "version": "int", "tag_list": "array<string>",
    "author": "string", "lang": "string", "form": "string",
}
_FORMS = "array<struct<" + ",".join(f"{k}:{v}" for k, v in RECORD.items()) + ">>"
ENVELOPE = (
    "struct<version:string,bundleId:string,commit:struct<commitId:string,parentCommitId:string,authorPrincipal:string,createdAtMs:bigint,syncMode:string,dedupeKey:string>,"
    "manifest:struct<thoughtformCount:bigint,payloadHash:string,compression:string,encryption:string,chunkCount:int,chunkSizeMaxBytes:int>,"
    f"delta:struct<sinceUpdatedAtMsExclusive:bigint,untilUpdatedAtMsInclusive:bigint>,thoughtforms:{_FORMS}>"
)


def pack(
    records: DataFrame, group: str, compress: bool = True, key: bytes | None = None, since_ms: int = 0, require_encryption: bool = False, most: int = MOST_RECORDS,
    created_at_ms: int = 0, parent: str | None = None, author: str | None = None, mode: str = "backup", chunk_size: int = CHUNK_LIMIT,
) -> DataFrame:
    """group, part, bundle_id, commit_id, dedupe_key, payload_hash, records, since_ms, until_ms, payload: one bundle per
    group, more for a group of more than ``most`` records.

    ``payload_hash`` is that of the plain JSON. The nonce is derived from the contents and so never used for two contents.
    """
    if require_encryption and key is None:
        raise ValueError("encryption is required but no key was given")
    rows = in_parts(records.filter(F.col("ts") > since_ms), group, most)
    ids = dedupe_key(rows, group, "gzip" if compress else "none", key is not None).withColumnsRenamed({group: "g2", "part": "part2"})
    fields = [(F.col(c) if c in records.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items()]
    body = rows.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"), F.max("ts").alias("until_ms"))
    out = body.join(ids, F.col(group).eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2")))
    commit = F.struct(F.col("commit_id").alias("commitId"), F.lit(parent).alias("parentCommitId"), F.lit(author).alias("authorPrincipal"), F.lit(created_at_ms).cast("long").alias("createdAtMs"), F.lit(mode).alias("syncMode"), F.col("dedupe_key").alias("dedupeKey"))
    manifest = F.struct(F.col("records").alias("thoughtformCount"), F.lit("gzip" if compress else "none").alias("compression"), F.lit("none" if key is None else "aes-gcm").alias("encryption"), F.lit(chunk_size).alias("chunkSizeMaxBytes"))
    delta = F.struct(F.lit(since_ms).cast("long").alias("sinceUpdatedAtMsExclusive"), F.col("until_ms").alias("untilUpdatedAtMsInclusive"))
    doc = F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("bundle_id").alias("bundleId"), commit.alias("commit"), manifest.alias("manifest"), delta.alias("delta"), F.col("r").alias("thoughtforms")))
    out = out.withColumn("plain", doc.cast("binary"))
    out = out.withColumn("payload_hash", sha256(F.col("plain"))).withColumn("payload", gzip_bytes(F.col("plain")) if compress else F.col("plain"))
    if key is not None:
        out = out.withColumn("payload", encrypt(F.col("payload"), key, F.substring(F.unhex(F.sha2(F.concat(F.col("payload"), F.lit(key)), 256)), 1, 12)))
    return out.select(group, "part", "bundle_id", "commit_id", "dedupe_key", "payload_hash", "records", F.lit(since_ms).cast("long").alias("since_ms"), "until_ms", "payload")


def backup(records: DataFrame, known: DataFrame, group: str, created_at_ms: int, chunk_size: int = CHUNK_LIMIT, author: str | None = None, mode: str = "backup", **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, commits) to append. Bundles whose dedupe key is known are left out, so running again writes nothing.

    The parent of the new commits is the latest known one, if ``known`` has times.
    """
    last = latest_commit(known).first() if {"created_at_ms", "commit_id"} <= set(known.columns) else None
    parent = last.commit_id if last else None
    new = pack(records, group, created_at_ms=created_at_ms, parent=parent, author=author, mode=mode, chunk_size=chunk_size, **options).join(known.select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    parts = chunk(new, "commit_id", F.col("payload"), chunk_size).join(new.select("commit_id", "bundle_id"), "commit_id")
    parts = parts.withColumn("created_at_ms", F.lit(created_at_ms)).withColumn("idempotency_key", idempotency_key(F.col("commit_id"), F.col("chunk_index"), F.col("chunk_hash")))
    commits = new.select(
        "commit_id", "bundle_id", "dedupe_key", F.col("payload_hash").alias("manifest_hash"), F.lit(created_at_ms).cast("long").alias("created_at_ms"), F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_size)).cast("int").alias("chunk_count"),
        F.lit(parent).cast("string").alias("parent_commit_id"), F.lit(author).cast("string").alias("author_principal"), F.lit(mode).alias("sync_mode"), "records", "since_ms", "until_ms",
    )
    return parts, commits


def restore(
    chunks: DataFrame, commits: DataFrame, key: bytes | None = None, since_ms: int = 0, id_prefix: str = "", updated_since_ms: int | None = None, rules: list[Rule] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(the fields of ``RECORD``, (commit_id, error)): the last writer of each id over all commits later than a time.

    ``id_prefix`` and ``updated_since_ms`` keep only such records; records that break ``rules`` are errors of their commit.
    """
    wanted = commits.filter(F.col("created_at_ms") > since_ms).select("commit_id", "manifest_hash", F.col("created_at_ms").alias("at"))
    whole, bad = reassemble(chunks.join(wanted.select("commit_id"), "commit_id", "left_semi"), "commit_id")
    plain = F.col("payload") if key is None else decrypt(F.col("payload"), key)
    got = whole.join(wanted, "commit_id").withColumn("plain", gunzip_bytes(plain))
    got = got.withColumn("error", F.when(F.col("plain").isNull(), "cannot be decrypted or unpacked").when(sha256(F.col("plain")) != F.col("manifest_hash"), "payload hash mismatch"))
    parsed = F.from_json(F.col("plain").cast("string"), f"struct<thoughtforms:{_FORMS}>")
    rows = got.filter(F.col("error").isNull()).select("at", "commit_id", F.posexplode(parsed["thoughtforms"]).alias("n", "r")).select("at", "commit_id", "n", "r.*")
    errors = bad.unionByName(got.filter(F.col("error").isNotNull()).select("commit_id", "error"))
    if rules:
        checked = validate(rows, rules)
        named = F.concat(F.lit("invalid record "), F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join(F.transform("errors", lambda e: e["path"]), ", "))
        errors = errors.unionByName(checked.filter(F.size("errors") > 0).select("commit_id", named.alias("error")))
        rows = checked.filter(F.size("errors") == 0).drop("errors")
    rows = rows.filter(F.col("id").startswith(id_prefix))
    if updated_since_ms is not None:
        rows = rows.filter(F.col("ts") > updated_since_ms)
    rest = [c for c in RECORD if c not in ("id", "ts", "hash")]
    rows = rows.withColumn("seq", F.struct("at", "commit_id", "n"))  # of full ties the first in replay order is kept
    best = rows.groupBy("id", "ts", "hash").agg(F.min_by(F.struct(*rest), "seq").alias("m"))
    best = best.groupBy("id").agg(F.max_by(F.struct("ts", "hash", "m"), F.struct("ts", "hash")).alias("b"))
    return best.select("id", "b.ts", "b.hash", *[F.col(f"b.m.{c}").alias(c) for c in rest]), errors


def restored_rules() -> list[Rule]:
    """What a record must have to be taken over: id, content hash, source, time."""
    return [filled("id", F.col("id")), at_least("contentHash", F.col("hash"), 16), filled("source", F.col("source")), epoch("updatedAtMs", F.col("ts"))]
