"""Queries on validation, logs, repositories, the bundle pipeline and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.functions.hashing import canonical_json as canonical
from lorekiln.functions.hashing import decrypt, encrypt, from_base64, gunzip_bytes, gzip_bytes, to_base64
from lorekiln.functions.masking import FAILURES, OTHER_FAILURE, SECRET_FIELDS, classify, redact
from lorekiln.operators import bundle as B
from lorekiln.operators import validate as Q
from lorekiln.operators.convert import parse_form
from lorekiln.operators.mutate import without_tombstones
from lorekiln.plans.concept_queries import C, concepts
from lorekiln.plans.record_queries import R, records
from lorekiln.plans.session import table
from lorekiln.plans.stages import write_stage
from lorekiln.sources import records as IO
from lorekiln.streaming import changes as P

KEY = bytes(range(32))
THRESHOLD = 50


def validate_records(spark, sf_dir):
    got = Q.validate(table(spark, sf_dir, "thoughtform_deltas"), Q.record_rules())
    return got.select("record_no", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("errors"))


def validate_chunks(spark, sf_dir):
    got = Q.validate(table(spark, sf_dir, "chunks"), Q.chunk_rules()).filter(F.size("errors") > 0)
    return got.select("bundle_id", "chunk_index", "created_at_ms", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("errors"))


def validate_commits(spark, sf_dir):
    got = Q.validate(table(spark, sf_dir, "commits"), Q.commit_rules())
    return got.select(F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("commits"))


def validate_forms(spark, sf_dir):
    """Readable structured forms of both shapes, with the rules they break."""
    f = concepts(spark, sf_dir).select(F.col("id").alias("concept"), parse_form(F.col("thoughtform")).alias("p")).filter(F.col("p.shape").isin("live", "sync"))
    live = Q.validate(f.filter(F.col("p.shape") == "live"), Q.live_form_rules(F.col("p.live")))
    sync = Q.validate(f.filter(F.col("p.shape") == "sync"), Q.sync_form_rules(F.col("p.sync")))
    return live.unionByName(sync).select("concept", "p.shape", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("errors"))


def validate_bundles(spark, sf_dir):
    """Envelopes of a backup, one of them spoilt in each of several ways, with the rules they break."""
    packed = B.pack(records(spark, sf_dir), "namespace", compress=False, created_at_ms=1_700_000_000_000)
    b = packed.select(F.from_json(F.col("payload").cast("string"), B.ENVELOPE).alias("b"), "namespace", "payload_hash", "records")
    b = b.withColumn("b", F.col("b").withField("manifest.payloadHash", F.col("payload_hash")).withField("manifest.chunkCount", F.lit(1)))
    spoilt = [("none", F.col("b")), ("mode", F.col("b").withField("commit.syncMode", F.lit("restore"))), ("chunks", F.col("b").withField("manifest.chunkCount", F.lit(0))), ("times", F.col("b").withField("delta.untilUpdatedAtMsInclusive", F.lit(-1).cast("long"))), ("id", F.col("b").withField("bundleId", F.lit("")))]
    rows = b.select("namespace", "records", F.inline(F.array(*[F.struct(F.lit(n).alias("fault"), c.alias("b")) for n, c in spoilt])))
    return Q.validate(rows, Q.bundle_rules(F.col("b"))).select("namespace", "records", "fault", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("errors"))


def json_array_records(spark, sf_dir):
    """Files of records: an array of each namespace's records, one that is a single object, one cut off; records and errors are counted."""
    r = records(spark, sf_dir).select("namespace", F.to_json(F.struct("id", "ts", "hash", "source")).alias("j"))
    files = r.groupBy("namespace").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit(",7]")).alias("text")).select(F.coalesce("namespace", F.lit("-")).alias("file"), "text")
    odd = spark.createDataFrame([("object", '{"id":"x","ts":1,"hash":"h","source":"s"}'), ("cut", '[{"id":"x"')], "file string, text string")
    rules = [Q.filled("source", F.col("source"))]
    good, bad = IO.parse_records(files.unionByName(odd), "text", "file", "id string, ts bigint, hash string, source string", rules, strict=False)
    why = F.when(F.col("error").startswith("source"), "source").otherwise(F.col("error"))
    return good.select(F.lit("fine").alias("outcome")).unionByName(bad.select(why.alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def kv_tombstones(spark, sf_dir):
    """Repository entries after the concepts that no vector is indexed for were deleted: markers hide what was pushed before."""
    c = concepts(spark, sf_dir)
    gone = c.join(table(spark, sf_dir, "concept_vectors").select(F.col("concept_id").alias("id")), "id", "left_anti")
    pushed = IO.to_entries(c).withColumn("tombstone", F.lit(False)).withColumn("seq", F.lit(1).cast("long"))
    left = without_tombstones(pushed.unionByName(IO.tombstones(gone, F.lit(2).cast("long"))))
    return left.select("key", F.sha2("content", 256).alias("content_hash"))


def base64_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").select("bundle_id", "chunk_index", "created_at_ms", "payload", to_base64(F.col("payload")).alias("b64"))
    return c.select("bundle_id", "chunk_index", "created_at_ms", F.sha2("b64", 256).alias("hash"), F.length("b64").cast("long").alias("characters"), from_base64(F.col("b64")).eqNullSafe(F.col("payload")).alias("same"))


def redact_fields(spark, sf_dir):
    """Log fields of every chunk, without what must not be logged."""
    fields = F.create_map(F.lit("commitId"), F.col("commit_id"), F.lit("payload"), F.hex("payload"), F.lit("key"), F.col("idempotency_key"), F.lit("chunkIndex"), F.col("chunk_index").cast("string"))
    safe = table(spark, sf_dir, "chunks").select("bundle_id", "created_at_ms", redact(fields).alias("m"))
    return safe.select("bundle_id", "created_at_ms", *[F.col("m")[k].alias(k) for k in ("commitId", "payload", "key", "chunkIndex")])


def classify_failure(spark, sf_dir):
    """Events of the log by the class of failure that their user's number would stand for as an exit code."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("exit_code"))
    return e.groupBy("exit_code").agg(F.count(F.lit(1)).alias("events")).select("exit_code", "events", classify(F.col("exit_code"))["code"].alias("code"), classify(F.col("exit_code"))["remediation"].alias("remediation"))


def memory_entries(spark, sf_dir):
    return IO.to_entries(concepts(spark, sf_dir)).select("key", "content_type", F.sha2("content", 256).alias("content_hash"))


def pull_ids(spark, sf_dir):
    return IO.from_entries(IO.to_entries(concepts(spark, sf_dir))).select("id", F.sha2("markdown", 256).alias("markdown_hash"))


def archive_tags(spark, sf_dir):
    got = IO.to_archive(concepts(spark, sf_dir), ("adapter",))
    return got.select("id", F.sha2("content", 256).alias("content_hash"), F.col("tags")["Content-Type"].alias("content_type"), F.array_join(F.array_sort(F.map_keys("tags")), "|").alias("keys"))


def snapshot_sizes(spark, sf_dir):
    """Snapshot documents by namespace."""
    return IO.snapshot(concepts(spark, sf_dir), None).withColumn("namespace", F.get_json_object("document", "$.namespace")).groupBy("namespace").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))


def snapshot_roundtrip(spark, sf_dir):
    """Snapshot documents of a namespace's concepts each, read back."""
    one = F.struct("id", "namespace", F.col("tag_list").alias("tags"), "markdown", F.try_parse_json("thoughtform").alias("thoughtform"))
    docs = concepts(spark, sf_dir).groupBy("namespace").agg(F.concat(F.lit('{"version":"1.0.0","concepts":['), F.array_join(F.collect_list(F.to_json(one)), ","), F.lit("]}")).alias("document"))
    got = IO.parse_snapshot(docs, "document")
    return got.select("id", "namespace", F.array_join("tag_list", "|").alias("tags"), F.sha2("markdown", 256).alias("markdown_hash"), F.get_json_object("thoughtform", "$.rawText").alias("raw_text"))


def snapshot_present(spark, sf_dir):
    """The snapshot that names only what a concept has, read back."""
    docs = IO.snapshot(concepts(spark, sf_dir), only_present=True)
    return docs.select("id", F.get_json_object("document", "$.markdown").alias("markdown"), F.get_json_object("document", "$.version").cast("int").alias("version"))


def export_bundle(spark, sf_dir):
    parts = IO.export_bundle(concepts(spark, sf_dir), 1_710_000_000_000)
    return parts.groupBy("namespace").agg(F.sum("count").alias("count"), F.max("last_synced").alias("last_synced"))


def parse_bundles(spark, sf_dir):
    """Forms of the exported bundles, packed and read back."""
    docs = IO.export_bundle(concepts(spark, sf_dir)).select("namespace", gzip_bytes(F.col("document").cast("binary")).alias("content"))
    return IO.parse_bundles(docs, "content", "struct<id:string,rawText:string>").select("namespace", "id", F.col("rawText").alias("raw_text"))


def canonical_json(spark, sf_dir):
    c = concepts(spark, sf_dir).filter(F.col("thoughtform").isNotNull())
    return c.select("id", canonical(F.col("thoughtform")).alias("document"))


def gzip_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.sha2(gunzip_bytes(gzip_bytes(F.col("text").cast("binary"))), 256).alias("hash"))


def aes_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    nonce = F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 12)
    sealed = encrypt(F.col("text").cast("binary"), KEY, nonce)
    return d.select("doc_id", F.sha2(decrypt(sealed, KEY), 256).alias("hash"), (F.octet_length(sealed) - F.octet_length("text")).alias("overhead"), decrypt(sealed, KEY[::-1]).isNull().alias("wrong_key_fails"))


def bundle_sizes(spark, sf_dir):
    """Plain and packed bytes of each namespace's bundle; gzip bytes are this engine's, so rows only."""
    r = records(spark, sf_dir)
    plain = B.pack(r, "namespace", compress=False).groupBy(F.col("namespace").alias("ns")).agg(F.sum(F.octet_length("payload")).alias("plain"))
    small = B.pack(r, "namespace").groupBy("namespace").agg(F.sum(F.octet_length("payload")).alias("packed"))
    return small.join(plain, F.col("namespace").eqNullSafe(F.col("ns"))).select("namespace", "plain", "packed", F.round(F.col("packed") / F.col("plain"), 3).alias("ratio"))


def _store(spark, sf_dir):
    none = spark.createDataFrame([], "dedupe_key string")
    parts, commits = B.backup(records(spark, sf_dir), none, "namespace", 1_700_000_000_000, chunk_size=4096, key=KEY)
    return write_stage(parts).df, write_stage(commits).df  # a store is written, not worked out again by each reader


def bundle_roundtrip(spark, sf_dir):
    """All records through serializing, packing, encrypting, cutting and back."""
    got = B.restore(*_store(spark, sf_dir), key=KEY)[0]
    return got.select("id", "ts", "hash", F.sha2("raw_text", 256).alias("text_hash"), "source", "namespace", F.coalesce("version", F.lit(-1)).alias("version"), F.array_join("tag_list", "|").alias("tags"))


def bundle_restore_filtered(spark, sf_dir):
    """Restored records whose id begins with 0 or 1 and that changed after a time."""
    rows = [B.restore(*_store(spark, sf_dir), key=KEY, id_prefix=str(d), updated_since_ms=1_715_000_000_000)[0] for d in range(2)]
    return rows[0].unionByName(rows[1]).select("id", "ts", "hash")


def bundle_commits(spark, sf_dir):
    """The commits of a backup by namespace: ids come from the contents."""
    return B.pack(records(spark, sf_dir), "namespace", since_ms=1_715_000_000_000).select("namespace", "bundle_id", "dedupe_key", "records", "until_ms")


def backup_again(spark, sf_dir):
    """What a backup writes, and what a second one of the same records and of some changed ones adds."""
    r = records(spark, sf_dir)
    commits = _store(spark, sf_dir)[1]
    again = B.backup(r, commits, "namespace", 1_700_000_000_001, chunk_size=4096, key=KEY)[0]
    changed = r.withColumn("hash", F.when(F.col("namespace") == "default", F.sha2(F.coalesce("hash", F.lit("")), 256)).otherwise(F.col("hash")))
    more = B.backup(changed, commits, "namespace", 1_700_000_000_002, chunk_size=4096, key=KEY)[1]
    first = commits.agg(F.count(F.lit(1)).alias("commits"), F.sum("records").alias("records"))
    return first.join(F.broadcast(again.agg(F.count(F.lit(1)).alias("chunks_again")))).join(F.broadcast(more.agg(F.count(F.lit(1)).alias("commits_after_change"), F.max("records").alias("records_after_change"))))


def _log(spark, sf_dir):
    return P.change_log(table(spark, sf_dir, "events"))


def change_events(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids"))


def save_counter_triggers(spark, sf_dir):
    return P.save_counter(_log(spark, sf_dir), THRESHOLD)


def save_counter_per_id(spark, sf_dir):
    return P.save_counter(_log(spark, sf_dir), 5, "id")


def debounce_sessions(spark, sf_dir):
    return P.debounce(_log(spark, sf_dir), "1 hour")


def index_sync_final_state(spark, sf_dir):
    return P.final_state(_log(spark, sf_dir))


_NAMES = """validate_records validate_chunks validate_commits validate_forms validate_bundles json_array_records kv_tombstones base64_roundtrip redact_fields classify_failure memory_entries pull_ids archive_tags snapshot_sizes snapshot_roundtrip snapshot_present export_bundle
parse_bundles canonical_json gzip_roundtrip aes_roundtrip bundle_roundtrip bundle_restore_filtered bundle_commits bundle_sizes backup_again change_events save_counter_triggers save_counter_per_id debounce_sessions index_sync_final_state""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_L = "l AS (SELECT event_id, ts, user_id AS id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS type, value FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'view', 'error'))"
_COUNT = "WITH {l}, n AS (SELECT {g} AS grp, ts, row_number() OVER (PARTITION BY {g} ORDER BY ts, event_id) AS n FROM l WHERE type <> 'deleted') SELECT grp, n // {k} AS snapshot_no, ts AS fired_at FROM n WHERE n % {k} = 0"
_q = lambda s: s.replace("'", "''")
def _canonical(j: str, depth: int) -> str:
    """SQL for a JSON value with sorted keys at ``depth`` levels, without white space."""
    if not depth:
        return f"({j})::VARCHAR"
    k, e = f"k{depth}", f"e{depth}"
    pairs = f"list_transform(list_sort(json_keys({j})), lambda {k}: to_json({k})::VARCHAR || ':' || {_canonical(f'json_extract({j}, {k})', depth - 1)})"
    items = f"list_transform(CAST({j} AS JSON[]), lambda {e}: {_canonical(e, depth - 1)})"
    return f"(CASE json_type({j}) WHEN 'OBJECT' THEN '{{' || array_to_string({pairs}, ',') || '}}' WHEN 'ARRAY' THEN '[' || array_to_string({items}, ',') || ']' ELSE ({j})::VARCHAR END)"


_JSON = "f AS (SELECT id, namespace, updated_at, TRY_CAST(thoughtform AS JSON) AS j FROM c WHERE thoughtform IS NOT NULL AND TRY_CAST(thoughtform AS JSON) IS NOT NULL)"
_IS = lambda k: f"CASE WHEN '{k}' IN ({', '.join(repr(x) for x in SECRET_FIELDS)}) THEN '[REDACTED]' ELSE {{}} END"
ORACLES = {
    "validate_records": """SELECT record_no, concat_ws(',', CASE WHEN coalesce(length(id), 0) = 0 THEN 'id' END, CASE WHEN coalesce(length(content_hash), 0) < 16 THEN 'metadata.contentHash' END,
CASE WHEN coalesce(length(source), 0) = 0 THEN 'metadata.source' END, CASE WHEN updated_at IS NULL OR updated_at < 0 THEN 'metadata.updatedAtMs' END) AS errors FROM thoughtform_deltas""",
    "validate_chunks": """SELECT * FROM (SELECT bundle_id, chunk_index, created_at_ms, concat_ws(',', CASE WHEN coalesce(bundle_id, '') = '' THEN 'bundleId' END, CASE WHEN coalesce(commit_id, '') = '' THEN 'commitId' END, CASE WHEN coalesce(chunk_hash, '') = '' THEN 'chunkHash' END,
CASE WHEN NOT coalesce(chunk_index >= 0, false) THEN 'chunkIndex' END, CASE WHEN NOT coalesce(chunk_count > 0, false) THEN 'chunkCount' END, CASE WHEN NOT coalesce(octet_length(payload) <= 1000000, false) THEN 'payload' END,
CASE WHEN compressed IS NULL THEN 'compressed' END, CASE WHEN encrypted IS NULL THEN 'encrypted' END) AS errors FROM chunks) WHERE errors <> ''""",
    "validate_commits": """SELECT errors, count(*) AS commits FROM (SELECT concat_ws(',', CASE WHEN coalesce(commit_id, '') = '' THEN 'commitId' END, CASE WHEN coalesce(dedupe_key, '') = '' THEN 'dedupeKey' END, CASE WHEN NOT coalesce(sync_mode IN ('backup', 'merge', 'rebase'), false) THEN 'syncMode' END,
CASE WHEN NOT coalesce(created_at_ms >= 0, false) THEN 'createdAtMs' END) AS errors FROM commits) GROUP BY 1""",
    "validate_forms": f"""WITH {C}, f AS (SELECT id, TRY_CAST(thoughtform AS JSON) AS j FROM c WHERE TRY_CAST(thoughtform AS JSON) IS NOT NULL),
p AS (SELECT id, j, (j->>'$.schemaVersion') IS NOT NULL AS sync, coalesce(CAST(j->'$.entities' AS JSON[]), []) AS es, coalesce(CAST(j->'$.relationships' AS JSON[]), []) AS rs, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z$' AS iso FROM f)
SELECT id AS concept, CASE WHEN sync THEN 'sync' ELSE 'live' END AS shape, CASE WHEN NOT sync THEN concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(j->>'$.id', '{Q.UUID}'), false) THEN 'id' END, CASE WHEN (j->>'$.rawText') IS NULL THEN 'rawText' END,
  CASE WHEN NOT coalesce(regexp_matches(j->>'$.metadata.createdAt', iso), false) THEN 'metadata.createdAt' END, CASE WHEN NOT coalesce(regexp_matches(j->>'$.metadata.updatedAt', iso), false) THEN 'metadata.updatedAt' END,
  CASE WHEN coalesce(j->>'$.metadata.source', 'user_input') NOT IN ('user_input', 'converted', 'extracted') THEN 'metadata.source' END,
  CASE WHEN len(list_filter(es, lambda e: NOT coalesce((e->>'$.id') IS NOT NULL AND (e->>'$.text') IS NOT NULL AND (e->>'$.type') IS NOT NULL AND (e->>'$.confidence')::DOUBLE BETWEEN 0 AND 1 AND (e->>'$.offset.start') IS NOT NULL AND (e->>'$.offset.end') IS NOT NULL, false))) > 0 THEN 'entities' END,
  CASE WHEN len(list_filter(rs, lambda r: NOT coalesce((r->>'$.subjectId') IS NOT NULL AND (r->>'$.predicate') IS NOT NULL AND (r->>'$.objectId') IS NOT NULL AND coalesce((r->>'$.confidence')::DOUBLE, 0) BETWEEN 0 AND 1, false))) > 0 THEN 'relationships' END)
ELSE concat_ws(',', CASE WHEN coalesce(j->>'$.id', '') = '' THEN 'id' END, CASE WHEN length(coalesce(j->>'$.metadata.contentHash', '')) < 16 THEN 'metadata.contentHash' END, CASE WHEN coalesce(j->>'$.metadata.source', '') = '' THEN 'metadata.source' END,
  CASE WHEN NOT coalesce(TRY_CAST(j->>'$.metadata.createdAtMs' AS BIGINT) >= 0, false) THEN 'metadata.createdAtMs' END, CASE WHEN NOT coalesce(TRY_CAST(j->>'$.metadata.updatedAtMs' AS BIGINT) >= 0, false) THEN 'metadata.updatedAtMs' END,
  CASE WHEN (j->'$.entities') IS NULL OR len(list_filter(es, lambda e: NOT coalesce(length(e->>'$.id') > 0 AND length(e->>'$.type') > 0 AND (e->>'$.value') IS NOT NULL AND coalesce((e->>'$.confidence')::DOUBLE, 0) BETWEEN 0 AND 1, false))) > 0 THEN 'entities' END,
  CASE WHEN (j->'$.relationships') IS NULL OR len(list_filter(rs, lambda r: NOT coalesce(length(r->>'$.id') > 0 AND length(r->>'$.type') > 0 AND length(r->>'$.from') > 0 AND length(r->>'$.to') > 0, false))) > 0 THEN 'relationships' END) END AS errors FROM p""",
    "validate_bundles": f"""WITH {R}, k AS (SELECT namespace, count(*) AS records FROM r WHERE ts > 0 GROUP BY namespace)
SELECT namespace, records, fault, errors FROM k, (VALUES ('none', ''), ('mode', 'commit.syncMode'), ('chunks', 'manifest.chunkCount'), ('times', 'delta.untilUpdatedAtMsInclusive'), ('id', 'bundleId')) v(fault, errors)""",
    "json_array_records": f"""WITH {R} SELECT * FROM (SELECT 'fine' AS outcome, count(*) AS records FROM r WHERE source <> '' UNION ALL SELECT 'source', count(*) FROM r WHERE coalesce(source, '') = ''
UNION ALL SELECT 'not an object', count(DISTINCT coalesce(namespace, '-')) FROM r UNION ALL SELECT 'not a JSON array', 2) WHERE records > 0""",
    "kv_tombstones": f"""WITH {C}, k AS (SELECT * FROM c WHERE id IN (SELECT concept_id FROM concept_vectors)) SELECT 'concepts/' || id || '/markdown' AS key, sha256(markdown) AS content_hash FROM k WHERE markdown IS NOT NULL
UNION ALL SELECT 'concepts/' || id || '/thoughtform', sha256(thoughtform) FROM k WHERE thoughtform IS NOT NULL""",
    "base64_roundtrip": "SELECT bundle_id, chunk_index, created_at_ms, sha256(base64(payload)) AS hash, length(base64(payload)) AS characters, true AS same FROM chunks",
    "snapshot_sizes": f"""WITH {C} SELECT namespace, count(*) AS documents, sum(octet_length(encode(to_json({{'id': id, 'namespace': namespace, 'version': version, 'created_at': created_at, 'updated_at': updated_at, 'tag_list': tag_list, 'markdown': markdown, 'thoughtform': thoughtform}})::VARCHAR)))::BIGINT AS bytes FROM c GROUP BY namespace""",
    "redact_fields": f"SELECT bundle_id, created_at_ms, {_IS('commitId').format('commit_id')} AS \"commitId\", {_IS('payload').format('hex(payload)')} AS payload, {_IS('key').format('idempotency_key')} AS key, {_IS('chunkIndex').format('chunk_index::VARCHAR')} AS \"chunkIndex\" FROM chunks",
    "classify_failure": f"""WITH e AS (SELECT (user_id % 8)::INT AS exit_code, count(*) AS events FROM events GROUP BY 1) SELECT exit_code, events, CASE exit_code {' '.join(f"WHEN {k} THEN '{v[0]}'" for k, v in FAILURES.items())} ELSE '{OTHER_FAILURE[0]}' END AS code,
CASE exit_code {' '.join(f"WHEN {k} THEN '{_q(v[1])}'" for k, v in FAILURES.items())} ELSE '{_q(OTHER_FAILURE[1])}' END AS remediation FROM e""",
    "memory_entries": f"WITH {C} SELECT 'concepts/' || id || '/markdown' AS key, 'text/markdown' AS content_type, sha256(markdown) AS content_hash FROM c WHERE markdown IS NOT NULL UNION ALL SELECT 'concepts/' || id || '/thoughtform', 'application/json', sha256(thoughtform) FROM c WHERE thoughtform IS NOT NULL",
    "pull_ids": f"WITH {C} SELECT id, sha256(markdown) AS markdown_hash FROM c WHERE markdown IS NOT NULL",
    "archive_tags": f"""WITH {C} SELECT id, sha256(coalesce(markdown, thoughtform)) AS content_hash, CASE WHEN markdown IS NOT NULL THEN 'text/markdown' ELSE 'application/json' END AS content_type,
array_to_string(list_sort(list_concat(['Content-Type'], list_transform(list_distinct(tag_list), lambda t: 'tag-' || t))), '|') AS keys FROM c WHERE list_contains(tag_list, 'adapter') AND coalesce(markdown, thoughtform) IS NOT NULL""",
    "canonical_json": f"WITH {C}, f AS (SELECT id, thoughtform IS NULL AS none, TRY_CAST(thoughtform AS JSON) AS j FROM c) SELECT id, {_canonical('j', 4)} AS document FROM f WHERE NOT none",
    "snapshot_roundtrip": f"WITH {C} SELECT id, coalesce(namespace, 'default') AS namespace, array_to_string(coalesce(tag_list, []), '|') AS tags, sha256(markdown) AS markdown_hash, TRY_CAST(thoughtform AS JSON)->>'$.rawText' AS raw_text FROM c",
    "bundle_restore_filtered": f"WITH {R} SELECT DISTINCT ON (id) id, ts, hash FROM r WHERE ts > 1715000000000 AND substr(id, 1, 1) IN ('0', '1') ORDER BY id, ts DESC, hash DESC",
    "snapshot_present": f"WITH {C} SELECT id, markdown, version FROM c",
    "export_bundle": f"WITH {C}, {_JSON} SELECT namespace, count(*) AS count, max(updated_at) AS last_synced FROM f WHERE updated_at > 1710000000000 GROUP BY namespace",
    "parse_bundles": f"WITH {C}, {_JSON} SELECT namespace, j->>'$.id' AS id, j->>'$.rawText' AS raw_text FROM f",
    "gzip_roundtrip": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "aes_roundtrip": "SELECT doc_id, sha256(text) AS hash, 28 AS overhead, true AS wrong_key_fails FROM documents WHERE text IS NOT NULL",
    "bundle_roundtrip": f"WITH {R}, o AS (SELECT DISTINCT ON (id, ts, hash) * FROM r WHERE ts > 0 ORDER BY id, ts, hash, namespace, source NULLS FIRST, raw_text NULLS FIRST, version NULLS FIRST, tag_list NULLS FIRST) SELECT DISTINCT ON (id) id, ts, hash, sha256(raw_text) AS text_hash, source, namespace, coalesce(version, -1) AS version, array_to_string(tag_list, '|') AS tags FROM o ORDER BY id, ts DESC, hash DESC",
    "bundle_commits": f"""WITH {R}, k AS (SELECT namespace, count(*) AS records, max(ts) AS until_ms, sha256(coalesce(string_agg(hash, ':' ORDER BY ts, id, hash), '') || ':gzip:false') AS dedupe_key FROM r WHERE ts > 1715000000000 GROUP BY namespace)
SELECT namespace, 'bndl_' || substr(dedupe_key, 1, 32) AS bundle_id, dedupe_key, records, until_ms FROM k""",
    "backup_again": f"WITH {R}, k AS (SELECT namespace, count(*) AS n FROM r WHERE ts > 0 GROUP BY namespace) SELECT count(*) AS commits, sum(n)::BIGINT AS records, 0::BIGINT AS chunks_again, count(*) FILTER (namespace = 'default') AS commits_after_change, max(n) FILTER (namespace = 'default') AS records_after_change FROM k",
    "change_events": f"WITH {_L} SELECT type, count(*) AS events, count(DISTINCT id) AS ids FROM l GROUP BY type",
    "save_counter_triggers": _COUNT.format(l=_L, g="'all'", k=THRESHOLD),
    "save_counter_per_id": _COUNT.format(l=_L, g="id", k=5),
    "debounce_sessions": f"""WITH {_L}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first FROM l),
s AS (SELECT *, sum(first) OVER (PARTITION BY id ORDER BY ts, event_id) AS no FROM g) SELECT id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, count(*) AS events, arg_max(type, {{'t': ts, 'e': event_id}}) AS last_type FROM s GROUP BY id, no HAVING arg_max(type, {{'t': ts, 'e': event_id}}) <> 'deleted'""",
    "index_sync_final_state": f"WITH {_L}, w AS (SELECT DISTINCT ON (id) * FROM l ORDER BY id, ts DESC, event_id DESC) SELECT id, type, ts, event_id, value FROM w WHERE type <> 'deleted'",
}
