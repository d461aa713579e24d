"""Queries on chunks and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.functions.hashing import sha256
from lorekiln.operators import store as S
from lorekiln.operators.merge import latest_commit as latest
from lorekiln.plans.record_queries import R, records
from lorekiln.plans.session import table

SIZE = 1000


def dedupe_key(spark, sf_dir):
    return S.dedupe_key(records(spark, sf_dir), "namespace").drop("part")


def idempotency_keys(spark, sf_dir):
    return S.keyed_chunks(table(spark, sf_dir, "chunks")).select("bundle_id", "chunk_index", "idempotency_key", "derived_key")


def payload_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    return c.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("payload")).alias("bytes"), F.max(F.octet_length("payload")).alias("largest"))


def chunk_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.chunk(d, "doc_id", F.col("text"), SIZE).select("doc_id", "chunk_index", "chunk_count", F.length("payload").alias("characters"), "chunk_hash")


def reassemble_hash(spark, sf_dir):
    """The bundles whose chunks are all there and unchanged, put together."""
    return S.reassemble(table(spark, sf_dir, "chunks"), "bundle_id")[0].select("bundle_id", "bytes", sha256(F.col("payload")).alias("payload_hash"))


def reassemble_errors(spark, sf_dir):
    return S.reassemble(table(spark, sf_dir, "chunks"), "bundle_id")[1]


def reassemble_documents(spark, sf_dir):
    """Texts cut and put together again: equal to what they were."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    parts = S.chunk(d, "doc_id", F.col("b"), SIZE).withColumn("created_at_ms", F.lit(0))
    return S.reassemble(parts, "doc_id")[0].select("doc_id", "bytes", sha256(F.col("payload")).alias("payload_hash"))


def chunk_contiguity(spark, sf_dir):
    return S.contiguity(table(spark, sf_dir, "chunks"), "commit_id")


def put_chunk_idempotent(spark, sf_dir):
    return S.first_puts(table(spark, sf_dir, "chunks")).select("idempotency_key", "bundle_id", "chunk_index", "created_at_ms")


def _requests(spark, sf_dir):
    c = table(spark, sf_dir, "commits")
    return c.groupBy("commit_id").agg(F.max_by(F.struct("dedupe_key", "chunk_count", "sync_mode"), F.struct("stored_at", "dedupe_key")).alias("m")).select("commit_id", "m.*")


def finalize_outcomes(spark, sf_dir):
    """Commits of mode rebase and merge offered to a store that holds those of mode backup."""
    r = _requests(spark, sf_dir)
    known = r.filter(F.col("sync_mode") == "backup")
    asked = r.select("commit_id", "dedupe_key", F.col("chunk_count").alias("expected_chunks"))
    return S.finalize(asked, known, table(spark, sf_dir, "chunks"))


def list_commits(spark, sf_dir):
    return S.list_commits(table(spark, sf_dir, "commits").select("commit_id", "created_at_ms").distinct(), 1_700_000_000_000)


def list_commits_cursor(spark, sf_dir):
    c = table(spark, sf_dir, "commits").select("commit_id", "created_at_ms").distinct()
    return S.list_commits(c, 0, c.agg(F.min("commit_id").alias("commit_id")))


def latest_commit(spark, sf_dir):
    return latest(table(spark, sf_dir, "commits").select("commit_id", "created_at_ms", "bundle_id"))


def chunks_page(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    biggest = c.groupBy("commit_id").agg(F.countDistinct("idempotency_key").alias("n")).agg(F.min_by("commit_id", F.struct((-F.col("n")).alias("n"), "commit_id")).alias("commit_id"))
    return S.chunks_page(c, biggest, 1, 50).select("commit_id", "chunk_index", "idempotency_key")


def acl_visible_commits(spark, sf_dir):
    """What a reader of the authors whose name begins with prn-k may see."""
    c = table(spark, sf_dir, "commits")
    grants = c.filter(F.col("author_principal").startswith("prn-k")).select(F.lit("reader").alias("principal"), F.col("author_principal").alias("author"), F.lit("read").alias("role")).distinct()
    return S.visible(c, grants, "reader").select("commit_id", "author_principal", "stored_at")


def acl_writers(spark, sf_dir):
    """Writes offered by every author, where those whose name begins with prn-k may write: the rest are errors."""
    c = table(spark, sf_dir, "commits").select(F.col("author_principal").alias("principal"), "commit_id", "stored_at")
    grants = c.filter(F.col("principal").startswith("prn-k")).select("principal", F.lit(None).cast("string").alias("author"), F.lit("write").alias("role")).distinct()
    ok, refused = S.writable(c, grants)
    return ok.withColumn("error", F.lit(None).cast("string")).unionByName(refused).groupBy("principal", "error").agg(F.count(F.lit(1)).alias("writes"))


def next_pages(spark, sf_dir):
    """Where the page after the first begins, of commits and of the largest commit's chunks."""
    c, k = table(spark, sf_dir, "commits").select("commit_id", "created_at_ms").distinct(), table(spark, sf_dir, "chunks")
    biggest = k.groupBy("commit_id").agg(F.countDistinct("idempotency_key").alias("n")).agg(F.min_by("commit_id", F.struct((-F.col("n")).alias("n"), "commit_id")).alias("commit_id"))
    return spark.createDataFrame([(S.next_cursor(c, 50), S.next_cursor(c, 10**6), S.next_offset(k, biggest, 0, 1))], "next_cursor string, past_the_end string, next_offset int")


def commit_chunks(spark, sf_dir):
    """Commits with the number and bytes of their stored chunks."""
    one = S.first_puts(table(spark, sf_dir, "chunks")).groupBy("commit_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("payload")).alias("bytes"))
    return table(spark, sf_dir, "commits").select("commit_id").distinct().join(one, "commit_id")


def chunk_integrity(spark, sf_dir):
    """Stored chunks whose bytes no longer give their hash, or whose key is not the one they should have."""
    c = table(spark, sf_dir, "chunks")
    bad = ~F.coalesce(sha256(F.col("payload")) == F.col("chunk_hash"), F.lit(False))
    return c.filter(bad).select("bundle_id", "chunk_index", "created_at_ms", F.octet_length("payload").alias("bytes"))


_NAMES = "dedupe_key idempotency_keys payload_sizes chunk_hashes reassemble_hash reassemble_errors reassemble_documents chunk_contiguity put_chunk_idempotent finalize_outcomes list_commits list_commits_cursor latest_commit chunks_page acl_visible_commits acl_writers next_pages commit_chunks chunk_integrity".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_FIRST = "f AS (SELECT DISTINCT ON (idempotency_key) * FROM chunks ORDER BY idempotency_key, created_at_ms, bundle_id, chunk_index, chunk_hash)"
_CONT = "SELECT commit_id, count(DISTINCT chunk_index) AS stored, min(chunk_count) AS expected, min(chunk_index) = 0 AND max(chunk_index) = count(DISTINCT chunk_index) - 1 AND count(DISTINCT chunk_index) = min(chunk_count) AND min(chunk_count) = max(chunk_count) AS contiguous FROM chunks GROUP BY commit_id"
_PARTS = """WITH o AS (SELECT DISTINCT ON (bundle_id, chunk_index) * FROM chunks ORDER BY bundle_id, chunk_index, created_at_ms, chunk_hash),
g AS (SELECT bundle_id, count(*) AS n, min(chunk_count) AS lo, max(chunk_count) AS hi, max(chunk_index) AS top, min(chunk_index) AS bottom, bool_and(coalesce(sha256(payload) = chunk_hash, false)) AS fits, string_agg(hex(payload), '' ORDER BY chunk_index) AS digits FROM o GROUP BY 1),
e AS (SELECT *, CASE WHEN lo <> hi THEN 'inconsistent chunk count' WHEN n <> hi OR bottom <> 0 OR top <> n - 1 THEN 'missing chunk' WHEN NOT fits THEN 'hash mismatch' END AS error FROM g)"""
_REQ = "r AS (SELECT DISTINCT ON (commit_id) commit_id, dedupe_key, chunk_count, sync_mode FROM commits ORDER BY commit_id, stored_at DESC NULLS LAST, dedupe_key DESC NULLS LAST)"
ORACLES = {
    "dedupe_key": f"""WITH {R}, k AS (SELECT namespace, count(*) AS records, sha256(coalesce(string_agg(hash, ':' ORDER BY ts, id, hash), '') || ':none:false') AS dedupe_key FROM r GROUP BY namespace)
SELECT *, 'bndl_' || substr(dedupe_key, 1, 32) AS bundle_id, 'cmt_' || dedupe_key AS commit_id FROM k""",
    "idempotency_keys": "SELECT bundle_id, chunk_index, idempotency_key, sha256(commit_id || ':' || chunk_index || ':' || chunk_hash) AS derived_key FROM chunks",
    "payload_sizes": "SELECT bundle_id, count(*) AS rows, sum(octet_length(payload))::BIGINT AS bytes, max(octet_length(payload)) AS largest FROM chunks GROUP BY 1",
    "chunk_hashes": f"""WITH n AS (SELECT doc_id, text, greatest(1, ceil(length(text) / {SIZE}.0))::INT AS chunk_count FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, text, chunk_count, unnest(range(chunk_count))::INT AS chunk_index FROM n) SELECT doc_id, chunk_index, chunk_count, length(substr(text, chunk_index * {SIZE} + 1, {SIZE})) AS characters, sha256(substr(text, chunk_index * {SIZE} + 1, {SIZE})) AS chunk_hash FROM x""",
    "reassemble_hash": _PARTS + " SELECT bundle_id, (length(digits) / 2)::BIGINT AS bytes, sha256(unhex(digits)) AS payload_hash FROM e WHERE error IS NULL",
    "reassemble_errors": _PARTS + " SELECT bundle_id, error FROM e WHERE error IS NOT NULL",
    "reassemble_documents": "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS payload_hash FROM documents WHERE text IS NOT NULL",
    "chunk_contiguity": _CONT,
    "put_chunk_idempotent": f"WITH {_FIRST} SELECT idempotency_key, bundle_id, chunk_index, created_at_ms FROM f",
    "finalize_outcomes": f"""WITH {_REQ}, h AS ({_CONT}), k AS (SELECT dedupe_key, min(commit_id) AS duplicate_of FROM r WHERE sync_mode = 'backup' GROUP BY 1)
SELECT r.commit_id, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN r.sync_mode = 'backup' THEN 'commit exists' WHEN coalesce(stored, 0) <> chunk_count THEN 'count mismatch' WHEN NOT coalesce(contiguous, false) THEN 'gap' ELSE 'accepted' END AS outcome, duplicate_of
FROM r LEFT JOIN k USING (dedupe_key) LEFT JOIN h ON h.commit_id = r.commit_id""",
    "list_commits": "SELECT DISTINCT commit_id, created_at_ms FROM commits WHERE created_at_ms > 1700000000000 ORDER BY created_at_ms, commit_id LIMIT 50",
    "list_commits_cursor": """WITH c AS (SELECT DISTINCT commit_id, created_at_ms FROM commits WHERE created_at_ms > 0), a AS (SELECT max(created_at_ms) AS t, min(commit_id) AS i FROM c WHERE commit_id = (SELECT min(commit_id) FROM c))
SELECT commit_id, created_at_ms FROM c, a WHERE (created_at_ms, commit_id) > (t, i) ORDER BY created_at_ms, commit_id LIMIT 50""",
    "latest_commit": "SELECT commit_id, created_at_ms, bundle_id FROM commits ORDER BY created_at_ms DESC NULLS LAST, commit_id DESC LIMIT 1",
    "chunks_page": f"""WITH {_FIRST}, b AS (SELECT commit_id FROM chunks GROUP BY 1 ORDER BY count(DISTINCT idempotency_key) DESC, commit_id LIMIT 1) SELECT commit_id, chunk_index, idempotency_key FROM f WHERE commit_id = (SELECT commit_id FROM b) ORDER BY chunk_index, idempotency_key LIMIT 50 OFFSET 1""",
    "acl_visible_commits": "SELECT commit_id, author_principal, stored_at FROM commits WHERE author_principal LIKE 'prn-k%'",
    "acl_writers": "SELECT author_principal AS principal, CASE WHEN author_principal LIKE 'prn-k%' THEN NULL ELSE 'unauthorized' END AS error, count(*) AS writes FROM commits GROUP BY 1, 2",
    "next_pages": f"""WITH {_FIRST}, c AS (SELECT DISTINCT commit_id, created_at_ms FROM commits WHERE created_at_ms > 0), p AS (SELECT commit_id, row_number() OVER (ORDER BY created_at_ms, commit_id) AS r FROM c), b AS (SELECT count(DISTINCT idempotency_key) AS n FROM chunks GROUP BY commit_id)
SELECT CASE WHEN (SELECT count(*) FROM c) > 50 THEN (SELECT commit_id FROM p WHERE r = 50) END AS next_cursor, NULL::VARCHAR AS past_the_end, CASE WHEN (SELECT max(n) FROM b) > 1 THEN 1 END AS next_offset""",
    "commit_chunks": f"WITH {_FIRST} SELECT commit_id, count(*) AS chunks, sum(octet_length(payload))::BIGINT AS bytes FROM f WHERE commit_id IN (SELECT commit_id FROM commits) GROUP BY 1",
    "chunk_integrity": "SELECT bundle_id, chunk_index, created_at_ms, octet_length(payload) AS bytes FROM chunks WHERE NOT coalesce(sha256(payload) = chunk_hash, false)",
}
