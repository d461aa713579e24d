"""Queries on versioned records: conflict resolution, merge, rebase, last writer, changes of the concept table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import uuid_of
from lorekiln.functions.timing import is_epoch_ms, is_long_ms, is_safe_ms, skew_bound
from lorekiln.operators import merge as M
from lorekiln.operators import mutate as U
from lorekiln.plans.concept_queries import C, concepts
from lorekiln.plans.session import table

NOW, BASE, OBSERVED = 1_730_000_000_000, 1_715_000_000_000, 1_716_000_000_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas as records (id, ts, hash, source, seq, ...); an unreadable id is kept as it is written, no time is 0."""
    d = table(spark, sf_dir, "thoughtform_deltas")
    return d.select(F.coalesce(uuid_of(F.col("id")), "id").alias("id"), F.coalesce("updated_at", F.lit(0)).alias("ts"), F.col("content_hash").alias("hash"), "source", F.col("record_no").alias("seq"), "namespace", "version", "raw_text", F.col("tags").alias("tag_list"))


def sides(spark, sf_dir):
    r = records(spark, sf_dir)
    local = F.coalesce(F.col("source") == "user_input", F.lit(False))
    return r.filter(local), r.filter(~local)


def latest(spark, sf_dir):
    return M.last_by_id(records(spark, sf_dir), "seq")


def _aligned(**options):
    def query(spark, sf_dir):
        got = M.align(*sides(spark, sf_dir), **options)
        return got.select("id", "outcome", "reason", F.col("winner.ts").alias("ts"), F.col("winner.hash").alias("hash"), F.col("winner.source").alias("source"))

    return query


def merge_counts(spark, sf_dir):
    return M.merge_counts(*sides(spark, sf_dir))


def lww_dedupe(spark, sf_dir):
    return M.last_writer(records(spark, sf_dir)).select("id", "ts", "hash", "seq")


def canonical_sort(spark, sf_dir):
    return M.canonical_position(records(spark, sf_dir).select("ts", "id", "hash"))


def rebase_delta(spark, sf_dir):
    return M.remote_delta(sides(spark, sf_dir)[1], BASE, OBSERVED).select("id", "ts", "hash", "seq")


def rebase_merged(spark, sf_dir):
    return M.rebase(*sides(spark, sf_dir), BASE, OBSERVED)[0]


def rebase_conflicts(spark, sf_dir):
    return M.rebase(*sides(spark, sf_dir), BASE, OBSERVED, prefer="onchain")[1].select("id", "outcome", "reason")


def rebase_state(spark, sf_dir):
    return M.rebase(*sides(spark, sf_dir), BASE, OBSERVED)[2]


def delta_window_bounds(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.agg(F.max("ts").alias("a")).join(b.agg(F.max("ts").alias("b"))).select(skew_bound(F.col("a"), F.col("b")).alias("bound"), F.greatest("a", "b").alias("top"))


def timestamp_guards(spark, sf_dir):
    t = F.col("updated_at")
    return table(spark, sf_dir, "thoughtform_deltas").select("record_no", is_epoch_ms(t).alias("epoch"), is_safe_ms(t).alias("safe"), is_long_ms(t).alias("long"))


def _saved(spark, sf_dir):
    ch = latest(spark, sf_dir).select("id", "namespace", "tag_list", F.col("raw_text").alias("markdown"), F.when(F.col("version") > 3, F.col("version") - 1).cast("int").alias("expected_version"))
    return U.save(concepts(spark, sf_dir), ch, NOW)


def save_merge_upsert(spark, sf_dir):
    new = _saved(spark, sf_dir)[0]
    return new.select("id", "namespace", "version", "created_at", "updated_at", F.array_join(F.array_sort("tag_list"), "|").alias("tags"), F.sha2("markdown", 256).alias("markdown_hash"))


def save_occ_conflicts(spark, sf_dir):
    return _saved(spark, sf_dir)[1]


def batch_fold_versions(spark, sf_dir):
    ch = records(spark, sf_dir).select("id", "namespace", "tag_list", F.col("raw_text").alias("markdown"), "seq")
    return U.save_batch(concepts(spark, sf_dir), ch, NOW).select("id", "namespace", "version", F.array_join(F.array_sort("tag_list"), "|").alias("tags"), F.sha2("markdown", 256).alias("markdown_hash"))


def _upsert(policy):
    def query(spark, sf_dir):
        inc = latest(spark, sf_dir).withColumn("entity_types", F.array(F.lit("PERSON"), F.lit("CONCEPT")))
        got = U.upsert(concepts(spark, sf_dir), inc, policy)
        return got.select("id", "action", F.array_join(F.array_sort("tag_list"), "|").alias("tags"), F.sha2("markdown", 256).alias("markdown_hash"), "updated_at")

    return query


def upsert_counters(spark, sf_dir):
    out = None
    for policy in ("local_first", "strict_newer", "pull"):
        inc = latest(spark, sf_dir).withColumn("entity_types", F.array().cast("array<string>"))
        one = U.upsert_counts(U.upsert(concepts(spark, sf_dir), inc, policy)).select(F.lit(policy).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _gone(spark, sf_dir):
    return U.delete(concepts(spark, sf_dir), table(spark, sf_dir, "concept_vectors").select(F.col("concept_id").alias("id")))


def delete_anti(spark, sf_dir):
    return _gone(spark, sf_dir)[0].select("id", "namespace", "version")


def delete_missing(spark, sf_dir):
    return _gone(spark, sf_dir)[1]


QUERIES = {
    "merge_updated_at": _aligned(), "merge_prefer_local_skew": _aligned(prefer="local"), "merge_prefer_remote_skew": _aligned(prefer="onchain"),
    "merge_policy_local": _aligned(policy="preferLocal"), "merge_policy_remote": _aligned(policy="preferRemote"),
    "upsert_local_first": _upsert("local_first"), "upsert_strict_newer": _upsert("strict_newer"), "upsert_pull": _upsert("pull"),
} | {n: globals()[n] for n in "merge_counts lww_dedupe canonical_sort rebase_delta rebase_merged rebase_conflicts rebase_state delta_window_bounds timestamp_guards save_merge_upsert save_occ_conflicts batch_fold_versions upsert_counters delete_anti delete_missing".split()}

R = r"""d0 AS (SELECT *, regexp_replace(lower(regexp_replace(id, '[\s{}()-]+', '', 'g')), '^urn:uuid:', '') AS h FROM thoughtform_deltas),
r AS (SELECT CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) ELSE id END AS id,
  coalesce(updated_at, 0) AS ts, content_hash AS hash, source, record_no AS seq, namespace, version, raw_text, tags AS tag_list FROM d0)"""
SIDES = R + """, l AS (SELECT DISTINCT ON (id) * FROM r WHERE source = 'user_input' ORDER BY id, seq DESC), m AS (SELECT DISTINCT ON (id) * FROM r WHERE source IS DISTINCT FROM 'user_input' {delta} ORDER BY id, seq DESC)"""
_DELTA = f"AND ts > greatest(0, least({BASE}, {OBSERVED}) - 300000)"


def _merge_sql(early: str = "", delta: str = "") -> str:
    """Ladder of outcomes; ``early``: what comes before times are compared."""
    ladder = f"""CASE WHEN m.id IS NULL THEN 'local-only|' WHEN l.id IS NULL THEN 'remote-only|' WHEN l.hash IS NOT DISTINCT FROM m.hash THEN 'no-conflict|identical-content-hash' {early}
  WHEN l.ts <> m.ts THEN CASE WHEN l.ts > m.ts THEN 'local' ELSE 'remote' END || '|updatedAt (local=' || l.ts || ', remote=' || m.ts || ')'
  WHEN l.hash <> m.hash THEN CASE WHEN l.hash > m.hash THEN 'local' ELSE 'remote' END || '|contentHash-tiebreak'
  WHEN coalesce(l.source, '') <> coalesce(m.source, '') THEN CASE WHEN coalesce(l.source, '') > coalesce(m.source, '') THEN 'local' ELSE 'remote' END || '|source-tiebreak' ELSE 'local|id-tiebreak' END"""
    return f"""WITH {SIDES.replace('{delta}', delta)}, j AS (SELECT coalesce(l.id, m.id) AS id, l.ts AS lt, l.hash AS lh, l.source AS ls, m.ts AS mt, m.hash AS mh, m.source AS ms, {ladder} AS o FROM l FULL JOIN m ON l.id = m.id),
p AS (SELECT *, split_part(o, '|', 1) AS outcome, nullif(split_part(o, '|', 2), '') AS reason FROM j), w AS (SELECT *, outcome IN ('remote', 'remote-only') OR (outcome = 'no-conflict' AND mt > lt) AS theirs FROM p),
a AS (SELECT id, outcome, reason, CASE WHEN theirs THEN mt ELSE lt END AS ts, CASE WHEN theirs THEN mh ELSE lh END AS hash, CASE WHEN theirs THEN ms ELSE ls END AS source FROM w) """


_ALL = "SELECT id, outcome, reason, ts, hash, source FROM a"
_SKEW = "WHEN abs(l.ts - m.ts) <= 300000 THEN '{o}|prefer-{p}-within-skew (delta=' || abs(l.ts - m.ts) || 'ms)'"
_LATEST = f"WITH {C}, {R}, n AS (SELECT DISTINCT ON (id) * FROM r ORDER BY id, seq DESC)"
_TAGS = "array_to_string(list_sort(list_distinct({})), '|')"
_SAVE = _LATEST + """, x AS (SELECT *, CASE WHEN version > 3 THEN version - 1 END AS expected FROM n),
j AS (SELECT coalesce(c.id, x.id) AS id, c.id IS NULL AS fresh, x.id IS NOT NULL AND x.expected IS NOT NULL AND x.expected <> coalesce(c.version, 0) AS wrong, x.id IS NOT NULL AS changed, coalesce(c.version, 0) AS current,
  c.namespace AS ns, x.namespace AS xns, c.created_at, c.updated_at, c.tag_list AS t, x.tag_list AS xt, c.markdown AS md, x.raw_text AS xmd FROM c FULL JOIN x ON c.id = x.id)"""


def _upsert_sql(skip: str, tags: str, md: str) -> str:
    return f"""{_LATEST}, j AS (SELECT n.id, n.ts, c.updated_at AS o, c.tag_list AS ot, n.tag_list AS nt, c.markdown AS om, n.raw_text AS nm,
  CASE WHEN c.updated_at IS NULL THEN 'inserted' WHEN {skip} THEN 'skipped' ELSE 'updated' END AS action FROM n LEFT JOIN c ON c.id = n.id)
SELECT id, action, array_to_string(list_sort(CASE WHEN action = 'skipped' THEN coalesce(ot, []) ELSE {tags} END), '|') AS tags, sha256(CASE WHEN action = 'skipped' THEN om ELSE {md} END) AS markdown_hash, CASE WHEN action = 'skipped' THEN o ELSE ts END AS updated_at FROM j"""


_SKIPS = {"local_first": "c.updated_at > n.ts", "strict_newer": "NOT (n.ts > c.updated_at)", "pull": "c.updated_at >= n.ts"}
ORACLES = {
    "merge_updated_at": _merge_sql() + _ALL,
    "merge_prefer_local_skew": _merge_sql(_SKEW.format(o="local", p="local")) + _ALL,
    "merge_prefer_remote_skew": _merge_sql(_SKEW.format(o="remote", p="onchain")) + _ALL,
    "merge_policy_local": _merge_sql("WHEN true THEN 'local|policy-preferLocal'") + _ALL,
    "merge_policy_remote": _merge_sql("WHEN true THEN 'remote|policy-preferRemote'") + _ALL,
    "merge_counts": _merge_sql() + """SELECT (SELECT count(*) FROM r WHERE source = 'user_input' AND id NOT IN (SELECT id FROM m)) AS local_only, (SELECT count(*) FROM r WHERE source IS DISTINCT FROM 'user_input' AND id NOT IN (SELECT id FROM l)) AS remote_only,
count(*) FILTER (outcome IN ('local', 'remote')) AS conflicts, count(*) AS merged FROM a""",
    "lww_dedupe": f"WITH {R} SELECT DISTINCT ON (id) id, ts, hash, seq FROM r ORDER BY id, ts DESC, hash DESC, seq",
    "canonical_sort": f"WITH {R} SELECT ts, id, hash, row_number() OVER (ORDER BY ts, id, hash NULLS FIRST) AS position FROM r",
    "rebase_delta": f"WITH {R} SELECT id, ts, hash, seq FROM r WHERE source IS DISTINCT FROM 'user_input' {_DELTA}",
    "rebase_merged": _merge_sql(delta=_DELTA) + "SELECT id, ts, hash, source FROM a",
    "rebase_conflicts": _merge_sql(_SKEW.format(o="remote", p="onchain"), _DELTA) + "SELECT id, outcome, reason FROM a WHERE outcome IN ('local', 'remote', 'no-conflict')",
    "rebase_state": _merge_sql(delta=_DELTA) + f"SELECT greatest(max(ts), 0) AS local_base, (SELECT greatest(max(ts), {OBSERVED}) FROM r WHERE source IS DISTINCT FROM 'user_input') AS observed_remote_max, (SELECT count(*) FROM r WHERE source IS DISTINCT FROM 'user_input' {_DELTA}) AS delta_rows FROM a",
    "delta_window_bounds": f"WITH {R}, t AS (SELECT max(ts) FILTER (source = 'user_input') AS a, max(ts) FILTER (source IS DISTINCT FROM 'user_input') AS b FROM r) SELECT greatest(0, least(a, b) - 300000) AS bound, greatest(a, b) AS top FROM t",
    "timestamp_guards": "SELECT record_no, updated_at IS NOT NULL AND updated_at >= 0 AS epoch, updated_at IS NOT NULL AND updated_at BETWEEN 0 AND 9007199254740991 AS safe, updated_at IS NOT NULL AND updated_at >= 0 AS long FROM thoughtform_deltas",
    "save_merge_upsert": _SAVE + f""" SELECT id, CASE WHEN fresh THEN coalesce(xns, 'default') ELSE ns END AS namespace, CASE WHEN changed AND NOT wrong THEN current + 1 ELSE current END::INT AS version, CASE WHEN fresh THEN {NOW} ELSE created_at END AS created_at,
CASE WHEN changed AND NOT wrong THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN changed AND NOT wrong THEN {_TAGS.format('list_concat(coalesce(t, []), coalesce(xt, []))')} ELSE array_to_string(list_sort(t), '|') END AS tags,
sha256(CASE WHEN changed AND NOT wrong THEN coalesce(xmd, md) ELSE md END) AS markdown_hash FROM j WHERE NOT fresh OR NOT wrong""",
    "save_occ_conflicts": _SAVE + " SELECT id, current AS current_version FROM j WHERE wrong",
    "batch_fold_versions": f"""WITH {C}, {R}, f AS (SELECT id, count(*) AS n, arg_max(raw_text, seq) AS md, arg_min(coalesce(namespace, 'default'), seq) AS ns, list_distinct(flatten(list(coalesce(tag_list, [])))) AS tags FROM r GROUP BY id)
SELECT coalesce(c.id, f.id) AS id, CASE WHEN c.id IS NULL THEN f.ns ELSE c.namespace END AS namespace, (coalesce(c.version, 0) + coalesce(n, 0))::INT AS version,
CASE WHEN f.id IS NULL THEN array_to_string(list_sort(c.tag_list), '|') ELSE {_TAGS.format('list_concat(coalesce(c.tag_list, []), coalesce(f.tags, []))')} END AS tags, sha256(coalesce(f.md, c.markdown)) AS markdown_hash FROM c FULL JOIN f ON c.id = f.id""",
    "upsert_local_first": _upsert_sql(_SKIPS["local_first"], "list_distinct(list_concat(coalesce(ot, []), ['PERSON', 'CONCEPT']))", "coalesce(nm, om)"),
    "upsert_strict_newer": _upsert_sql(_SKIPS["strict_newer"], "coalesce(nt, [])", "om"),
    "upsert_pull": _upsert_sql(_SKIPS["pull"], "coalesce(ot, [])", "coalesce(nm, om)"),
    "upsert_counters": " UNION ALL ".join(f"""(WITH u AS ({_upsert_sql(s, '[]', 'om')}) SELECT '{p}' AS policy, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped, count(*) AS total FROM u)""" for p, s in _SKIPS.items()),
    "delete_anti": f"WITH {C} SELECT id, namespace, version FROM c WHERE id NOT IN (SELECT concept_id FROM concept_vectors WHERE concept_id IS NOT NULL)",
    "delete_missing": f"WITH {C} SELECT DISTINCT concept_id AS id FROM concept_vectors WHERE concept_id NOT IN (SELECT id FROM c)",
}
