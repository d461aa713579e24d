"""Problem 1: one record per ThoughtForm id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.survivorship import PLACEHOLDERS, build_survivors, choose_bundles, uuid_key
from lorekiln.plans.session import table


def instant_ns(col: Column) -> Column:
    """Nanoseconds since 1970 of seconds, milli-, micro- or nanoseconds, told apart by size; null if not positive."""
    v = col.cast("long")
    return F.when(v <= 0, None).when(v < 10**11, v * 10**9).when(v < 10**14, v * 10**6).when(v < 10**17, v * 1000).otherwise(v)


_ORDER = lambda: [F.col("version"), instant_ns(F.col("updated_at"))]
SINGLE = {"record": (), "raw_text": ("raw_text",), "author": ("author",), "lang": ("lang",)}
#: A text and its language belong together, and so do an author and where the record came from; an author determines the source.
#: The best record itself is always there, so every id has a row.
BUNDLED = {"record": (), "text": ("raw_text", "lang"), "author": ("author",), "source": ("source",)}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "thoughtform_deltas")
    got = choose_bundles(rows, uuid_key(F.col("id")), F.col("record_no"), _ORDER(), SINGLE)
    return got.select(F.col("first_id").alias("first_no"), F.col("bundle").alias("field"), F.col("from_id").alias("from_no"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every id, also of ids with one record, with text and language from one record and the source its author implies."""
    rows = table(spark, sf_dir, "thoughtform_deltas")
    trust = 1 + F.least(F.coalesce(F.col("version"), F.lit(0)), F.lit(1000)) / 1000
    got = choose_bundles(rows, uuid_key(F.col("id")), F.col("record_no"), _ORDER(), BUNDLED, [(("author",), ("source",))], trust, least=1)
    return build_survivors(rows, got, "record_no", BUNDLED)


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors}

_LIST = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_FIELD = """SELECT first_no, '{f}' AS field, record_no AS from_no FROM (SELECT g, record_no, row_number() OVER (PARTITION BY g ORDER BY version DESC NULLS LAST, ns DESC NULLS LAST, record_no) AS r
  FROM k WHERE {cond}) JOIN big USING (g) WHERE r = 1"""
_KEYED = r"""
WITH s AS (SELECT *, regexp_replace(lower(regexp_replace(id, '[\s{}()\[\]"''<>-]+', '', 'g')), '^(urn:)?(uuid:|guid:)?(0x)?', '') AS g0 FROM thoughtform_deltas),
k AS (SELECT record_no, version, FIELDS, g0 AS g,
  CASE WHEN updated_at <= 0 THEN NULL WHEN updated_at < 100000000000 THEN updated_at * 1000000000 WHEN updated_at < 100000000000000 THEN updated_at * 1000000
       WHEN updated_at < 100000000000000000 THEN updated_at * 1000 ELSE updated_at END AS ns FROM s WHERE regexp_full_match(g0, '[0-9a-f]{32}')),
"""
_HELD = "CASE WHEN {f} IS NOT NULL AND lower(trim({f}, E' \\t\\n\\r')) NOT IN (" + _LIST + ") THEN {f} END AS {f}"
_BEST = "version DESC NULLS LAST, ns DESC NULLS LAST, record_no"
ORACLES = {
    "p1_found": _KEYED.replace("FIELDS", "raw_text, author, lang")
    + "big AS (SELECT g, min(record_no) AS first_no FROM k GROUP BY g HAVING count(*) >= 2)\n"
    + " UNION ALL ".join([_FIELD.format(f="record", cond="true")] + [_FIELD.format(f=f, cond=f"{f} IS NOT NULL AND lower(trim({f}, E' \\t\\n\\r')) NOT IN ({_LIST})") for f in ("raw_text", "author", "lang")]),
    # every choice of an author and a source, of each value its most trusted record, is listed; the best allowed one is taken
    "p1_survivors": _KEYED.replace("FIELDS", ", ".join(_HELD.format(f=f) for f in ("raw_text", "lang", "author", "source")))
    + f"""w AS (SELECT *, 1 + least(coalesce(version, 0), 1000) / 1000 AS w FROM k),
grp AS (SELECT g, min(record_no) AS first_id FROM k GROUP BY g),
txt AS (SELECT g, raw_text, lang FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (raw_text IS NOT NULL)::INT * 6 + (lang IS NOT NULL)::INT * 5 DESC, {_BEST}) AS i FROM w) WHERE i = 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, author ORDER BY w DESC, {_BEST}) AS i FROM w WHERE author IS NOT NULL) WHERE i = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, source ORDER BY w DESC, {_BEST}) AS i FROM w WHERE source IS NOT NULL) WHERE i = 1),
det AS (SELECT g, author, source AS must FROM (SELECT *, row_number() OVER (PARTITION BY g, author ORDER BY w DESC, {_BEST}) AS i FROM w WHERE author IS NOT NULL AND source IS NOT NULL) WHERE i = 1),
pick AS (
  SELECT a.g, a.author, c.source, a.w + c.w AS score, a.version AS va, a.ns AS na, a.record_no AS ra, c.version AS vc, c.ns AS nc, c.record_no AS rc FROM a LEFT JOIN det USING (g, author) JOIN c ON c.g = a.g AND (must IS NULL OR must = c.source)
  UNION ALL SELECT g, author, NULL, w, version, ns, record_no, NULL, NULL, NULL FROM a
  UNION ALL SELECT g, NULL, source, w, NULL, NULL, NULL, version, ns, record_no FROM c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, (ra IS NULL)::INT, va DESC NULLS LAST, na DESC NULLS LAST, ra, (rc IS NULL)::INT, vc DESC NULLS LAST, nc DESC NULLS LAST, rc) AS i FROM pick) WHERE i = 1)
SELECT g AS group_key, first_id, raw_text, lang, author, source FROM grp JOIN txt USING (g) LEFT JOIN best USING (g)""",
}
