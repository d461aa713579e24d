"""Queries on texts: entities, relations, graphs, conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.functions.text import text_or_entities
from lorekiln.operators import convert as V
from lorekiln.operators import extract as E
from lorekiln.operators.validate import UUID
from lorekiln.plans.concept_queries import DIM, C, S, adapter_tag, concepts, searchable
from lorekiln.plans.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _entities(spark, sf_dir, passes=(1, 2)):
    return E.find_entities(_docs(spark, sf_dir), "doc_id", "text", passes)


def entities_multicap(spark, sf_dir):
    return _entities(spark, sf_dir, (1,)).select("doc_id", "entity")


def entities_quoted(spark, sf_dir):
    return _entities(spark, sf_dir, (2,)).select("doc_id", "entity")


def entities_singlecap(spark, sf_dir):
    return _entities(spark, sf_dir, (3,)).select("doc_id", "entity")


def entity_types(spark, sf_dir):
    return _entities(spark, sf_dir, (1,)).groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("entities"))


def entity_ids(spark, sf_dir):
    return _entities(spark, sf_dir).select("doc_id", "entity_id", "entity", "confidence")


def entity_filter(spark, sf_dir):
    return E.keep_entities(_entities(spark, sf_dir), ("PERSON", "CONCEPT"), 0.7).select("doc_id", "entity_id", "type")


def entity_offsets(spark, sf_dir):
    """All three passes with offsets."""
    got = E.extract(_docs(spark, sf_dir), "doc_id", "text", infer=False)
    return got.select("doc_id", F.inline("extracted.entities"))


def _pairs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return E.sentence_pairs(d, "doc_id", "text", E.find_entities(d, "doc_id", "text", (1, 2)))


def sentence_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"))


def relation_predicates(spark, sf_dir):
    return E.relations(_docs(spark, sf_dir), "doc_id", "text", (1, 2))


def context_graph(spark, sf_dir):
    g = E.context_graph(_docs(spark, sf_dir), "doc_id", "text", (1, 2))
    return g.select("doc_id", "node", F.array_join("neighbours", ",").alias("neighbours"))


def extract_full(spark, sf_dir):
    """Entities of all passes and relations of every concept's markdown, in one pass."""
    c = concepts(spark, sf_dir)
    got = E.extract(c, "id", "markdown").select("id", "extracted.*")
    names = F.array_join(F.transform("entities", lambda e: F.concat(e["id"], F.lit(":"), e["type"], F.lit(":"), e["text"])), "|")
    return got.select("id", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"), F.sha2(names, 256).alias("entities_hash"))


def markdown_to_form(spark, sf_dir):
    """Structured forms made from markdown, read back; only of concepts whose id is a UUID, which forms must have."""
    c = concepts(spark, sf_dir, F.col("id").rlike(UUID))
    made = V.convert(c, "markdown", "thoughtform", now_ms=1_730_000_000_123)
    f = made.select("id", V.parse_form(F.col("thoughtform"))["live"].alias("f"))
    fits = F.forall("f.entities", lambda e: F.substring(F.col("f.rawText"), e["offset"]["start"] + 1, e["offset"]["end"] - e["offset"]["start"]) == e["text"])
    return f.select("id", F.sha2("f.rawText", 256).alias("text_hash"), "f.language", "f.metadata.source", "f.metadata.createdAt", F.size("f.entities").alias("entities"), F.size("f.relationships").alias("relationships"), fits.alias("offsets_fit"))


def form_shapes(spark, sf_dir):
    """The shape of each structured form."""
    c = concepts(spark, sf_dir).select("id", V.parse_form(F.col("thoughtform")).alias("f"))
    return c.select("id", "f.shape", F.coalesce("f.live.rawText", "f.sync.rawText").alias("raw_text"))


def forms_since(spark, sf_dir):
    """Readable structured forms of a namespace with a tag that changed after a time."""
    got = V.read_forms(concepts(spark, sf_dir, adapter_tag()), None, ("adapter",), 1_705_000_000_000)
    return got.select("id", "shape", "ts")


def tf_to_markdown(spark, sf_dir):
    return V.convert(concepts(spark, sf_dir, F.col("thoughtform").isNotNull()), "thoughtform", "markdown")


def tf_to_vector(spark, sf_dir):
    return V.convert(concepts(spark, sf_dir, F.col("thoughtform").isNotNull()), "thoughtform", "vector").select("id", F.size("embedding").alias("dimension"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


def vector_to_markdown(spark, sf_dir):
    """Concepts that have only a vector get a text made of their neighbours' texts."""
    c = searchable(spark, sf_dir)
    wanted = c.filter(F.col("markdown").isNull() & F.col("thoughtform").isNull()).select("id", "embedding")
    return V.neighbour_texts(c, wanted).select("id", F.size("texts").alias("neighbours"), F.sha2(V.reconstruct(F.col("texts")), 256).alias("markdown_hash"))


def markdown_to_vector(spark, sf_dir):
    got = V.convert(concepts(spark, sf_dir, F.col("markdown").isNotNull()), "markdown", "vector")
    return got.select("id", F.size("embedding").alias("dimension"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


def vector_to_form(spark, sf_dir):
    """Concepts that have only a vector get a structured form out of their neighbours' texts."""
    c = searchable(spark, sf_dir)
    wanted = c.filter(F.col("markdown").isNull() & F.col("thoughtform").isNull()).select("id", "embedding")
    texts = V.neighbour_texts(c, wanted).select("id", F.when(F.size("texts") > 0, F.array_join("texts", "\n\n")).otherwise(V.NO_CONTEXT).alias("text"))
    f = V.form_from_text(texts, "text", 0, check=False).select("id", V.parse_form(F.col("thoughtform"))["live"].alias("f"))
    return f.select("id", F.sha2("f.rawText", 256).alias("text_hash"), "f.metadata.source")


def embedding_text(spark, sf_dir):
    c = concepts(spark, sf_dir, F.col("thoughtform").isNotNull()).select("id", V.parse_form(F.col("thoughtform")).alias("f"))
    values = F.coalesce(F.col("f.live.entities.text"), F.col("f.sync.entities.value"))
    return c.select("id", text_or_entities(F.coalesce("f.live.rawText", "f.sync.rawText"), values, F.col("id")).alias("text"))


_NAMES = "entities_multicap entities_quoted entities_singlecap entity_types entity_ids entity_filter entity_offsets sentence_pairs relation_predicates context_graph extract_full markdown_to_form form_shapes forms_since tf_to_markdown tf_to_vector markdown_to_vector vector_to_markdown vector_to_form embedding_text".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_ORG, _LOC = (", ".join(f"'{w}'" for w in ws) for ws in (E.ORGANIZATION_WORDS, E.LOCATION_WORDS))
_CAP = E.PHRASE.replace(r"\s", r"[ \t\n\r\f]")
_ENT = f"""m AS (SELECT doc_id, 1 AS pass, regexp_extract_all(text, '\\b({_CAP})\\b', 1) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '{E.QUOTED}', 1) FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, pass, unnest(t) AS entity, generate_subscripts(t, 1) AS pos FROM m WHERE pass IN ({{passes}})),
o AS (SELECT DISTINCT ON (doc_id, lower(entity)) * FROM x ORDER BY doc_id, lower(entity), pass, pos),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, pos) - 1 AS n, regexp_split_to_array(entity, '[ \\t\\n\\r\\f]+') AS w FROM o),
h AS (SELECT *, list_filter(w, lambda v: v IN ({_ORG}, {_LOC}))[1] AS hint FROM e),
k AS (SELECT doc_id, n, 'ent_' || n AS entity_id, entity, CASE WHEN pass = 2 THEN 'CONCEPT' WHEN hint IN ({_ORG}) THEN 'ORGANIZATION' WHEN hint IS NOT NULL THEN 'LOCATION' WHEN len(w) BETWEEN 2 AND 3 THEN 'PERSON' ELSE 'ENTITY' END AS type,
  CASE WHEN pass = 1 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM h)"""


#: The third pass by words instead of looking back: the word before ends with a small letter or a mark, one white space before.
_ENT = _ENT.replace("x AS (SELECT doc_id", r"""w3 AS (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\x0B]') AS w FROM documents WHERE text IS NOT NULL),
m3 AS (SELECT doc_id, list_transform(list_filter(generate_series(2, len(w)), lambda i: regexp_matches(w[i - 1], '[a-z,.;:!?]$') AND regexp_matches(w[i], '^[A-Z][a-z]{2,}\b')), lambda i: regexp_extract(w[i], '^([A-Z][a-z]{2,})\b', 1)) AS t FROM w3),
x AS (SELECT doc_id""", 1).replace("FROM m WHERE pass IN ({passes}))", "FROM (SELECT * FROM m UNION ALL SELECT doc_id, 3, t FROM m3) WHERE pass IN ({passes}))")
_ENT = _ENT.replace("CASE WHEN pass = 2 THEN 'CONCEPT' WHEN", "CASE WHEN pass = 2 THEN 'CONCEPT' WHEN pass = 3 THEN 'ENTITY' WHEN").replace("ELSE 0.7::DOUBLE END AS confidence", "WHEN pass = 2 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS confidence")


def _ent(passes: str, select: str, source: str = "") -> str:
    return f"WITH {source}" + _ENT.replace("{passes}", passes) + " " + select


_MARKDOWN = f"{C}, documents AS (SELECT id AS doc_id, markdown AS text FROM c), "


_REL = f"""sn AS (SELECT doc_id, unnest(s) AS s0, generate_subscripts(s, 1) AS sentence_no FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda v: trim(v, ' ') <> '') AS s FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, sentence_no - 1 AS sentence_no, lower(s0) AS sentence FROM sn),
here AS (SELECT s.*, n, entity_id, lower(entity) AS key FROM s JOIN k USING (doc_id) WHERE contains(sentence, lower(entity))),
pr AS (SELECT a.doc_id, a.sentence_no, a.sentence, a.entity_id AS subject_id, a.key AS sk, b.entity_id AS object_id, b.key AS ok FROM here a JOIN here b ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND a.n < b.n),
ps AS (SELECT *, least(instr(sentence, sk) + length(sk), instr(sentence, ok) + length(ok)) AS st, greatest(instr(sentence, sk), instr(sentence, ok)) AS en FROM pr),
gp AS (SELECT *, CASE WHEN st < en THEN regexp_replace(substr(sentence, st, en - st), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') END AS gap FROM ps),
vb AS (SELECT *, CASE WHEN regexp_matches(gap, '{E.IS_A}') THEN 'is_a' ELSE coalesce({', '.join(f"(CASE WHEN regexp_extract(gap, '{p}', 1) NOT IN ('', {', '.join(repr(w) for w in E.NOT_VERBS)}) THEN regexp_extract(gap, '{p}', 1) END)" for p in E.VERB_PATTERNS)}) END AS predicate FROM gp),
rl AS (SELECT doc_id, sentence_no::INT AS sentence_no, subject_id, predicate, object_id, (CASE WHEN predicate = 'is_a' THEN 0.85 WHEN predicate LIKE '%ed' THEN 0.75 WHEN predicate LIKE '%s' THEN 0.7 ELSE 0.6 END)::DOUBLE AS confidence FROM vb WHERE predicate IS NOT NULL)"""
_FORM = C + """, f AS (SELECT id, thoughtform AS t, TRY_CAST(thoughtform AS JSON) AS j FROM c), g AS (SELECT id, t, j, CASE WHEN t IS NULL THEN NULL WHEN j IS NULL THEN 'unreadable' WHEN j->>'$.schemaVersion' IS NOT NULL THEN 'sync' ELSE 'live' END AS shape FROM f)"""
_MD = """p AS (SELECT id, shape, j->>'$.rawText' AS raw, coalesce(CAST(j->'$.entities' AS JSON[]), []) AS es, coalesce(CAST(j->'$.relationships' AS JSON[]), []) AS rs FROM g WHERE shape IN ('live', 'sync')),
q2 AS (SELECT id, raw, list_transform(es, lambda e: {'i': e->>'$.id', 't': coalesce(e->>'$.text', e->>'$.value'), 'k': e->>'$.type', 'c': (e->>'$.confidence')::DOUBLE}) AS es,
  list_transform(rs, lambda r: {'s': coalesce(r->>'$.subjectId', r->>'$.from'), 'p': coalesce(r->>'$.predicate', r->>'$.type'), 'o': coalesce(r->>'$.objectId', r->>'$.to')}) AS rs FROM p)"""
#: The UTF-16 units of a character, added up.
U16 = "CASE WHEN unicode(substr(markdown, i, 1)) < 65536 THEN unicode(substr(markdown, i, 1)) ELSE 55296 + (unicode(substr(markdown, i, 1)) - 65536) // 1024 + 56320 + (unicode(substr(markdown, i, 1)) - 65536) % 1024 END"
ORACLES = {
    "entities_multicap": _ent("1", "SELECT doc_id, entity FROM k"),
    "entities_quoted": _ent("2", "SELECT doc_id, entity FROM k"),
    "entities_singlecap": _ent("3", "SELECT doc_id, entity FROM k"),
    # where a match begins: the lengths of the pieces between the matches before it, and of those matches
    "entity_offsets": f"""WITH r AS (SELECT doc_id, 1 AS pass, 0 AS skip, regexp_extract_all(text, '\\b({_CAP})\\b', 0) AS f, regexp_extract_all(text, '\\b({_CAP})\\b', 1) AS t, regexp_split_to_array(text, '\\b({_CAP})\\b') AS gaps FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 2, 1, regexp_extract_all(text, '{E.QUOTED}', 0), regexp_extract_all(text, '{E.QUOTED}', 1), regexp_split_to_array(text, '{E.QUOTED}') FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, pass, t[i] AS entity, i AS pos, list_sum(list_transform(gaps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda v: length(v))), 0) + skip AS start FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM r)),
w3 AS (SELECT doc_id, regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]') AS w FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, 3 AS pass, regexp_extract(w[i], '^([A-Z][a-z]{{2,}})\\b', 1) AS entity, i AS pos, list_sum(list_transform(w[1:i - 1], lambda v: length(v) + 1)) AS start FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM w3) WHERE regexp_matches(w[i - 1], '[a-z,.;:!?]$') AND regexp_matches(w[i], '^[A-Z][a-z]{{2,}}\\b')),
o AS (SELECT DISTINCT ON (doc_id, lower(entity)) * FROM (SELECT * FROM y UNION ALL SELECT * FROM z) ORDER BY doc_id, lower(entity), pass, pos),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, pos) - 1 AS n, regexp_split_to_array(entity, '[ \\t\\n\\r\\f]+') AS ws FROM o), h AS (SELECT *, list_filter(ws, lambda v: v IN ({_ORG}, {_LOC}))[1] AS hint FROM e)
SELECT doc_id, 'ent_' || n AS id, entity AS text, CASE WHEN pass = 2 THEN 'CONCEPT' WHEN pass = 3 THEN 'ENTITY' WHEN hint IN ({_ORG}) THEN 'ORGANIZATION' WHEN hint IS NOT NULL THEN 'LOCATION' WHEN len(ws) BETWEEN 2 AND 3 THEN 'PERSON' ELSE 'ENTITY' END AS type,
CASE pass WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS confidence, start::INT AS start, (start + length(entity))::INT AS end FROM h""",
    "extract_full": _ent("1, 2, 3", "", _MARKDOWN).rstrip() + ", " + _REL + """, ek AS (SELECT doc_id, count(*) AS n, string_agg(entity_id || ':' || type || ':' || entity, '|' ORDER BY n) AS names FROM k GROUP BY 1), er AS (SELECT doc_id, count(*) AS n FROM rl GROUP BY 1)
SELECT d.doc_id AS id, coalesce(ek.n, 0)::INT AS entities, coalesce(er.n, 0)::INT AS relationships, sha256(coalesce(names, '')) AS entities_hash FROM documents d LEFT JOIN ek ON ek.doc_id = d.doc_id LEFT JOIN er ON er.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
    "markdown_to_form": _ent("1, 2, 3", "", _MARKDOWN).rstrip() + ", " + _REL + f""", ek AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), er AS (SELECT doc_id, count(*) AS n FROM rl GROUP BY 1)
SELECT d.doc_id AS id, sha256(text) AS text_hash, 'en' AS language, 'converted' AS source, '2024-10-27T03:33:20.123Z' AS "createdAt", coalesce(ek.n, 0)::INT AS entities, coalesce(er.n, 0)::INT AS relationships, true AS offsets_fit
FROM documents d LEFT JOIN ek ON ek.doc_id = d.doc_id LEFT JOIN er ON er.doc_id = d.doc_id WHERE d.text <> '' AND regexp_matches(d.doc_id, '{UUID}')""",
    "entity_types": _ent("1", "SELECT type, confidence, count(*) AS entities FROM k GROUP BY 1, 2"),
    "entity_ids": _ent("1, 2", "SELECT doc_id, entity_id, entity, confidence FROM k"),
    "entity_filter": _ent("1, 2", "SELECT doc_id, entity_id, type FROM k WHERE type IN ('PERSON', 'CONCEPT') AND confidence >= 0.7"),
    "sentence_pairs": _ent("1, 2", "").rstrip() + ", " + _REL + " SELECT doc_id, count(*) AS pairs FROM pr GROUP BY 1",
    "relation_predicates": _ent("1, 2", "").rstrip() + ", " + _REL + " SELECT * FROM rl",
    "context_graph": _ent("1, 2", "").rstrip() + ", " + _REL + """, nu AS (SELECT *, substr(subject_id, 5)::INT AS a, substr(object_id, 5)::INT AS b FROM rl),
bo AS (SELECT doc_id, subject_id AS node, object_id AS o, sentence_no, a, b FROM nu UNION ALL SELECT doc_id, object_id, subject_id, sentence_no, a, b FROM nu),
fi AS (SELECT DISTINCT ON (doc_id, node, o) * FROM bo ORDER BY doc_id, node, o, sentence_no, a, b)
SELECT doc_id, node, string_agg(o, ',' ORDER BY sentence_no, a, b) AS neighbours FROM fi GROUP BY 1, 2""",
    "form_shapes": f"WITH {_FORM} SELECT id, shape, CASE WHEN shape <> 'unreadable' THEN j->>'$.rawText' END AS raw_text FROM g",
    "forms_since": f"""WITH {_FORM}, t AS (SELECT g.id, shape, CASE WHEN shape = 'sync' THEN (j->>'$.metadata.updatedAtMs')::BIGINT ELSE epoch_ms(TRY_CAST(j->>'$.metadata.updatedAt' AS TIMESTAMP)) END AS ts
FROM g JOIN c USING (id) WHERE shape IN ('live', 'sync') AND list_contains(tag_list, 'adapter')) SELECT id, shape, ts FROM t WHERE ts > 1705000000000""",
    "tf_to_markdown": f"""WITH {_FORM}, {_MD} SELECT id, '# ' || substr(raw, 1, 80) || chr(10) || chr(10) || raw
|| CASE WHEN len(es) > 0 THEN chr(10) || chr(10) || '## Entities' || chr(10) || chr(10) || array_to_string(list_transform(es, lambda e: '- **' || e.t || '** (' || e.k || coalesce(', confidence: ' || printf('%.2f', e.c), '') || ')'), chr(10)) ELSE '' END
|| CASE WHEN len(rs) > 0 THEN chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10) || array_to_string(list_transform(rs, lambda r: '- ' || coalesce(list_filter(es, lambda e: e.i = r.s)[1].t, r.s) || ' **' || r.p || '** ' || coalesce(list_filter(es, lambda e: e.i = r.o)[1].t, r.o)), chr(10)) ELSE '' END AS markdown
FROM q2 WHERE raw IS NOT NULL""",
    "tf_to_vector": f"""WITH {_FORM}, r AS (SELECT id, list_sum(list_transform(string_split(j->>'$.rawText', ''), lambda x: unicode(x)))::DOUBLE AS h FROM g WHERE shape IN ('live', 'sync') AND j->>'$.rawText' <> '')
SELECT id, {DIM} AS dimension, round((sin(h) / sqrt(list_sum(list_transform(range({DIM}), lambda i: sin(h + i) * sin(h + i)))))::FLOAT::DOUBLE, 4) AS first FROM r""",
    "markdown_to_vector": f"""WITH {C}, r AS (SELECT id, list_sum(list_transform(generate_series(1, length(markdown)), lambda i: {U16}))::DOUBLE AS h FROM c WHERE trim(markdown, ' ') <> '')
SELECT id, {DIM} AS dimension, round((sin(h) / sqrt(list_sum(list_transform(range({DIM}), lambda i: sin(h + i) * sin(h + i)))))::FLOAT::DOUBLE, 4) AS first FROM r""",
    "vector_to_form": f"""WITH {S}, w AS (SELECT id AS query, embedding AS qv FROM s WHERE markdown IS NULL AND thoughtform IS NULL),
d AS (SELECT query, s.id, s.namespace, round(list_distance(s.embedding::DOUBLE[], qv::DOUBLE[]), 6) AS distance, coalesce(markdown, TRY_CAST(thoughtform AS JSON)->>'$.rawText') AS text FROM s, w),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d) WHERE r <= 15),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r2 FROM n WHERE namespace = 'default'),
t AS (SELECT query, list(text ORDER BY distance, id) AS texts FROM h WHERE r2 <= 5 AND query <> id AND text <> '' GROUP BY query)
SELECT w.query AS id, sha256(coalesce(array_to_string(texts, chr(10) || chr(10)), '{V.NO_CONTEXT}')) AS text_hash, 'converted' AS source FROM w LEFT JOIN t ON w.query = t.query""",
    "vector_to_markdown": f"""WITH {S}, w AS (SELECT id AS query, embedding AS qv FROM s WHERE markdown IS NULL AND thoughtform IS NULL),
d AS (SELECT query, s.id, s.namespace, round(list_distance(s.embedding::DOUBLE[], qv::DOUBLE[]), 6) AS distance, coalesce(markdown, TRY_CAST(thoughtform AS JSON)->>'$.rawText') AS text FROM s, w),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d) WHERE r <= 15),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r2 FROM n WHERE namespace = 'default'),
t AS (SELECT query, list(text ORDER BY distance, id) AS texts FROM h WHERE r2 <= 5 AND query <> id AND text <> '' GROUP BY query)
SELECT w.query AS id, coalesce(len(texts), 0)::INT AS neighbours, sha256(CASE WHEN texts IS NULL THEN '# Reconstructed Concept' || chr(10) || chr(10) || 'No neighboring concepts available for reconstruction.'
ELSE '# Reconstructed Concept' || chr(10) || chr(10) || '*Reconstructed from nearest-neighbor context.*' || chr(10) || chr(10) || CASE WHEN len(texts) = 1 THEN texts[1] ELSE array_to_string(list_transform(texts, lambda x, i: '## Related Context ' || i || chr(10) || chr(10) || x), chr(10) || chr(10)) END END) AS markdown_hash
FROM w LEFT JOIN t ON w.query = t.query""",
    "embedding_text": f"""WITH {_FORM}, p AS (SELECT id, j->>'$.rawText' AS raw, coalesce(CAST(j->'$.entities' AS JSON[]), []) AS es FROM g WHERE t IS NOT NULL)
SELECT id, coalesce(nullif(array_to_string(list_filter(list_concat([raw], list_transform(es, lambda e: coalesce(e->>'$.text', e->>'$.value'))), lambda v: v IS NOT NULL AND v <> ''), ' '), ''), id) AS text FROM p""",
}
