"""Queries over the concept table: lookup, listing, statistics, search, the vector index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import tag_like, union_tags
from lorekiln.functions.vectors import cosine, decode_f32, encode_f32, is_usable, l2, sine_embedder
from lorekiln.operators import catalog
from lorekiln.operators.search import coarse_knn, index_from, knn, rebuild_index, search
from lorekiln.plans.session import table

DIM, SINCE = 64, 1_710_000_000_000


def concepts(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The concept table; a filter goes to the scan, before repeated rows are dropped, which are equal in every column."""
    raw = table(spark, sf_dir, "concepts")
    return catalog.load_concepts(raw if where is None else raw.filter(where))


def headers(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    raw = table(spark, sf_dir, "concepts")
    return catalog.headers(raw if where is None else raw.filter(where))


def searchable(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    usable = is_usable(F.col("embedding"), DIM)
    return concepts(spark, sf_dir, usable if where is None else usable & where)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), "embedding")


def adapter_tag() -> Column:
    """A filter for the scan that every JSON array with the tag "adapter" passes, also one that spells letters as escapes."""
    return F.col("tags").contains("adapter") | F.col("tags").contains("\\u")


def point_lookup(spark, sf_dir):
    raw = table(spark, sf_dir, "concepts")
    first = raw.agg(F.min("id")).first()[0]  # one value, which goes to the scan as a pushed filter
    return catalog.lookup(raw.filter(F.col("id") == first), raw.sparkSession.createDataFrame([(first,)], "id string")).distinct()


def multi_lookup(spark, sf_dir):
    return catalog.lookup(table(spark, sf_dir, "concepts"), table(spark, sf_dir, "cluster_probes").select(F.col("id_a").alias("id"))).distinct()


def read_representations(spark, sf_dir):
    doc = catalog.represent(concepts(spark, sf_dir), ("markdown", "thoughtform"))
    return doc.select("id", F.get_json_object("document", "$.markdown").alias("markdown"), F.sha2(F.get_json_object("document", "$.thoughtform"), 256).alias("thoughtform_hash"))


def list_page(spark, sf_dir):
    return catalog.list_page(headers(spark, sf_dir, F.col("namespace") == "default"))


def list_page_two(spark, sf_dir):
    return catalog.list_page(headers(spark, sf_dir), namespace=None, limit=20, offset=20)


def list_tags_like(spark, sf_dir):
    return catalog.filter_concepts(concepts(spark, sf_dir, tag_like(F.col("tags"), "Adapter")), None, ("Adapter",), "like").select("id", "namespace", "tags")


def list_tags_exact(spark, sf_dir):
    return catalog.filter_concepts(concepts(spark, sf_dir, adapter_tag()), None, ("adapter",)).select("id", "namespace", F.array_join("tag_list", "|").alias("tag_list"))


def list_flags(spark, sf_dir):
    return headers(spark, sf_dir).select("id", *catalog.PRESENCE)


def list_total(spark, sf_dir):
    return headers(spark, sf_dir).groupBy("namespace").agg(F.count(F.lit(1)).alias("total"))


def stats_all(spark, sf_dir):
    return catalog.stats(headers(spark, sf_dir), table(spark, sf_dir, "concept_vectors"))


def stats_by_namespace(spark, sf_dir):
    return catalog.stats(headers(spark, sf_dir), table(spark, sf_dir, "concept_vectors"), True)


def vector_semi_count(spark, sf_dir):
    own = table(spark, sf_dir, "concepts").filter(F.col("namespace") == "default").select(F.col("id").alias("concept_id"))
    return table(spark, sf_dir, "concept_vectors").join(own, "concept_id", "left_semi").agg(F.count(F.lit(1)).alias("vectors"))


def delta_since(spark, sf_dir):
    return catalog.delta_since(concepts(spark, sf_dir, (F.col("updated_at") > SINCE) & F.col("thoughtform").isNotNull()), SINCE).select("id", "namespace", "version", "updated_at")


def kv_latest(spark, sf_dir):
    return catalog.kv_latest(table(spark, sf_dir, "events"), "user_id", "props", "ts", "event_id")


def search_cross_ns(spark, sf_dir):
    return search(searchable(spark, sf_dir), probes(spark, sf_dir), namespace=None).select("query", "id", "distance", "namespace", "has_md", "has_tf", "rank")


def search_ns_postfilter(spark, sf_dir):
    return search(searchable(spark, sf_dir), probes(spark, sf_dir)).select("query", "id", "distance", "rank")


def search_ns_prefilter(spark, sf_dir):
    return search(searchable(spark, sf_dir, F.col("namespace") == "default"), probes(spark, sf_dir), prefilter=True).select("query", "id", "distance", "rank")


def search_tags(spark, sf_dir):
    return search(searchable(spark, sf_dir, adapter_tag()), probes(spark, sf_dir), namespace=None, tags=("adapter",), prefilter=True).select("query", "id", "distance", "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def knn_l2(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), probes(spark, sf_dir), 10)


def knn_inner_product(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), probes(spark, sf_dir), 10, "ip")


def knn_cosine(spark, sf_dir):
    return knn(_vectors(spark, sf_dir), probes(spark, sf_dir), 10, "cosine")


def knn_coarse(spark, sf_dir):
    """Approximate neighbours measured against exact ones: how many queries, and whether nine tenths of the true ten are found."""
    v, q = _vectors(spark, sf_dir), probes(spark, sf_dir)
    got, true = coarse_knn(v, q, 10).select("query", "id"), knn(v, q, 10).select("query", "id", F.lit(1).alias("hit"))
    both = true.join(got.withColumn("found", F.lit(1)), ["query", "id"], "left")
    return both.agg(F.countDistinct("query").alias("queries"), (F.count("found") >= 0.9 * F.count("hit")).alias("recall_of_nine_tenths"))


def knn_neighbours_top5(spark, sf_dir):
    """For every vector whose id is divisible by 20 its five neighbours besides itself."""
    hits = knn(_vectors(spark, sf_dir), probes(spark, sf_dir), 6).filter(F.col("query") != F.col("id"))
    return hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("n")).select("query", F.array_join(F.transform(F.slice("n", 1, 5), lambda x: x["id"].cast("string")), ",").alias("neighbours"))


def vector_zero_probe(spark, sf_dir):
    zero = spark.range(1).select(F.lit(0).cast("long").alias("query"), F.array_repeat(F.lit(0.0), DIM).alias("embedding"))
    return knn(_vectors(spark, sf_dir), zero, 1)


def f32_roundtrip(spark, sf_dir):
    """Vectors as packed bytes and back."""
    v = _vectors(spark, sf_dir).withColumn("b", encode_f32(F.col("embedding")))
    return v.select("id", F.octet_length("b").alias("bytes"), decode_f32(F.col("b")).eqNullSafe(F.col("embedding").cast("array<float>")).alias("same"), F.round(F.aggregate(decode_f32(F.col("b")), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def vector_drift(spark, sf_dir):
    """How far the index lags behind: distance and cosine of each indexed vector and the stored one."""
    own = searchable(spark, sf_dir).select(F.col("id").alias("concept_id"), "embedding")
    idx = table(spark, sf_dir, "concept_vectors").groupBy("concept_id").agg(F.max_by("embedding", "indexed_at").alias("indexed")).filter(is_usable(F.col("indexed"), DIM))
    both = idx.join(own, "concept_id")
    return both.select("concept_id", F.round(l2(F.col("indexed"), F.col("embedding")), 5).alias("distance"), F.round(cosine(F.col("indexed"), F.col("embedding")), 5).alias("cosine"))


def vector_index_replace(spark, sf_dir):
    old = table(spark, sf_dir, "concept_vectors").groupBy(F.col("concept_id").alias("id")).agg(F.max_by("embedding", "indexed_at").alias("embedding"))
    new = index_from(searchable(spark, sf_dir))
    rebuilt = rebuild_index(old.withColumn("origin", F.lit("index")), new.withColumn("origin", F.lit("concept")), "upsert")
    return rebuilt.select("id", "origin", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def tags_union(spark, sf_dir):
    t = table(spark, sf_dir, "thoughtform_deltas").select(F.lower("id").alias("id"), "record_no", "tags").groupBy("id").agg(F.max_by("tags", "record_no").alias("more"))
    both = concepts(spark, sf_dir).join(t, "id")
    return both.select("id", F.array_join(F.array_sort(union_tags(F.col("tag_list"), F.col("more"))), "|").alias("tags"))


def mock_embed_search(spark, sf_dir):
    """Documents embedded by the sine stand-in, each with the closest stored vector."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & (F.col("doc_id") % 20 == 0))
    q = d.select(F.col("doc_id").alias("query"), sine_embedder(DIM)(F.col("text")).alias("embedding"))
    return knn(_vectors(spark, sf_dir), q, 1)


def missing_embeddings(spark, sf_dir):
    """Concepts that an automatic embedding run would take: markdown but no vector."""
    c = concepts(spark, sf_dir, (F.trim("markdown") != "") & F.col("embedding").isNull())
    return c.select("id", F.length("markdown").alias("characters"))


_NAMES = """point_lookup multi_lookup read_representations list_page list_page_two list_tags_like list_tags_exact list_flags list_total stats_all stats_by_namespace vector_semi_count
delta_since kv_latest search_cross_ns search_ns_postfilter search_ns_prefilter search_tags knn_l2 knn_inner_product knn_cosine knn_coarse knn_neighbours_top5 vector_zero_probe f32_roundtrip vector_drift
vector_index_replace tags_union mock_embed_search missing_embeddings""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

C = """c AS (SELECT *, CASE WHEN trim(tags) LIKE '[%' THEN TRY_CAST(TRY_CAST(tags AS JSON) AS VARCHAR[]) END AS tag_list FROM (SELECT DISTINCT ON (id) * FROM concepts))"""
_FLAGS = "(markdown IS NOT NULL)::INT AS has_md, (thoughtform IS NOT NULL)::INT AS has_tf, (embedding IS NOT NULL)::INT AS has_vec"
_PAGE = f"WITH {C} SELECT id, namespace, version, updated_at, {_FLAGS}, count(*) OVER () AS total FROM c "
S = C + ", s AS (SELECT * FROM c WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64), q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0)"
_DIST = "round(list_distance(s.embedding::DOUBLE[], q.qv::DOUBLE[]), 6)"


def _search(prefilter: str, k: int, post: str, cols: str) -> str:
    return f"""WITH {S}, d AS (SELECT query, s.*, {_DIST} AS distance FROM s, q WHERE {prefilter}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d) WHERE r <= {k}),
kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INT AS rank FROM near WHERE {post}) SELECT {cols} FROM kept WHERE rank <= 10"""


def _knn(score: str, order: str, k: int = 10) -> str:
    return f"""SELECT query, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance {order}, id)::INT AS rank
FROM (SELECT q.vec_id AS query, e.vec_id AS id, round({score}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""


_PLAIN = "query, id, distance, rank"
ORACLES = {
    "point_lookup": f"WITH {C} SELECT id, namespace, version, {_FLAGS} FROM c WHERE id = (SELECT min(id) FROM c)",
    "multi_lookup": f"WITH {C} SELECT id, namespace, version, {_FLAGS} FROM c WHERE id IN (SELECT id_a FROM cluster_probes)",
    "read_representations": f"WITH {C} SELECT id, markdown, sha256(thoughtform) AS thoughtform_hash FROM c",
    "list_page": _PAGE + "WHERE namespace = 'default' ORDER BY updated_at DESC, id LIMIT 50",
    "list_page_two": _PAGE + "ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20",
    "list_tags_like": f"""WITH {C} SELECT id, namespace, tags FROM c WHERE tags ILIKE '%"adapter"%'""",
    "list_tags_exact": f"WITH {C} SELECT id, namespace, array_to_string(tag_list, '|') AS tag_list FROM c WHERE list_contains(tag_list, 'adapter')",
    "list_flags": f"WITH {C} SELECT id, {_FLAGS} FROM c",
    "list_total": f"WITH {C} SELECT namespace, count(*) AS total FROM c GROUP BY namespace",
    "stats_all": f"WITH {C} SELECT count(*) AS concepts, count(markdown) AS markdown, count(thoughtform) AS thoughtform, count(embedding) AS embedding, (SELECT count(*) FROM concept_vectors) AS vectors FROM c",
    "stats_by_namespace": f"""WITH {C}, v AS (SELECT namespace AS ns, count(*) AS vectors FROM concept_vectors JOIN c ON concept_id = id GROUP BY 1)
SELECT namespace, count(*) AS concepts, count(markdown) AS markdown, count(thoughtform) AS thoughtform, count(embedding) AS embedding, coalesce(any_value(vectors), 0) AS vectors FROM c LEFT JOIN v ON namespace IS NOT DISTINCT FROM ns GROUP BY namespace""",
    "vector_semi_count": f"WITH {C} SELECT count(*) AS vectors FROM concept_vectors WHERE concept_id IN (SELECT id FROM c WHERE namespace = 'default')",
    "delta_since": f"WITH {C} SELECT id, namespace, version, updated_at FROM c WHERE updated_at > {SINCE} AND thoughtform IS NOT NULL",
    "kv_latest": "SELECT user_id, arg_max(props, {'t': ts, 'e': event_id}) AS props FROM events GROUP BY user_id",
    "search_cross_ns": _search("true", 10, "true", "query, id, distance, namespace, (markdown IS NOT NULL)::INT AS has_md, (thoughtform IS NOT NULL)::INT AS has_tf, rank"),
    "search_ns_postfilter": _search("true", 30, "namespace = 'default'", _PLAIN),
    "search_ns_prefilter": _search("namespace = 'default'", 10, "true", _PLAIN),
    "search_tags": _search("list_contains(tag_list, 'adapter')", 10, "true", _PLAIN),
    "knn_l2": _knn("list_distance", "ASC"),
    "knn_inner_product": _knn("list_inner_product", "DESC"),
    "knn_cosine": _knn("list_cosine_similarity", "DESC"),
    "knn_coarse": "SELECT count(*) AS queries, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0",
    "mock_embed_search": f"""WITH h AS (SELECT doc_id, list_sum(list_transform(string_split(text, ''), lambda x: unicode(x)))::DOUBLE AS h FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0),
s AS (SELECT doc_id, list_transform(range({DIM}), lambda i: sin(h + i) * 0.5) AS v FROM h), u AS (SELECT doc_id, list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v)))::FLOAT) AS e FROM s),
d AS (SELECT doc_id, vec_id, round(list_distance(e::DOUBLE[], embedding::DOUBLE[]), 6) AS distance FROM u, embeddings)
SELECT doc_id AS query, vec_id AS id, distance, 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, vec_id) AS r FROM d) WHERE r = 1""",
    "knn_neighbours_top5": f"SELECT query, string_agg(id::VARCHAR, ',' ORDER BY distance, id) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS n FROM ({_knn('list_distance', 'ASC', 6)}) WHERE query <> id) WHERE n <= 5 GROUP BY query",
    "vector_zero_probe": "SELECT 0::BIGINT AS query, vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS distance, 1 AS rank FROM embeddings ORDER BY distance, id LIMIT 1",
    "f32_roundtrip": "SELECT vec_id AS id, 4 * len(embedding) AS bytes, true AS same, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings",
    "vector_drift": f"""WITH {S}, i AS (SELECT concept_id, arg_max(embedding, indexed_at) AS indexed FROM concept_vectors GROUP BY 1)
SELECT concept_id, round(list_distance(indexed::DOUBLE[], embedding::DOUBLE[]), 5) AS distance,
CASE WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND list_inner_product(indexed::DOUBLE[], indexed::DOUBLE[]) > 0 THEN round(list_cosine_similarity(indexed::DOUBLE[], embedding::DOUBLE[]), 5) END AS cosine
FROM i JOIN s ON concept_id = id WHERE len(indexed) = 64 AND len(list_filter(indexed, lambda x: isfinite(x))) = 64""",
    "vector_index_replace": f"""WITH {S}, i AS (SELECT concept_id AS id, arg_max(embedding, indexed_at) AS embedding FROM concept_vectors GROUP BY 1)
SELECT id, origin, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM (SELECT id, 'concept' AS origin, embedding FROM s UNION ALL SELECT id, 'index', embedding FROM i WHERE id NOT IN (SELECT id FROM s))""",
    "tags_union": f"""WITH {C}, t AS (SELECT lower(id) AS id, arg_max_null(tags, record_no) AS more FROM thoughtform_deltas GROUP BY 1)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tag_list, []), coalesce(more, [])))), '|') AS tags FROM c JOIN t USING (id)""",
    "missing_embeddings": f"WITH {C} SELECT id, length(markdown) AS characters FROM c WHERE trim(markdown, ' ') <> '' AND embedding IS NULL",
}
