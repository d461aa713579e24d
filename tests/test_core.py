import gzip
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorekiln import config
from lorekiln.api import COMMITS, CONCEPTS, Memory
from lorekiln.functions import hashing as H
from lorekiln.functions import timing as T
from lorekiln.functions.masking import classify, redact
from lorekiln.functions.text import has_all, parse_tags, tag_like, union_tags, uuid_of
from lorekiln.functions.vectors import cosine, decode_f32, encode_f32, l2, sine_embedder
from lorekiln.operators import bundle, extract, merge, mutate, search, store, validate
from lorekiln.operators.convert import convert, reconstruct
from lorekiln.plans import stages
from lorekiln.protocols import Catalog, ChunkService, IndexService, TableService, download, upload
from lorekiln.sources import records as io
from lorekiln.streaming import changes


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tags_and_ids(spark):
    df = spark.createDataFrame([('["a","b"]',), ("",), (None,), ("a, b",), ('{"a":1}',), ('["A%"]',)], "t string")
    got = [r.x for r in df.select(parse_tags(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b"], None, None, None, None, ["A%"]]
    assert [r[0] for r in df.select(tag_like(F.col("t"), "A")).collect()] == [True, False, False, False, True, False]
    assert [r[0] for r in df.select(has_all(parse_tags(F.col("t")), ["a"])).collect()] == [True, False, False, False, False, False]
    assert one(spark, union_tags(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))))[0] == ["b", "a", "c"]
    u = "7e16a6c7-51eb-47f0-ab15-a59048cffb53"
    for s in (u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u}\n"):
        assert one(spark, uuid_of(F.lit(s)))[0] == u
    assert one(spark, uuid_of(F.lit("no")))[0] is None


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, l2(a, b), cosine(a, a), cosine(a, b))[:] == (5.0, 1.0, None)
    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(decode_f32(encode_f32("v"))).collect()] == [[1.5, -2.0], None, []]
    t = spark.createDataFrame([("ab",), (None,), ("",)], "t string").select(sine_embedder(4)("t").alias("v")).collect()
    assert t[1].v is None and abs(sum(x * x for x in t[0].v) - 1) < 1e-6 and len(t[2].v) == 4


def test_search(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.9])], "query int, embedding array<float>")
    got = {(r.query, r.rank): (r.id, r.distance) for r in search.knn(v, q, 2).collect()}
    assert got == {(1, 1): ("a", 0.0), (1, 2): ("b", 0.0), (2, 1): ("c", 0.1), (2, 2): ("a", 1.345362)}
    assert search.knn(v, q.limit(0), 2).count() == 0 and search.knn(v.limit(0), q, 2).count() == 0
    with pytest.raises(ValueError):
        search.rebuild_index(v, v, "other")


def test_timing(spark):
    got = one(spark, T.skew_bound(F.lit(700000), F.lit(900000)), T.skew_bound(F.lit(1), F.lit(2)), T.is_safe_ms(F.lit(2**53)), T.is_epoch_ms(F.lit(-1)), T.is_epoch_ms(F.lit(1.5)), T.iso_to_ms(F.lit("2024-01-01T00:00:00.500Z")), T.file_stamp(F.lit(1500)))
    assert got[:] == (400000, 0, False, False, False, 1704067200500, "1970-01-01T00-00-01-500Z")
    with pytest.raises(Exception, match="ERR_TS_OVERFLOW"):
        one(spark, T.to_safe_ms(F.lit(-5)))


def test_codecs(spark):
    b = F.lit("x" * 1000).cast("binary")
    packed = H.gzip_bytes(b)
    assert one(spark, F.octet_length(H.gunzip_bytes(packed)), F.octet_length(packed) < 100, H.gunzip_bytes(F.lit(b"plain")), H.gunzip_bytes(F.lit(b"\x1f\x8bbad")))[:] == (1000, True, bytearray(b"plain"), None)
    key = bytes(32)
    sealed = H.encrypt(F.lit(b"secret"), key, F.lit(bytes(12)))
    assert one(spark, H.decrypt(sealed, key), H.decrypt(sealed, b"1" * 32), F.octet_length(sealed))[:] == (bytearray(b"secret"), None, 34)
    with pytest.raises(ValueError):
        H.decrypt(sealed, b"short")
    got = spark.createDataFrame([('{"b":1,"a":{"d":[1,2],"c":"é"}}',), ("{bad",), (None,)], "t string").select(H.canonical_json("t")).collect()
    assert [r[0] for r in got] == ['{"a":{"c":"é","d":[1,2]},"b":1}', None, None]


def test_masking(spark):
    m = one(spark, redact(F.create_map(F.lit("key"), F.lit("k"), F.lit("other"), F.lit("o"))).alias("m")).m
    assert m == {"key": "[REDACTED]", "other": "o"}
    assert one(spark, classify(F.lit(5))["code"], classify(F.lit(99))["code"])[:] == ("ERR_INTEGRITY", "ERR_UNKNOWN")


REC = "id string, ts bigint, hash string, source string, seq bigint"


def test_conflicts(spark):
    a = spark.createDataFrame([("x", 10, "h1", "s", 1), ("x", 5, "h2", "s", 2), ("y", 7, "h", "s", 3), ("t", 9, "a", "s", 4), ("l", 1, "q", "s", 5), ("n", 3, None, None, 6)], REC)
    b = spark.createDataFrame([("x", 400_000, "h3", "s", 1), ("y", 9, "h", "s", 2), ("t", 9, "b", "s", 3), ("r", 1, "q", "s", 4), ("n", 3, None, None, 5)], REC)
    got = {r.id: (r.outcome, r.winner.ts) for r in merge.align(a, b).collect()}
    assert got == {"x": ("remote", 400_000), "y": ("no-conflict", 9), "t": ("remote", 9), "l": ("local-only", 1), "r": ("remote-only", 1), "n": ("no-conflict", 3)}
    got = {r.id: r.reason for r in merge.align(a, b, prefer="local", skew_ms=500_000).collect()}
    assert got["x"] == "prefer-local-within-skew (delta=399995ms)"
    assert merge.merge_counts(a, b, policy="preferLocal").first()[:] == (1, 1, 2, 6)
    with pytest.raises(ValueError):
        merge.align(a, b, policy="other")
    assert merge.align(a.limit(0), b.limit(0)).count() == 0


def test_last_writer_keeps_first_of_full_ties(spark):
    r = spark.createDataFrame([("x", 1, "h", "one", 2), ("x", 1, "h", "two", 1), ("x", 0, "z", "three", 0)], REC)
    assert merge.last_writer(r).first().source == "two"


def concept(id_, **k):
    base = dict(id=id_, namespace="default", version=1, created_at=1, updated_at=1, tag_list=["a"], markdown=None, thoughtform=None, embedding=None)
    return Row(**(base | k))


def test_save_and_delete(spark):
    old = spark.createDataFrame([concept("x", markdown="m", version=3), concept("y")], CONCEPTS)
    ch = spark.createDataFrame([("x", "elsewhere", ["b"], None, 3), ("y", None, None, "n", 7), ("z", None, None, "new", None), ("w", None, None, "w", 2)], "id string, namespace string, tag_list array<string>, markdown string, expected_version int")
    new, rejected = mutate.save(old, ch, 9)
    got = {r.id: (r.namespace, r.version, r.updated_at, r.tag_list, r.markdown) for r in new.collect()}
    assert got == {"x": ("default", 4, 9, ["a", "b"], "m"), "y": ("default", 1, 1, ["a"], None), "z": ("default", 1, 9, [], "new")}
    assert {tuple(r) for r in rejected.collect()} == {("y", 1), ("w", 0)}
    left, missing = mutate.delete(old, spark.createDataFrame([("x",), ("q",)], "id string"))
    assert [r.id for r in left.collect()] == ["y"] and [r.id for r in missing.collect()] == ["q"]
    seq = spark.createDataFrame([("x", "one", ["c"], 1), ("x", None, ["d", "c"], 2), ("n", "k", None, 3)], "id string, markdown string, tag_list array<string>, seq int")
    got = {r.id: (r.version, r.markdown, r.tag_list) for r in mutate.save_batch(old, seq, 9).collect()}
    assert got["x"] == (5, "one", ["a", "c", "d"]) and got["n"] == (1, "k", []) and got["y"][0] == 1


@pytest.mark.parametrize("policy, want", [("local_first", ["skipped", "updated", "updated", "inserted"]), ("strict_newer", ["skipped", "skipped", "updated", "inserted"]), ("pull", ["skipped", "skipped", "updated", "inserted"])])
def test_three_rules_on_equal_times(spark, policy, want):
    df = spark.createDataFrame([(1, 5, 4), (2, 5, 5), (3, 5, 6), (4, None, 6)], "n int, a bigint, b bigint").orderBy("n")
    assert [r[1] for r in df.select("n", mutate.decide(F.col("a"), F.col("b"), policy)).collect()] == want


def test_tombstones(spark):
    e = spark.createDataFrame([("k", "v", False, 1), ("k", None, True, 2), ("j", "w", None, 1)], "key string, content string, tombstone boolean, seq int")
    assert [r.key for r in mutate.without_tombstones(e).collect()] == ["j"]


def test_chunks(spark):
    p = spark.createDataFrame([("a", "abcdefg"), ("e", ""), ("n", None)], "k string, p string")
    parts = store.chunk(p.select("k", F.col("p").cast("binary").alias("p")), "k", F.col("p"), 3).withColumn("created_at_ms", F.lit(1))
    assert {(r.k, r.chunk_index, bytes(r.payload)) for r in parts.collect()} == {("a", 0, b"abc"), ("a", 1, b"def"), ("a", 2, b"g"), ("e", 0, b"")}
    ok, bad = store.reassemble(parts.union(parts), "k")
    assert {(r.k, bytes(r.payload), r.bytes) for r in ok.collect()} == {("a", b"abcdefg", 7), ("e", b"", 0)} and bad.count() == 0
    missing = parts.filter("not (k = 'a' and chunk_index = 1)")
    assert store.reassemble(missing, "k")[1].first().error == "missing chunk"
    damaged = parts.withColumn("payload", F.when(F.col("chunk_index") == 1, F.lit(b"xxx")).otherwise(F.col("payload")))
    assert store.reassemble(damaged, "k")[1].first().error == "hash mismatch"
    with pytest.raises(ValueError):
        store.chunk(p, "k", F.col("p"), 0)


def test_store_pages_and_access(spark):
    c = spark.createDataFrame([(f"c{i}", i // 2, f"p{i % 2}") for i in range(6)], "commit_id string, created_at_ms bigint, author_principal string")
    cur = lambda x: spark.createDataFrame([(x,)], "commit_id string")
    assert [r.commit_id for r in store.list_commits(c, -1, cur("c2"), 2).collect()] == ["c3", "c4"]
    assert [r.commit_id for r in store.list_commits(c, -1, cur("unknown"), 2).collect()] == ["c0", "c1"]
    g = spark.createDataFrame([("o", None, "owner"), ("r", "p1", "read")], "principal string, author string, role string")
    assert [store.visible(c, g, p).count() for p in ("o", "r", "x")] == [6, 3, 0]
    req = spark.createDataFrame([("new", "k1", 1), ("d", "k0", 1), ("gap", "k2", 1), ("few", "k3", 2)], "commit_id string, dedupe_key string, expected_chunks int")
    known = spark.createDataFrame([("old", "k0")], "commit_id string, dedupe_key string")
    chunks = spark.createDataFrame([("new", 0, 1), ("gap", 1, 1), ("few", 0, 2)], "commit_id string, chunk_index int, chunk_count int")
    assert {r.commit_id: r.outcome for r in store.finalize(req, known, chunks).collect()} == {"new": "accepted", "d": "duplicate", "gap": "gap", "few": "count mismatch"}


def test_bundle_round_trip_and_parts(spark):
    r = spark.createDataFrame([("x", 1, "h1", "s", "tëxt", "a"), ("x", 2, "h2", "s", None, "a"), ("y", 3, "h3", None, "y", None)] + [(f"m{i}", 5, f"h{i}", "s", "m", "big") for i in range(9)], "id string, ts bigint, hash string, source string, raw_text string, ns string")
    none, key = spark.createDataFrame([], "dedupe_key string"), b"k" * 32
    assert bundle.pack(r, "ns", most=3).filter("ns = 'big'").count() > 1
    chunks, commits = bundle.backup(r, none, "ns", 7, chunk_size=50, key=key)
    rows, errors = bundle.restore(chunks, commits, key=key)
    got = {x.id: (x.ts, x.raw_text) for x in rows.collect()}
    assert got["x"] == (2, None) and got["y"] == (3, "y") and len(got) == 11 and errors.count() == 0
    rows, errors = bundle.restore(chunks, commits, key=b"w" * 32)
    assert rows.count() == 0 and {e.error for e in errors.collect()} == {"cannot be decrypted or unpacked"}
    with pytest.raises(ValueError):
        bundle.pack(r, "ns", require_encryption=True)


def test_extract_both_ways_agree(spark):
    texts = ["Albert Einstein developed the theory at Princeton University. Marie Curie visited Albert Einstein.", 'The "graph" is a `tree` of things. "graph" holds Jean Dupontés and Jean Dupont.', "", None, "A cat sat near Paris, London and Rome. It was Bob the City of Mexico City!"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, entity string")
    full = {r.doc_id: r.extracted for r in extract.extract(df, "doc_id", "text").collect()}
    own = {}
    for r in extract.find_entities(df, "doc_id", "text").orderBy("doc_id", "n").collect():
        own.setdefault(r.doc_id, []).append((r.entity_id, r.entity, r.type, r.confidence))
    for i, f in full.items():
        assert own.get(i, []) == [(e.id, e.text, e.type, e.confidence) for e in f.entities]
        for e in f.entities:
            assert texts[i][e.start : e.end] == e.text
    ents = extract.find_entities(df, "doc_id", "text")
    rels = extract.relations(df, "doc_id", "text")
    assert extract.sentence_pairs(df, "doc_id", "text", ents).count() >= rels.count()
    assert {(r.doc_id, r.subject_id, r.predicate, r.object_id) for r in rels.collect()} == {(i, x.subjectId, x.predicate, x.objectId) for i, f in full.items() for x in f.relationships}
    graph = {(r.doc_id, r.node): r.neighbours for r in extract.context_graph(df, "doc_id", "text").collect()}
    assert graph == {(i, n): list(v) for i, f in full.items() for n, v in f.contextGraph.items()}


def test_convert(spark):
    tf = {"id": "i", "rawText": "Text here", "language": "en", "entities": [{"id": "e0", "text": "Ada", "type": "PERSON", "confidence": 0.75}], "relationships": [{"subjectId": "e0", "predicate": "wrote", "objectId": "e9"}]}
    c = spark.createDataFrame([concept("live", thoughtform=json.dumps(tf)), concept("cut", thoughtform='{"id":'), concept("none"), concept("v", embedding=[1.0, 0.0]), concept("m", markdown="Hello", embedding=[0.9, 0.1])], CONCEPTS)
    assert {r.id: r.markdown for r in convert(c, "thoughtform", "markdown").collect()} == {"live": "# Text here\n\nText here\n\n## Entities\n\n- **Ada** (PERSON, confidence: 0.75)\n\n## Relationships\n\n- Ada **wrote** e9"}
    near = {r.id: r.markdown for r in convert(c, "vector", "markdown", dim=2).collect()}  # null and wrong vectors count as none
    assert set(near) == {"v", "m"} and near == {r.id: r.markdown for r in convert(c, "vector", "markdown", dim=2, coarse=True).collect()}
    assert near["v"].endswith("\n\nHello") and "No neighboring" in near["m"]
    assert convert(c, "markdown", "vector", 8).count() == 1 and convert(c, "markdown", "thoughtform", check=False).count() == 1 and convert(c, "thoughtform", "vector", 8).count() == 1
    assert one(spark, reconstruct(F.array(F.lit("a"), F.lit("b"))))[0].endswith("## Related Context 1\n\na\n\n## Related Context 2\n\nb")
    with pytest.raises(Exception, match="UUID"):
        convert(c, "markdown", "thoughtform").collect()
    made = spark.createDataFrame([concept("0b5e8c2e-7c1d-4f8e-9a1b-2c3d4e5f6a7b", markdown="Ada Lovelace wrote to Charles Babbage.")], CONCEPTS)
    form = json.loads(convert(made, "markdown", "thoughtform", now_ms=1_700_000_000_000).first().thoughtform)
    assert form["rawText"].startswith("Ada") and form["metadata"]["source"] == "converted" and form["entities"][0]["offset"] == {"start": 0, "end": 12} and form["language"] == "en"
    back = convert(made.withColumn("thoughtform", F.lit(json.dumps(form))), "thoughtform", "markdown").first().markdown
    assert back.startswith("# Ada Lovelace") and "## Entities" in back
    assert convert(c, "vector", "thoughtform", dim=2).count() == 2
    for pair in (("vector", "vector"), ("vector", "sound")):
        with pytest.raises(ValueError):
            convert(c, *pair)


def test_validation(spark):
    df = spark.createDataFrame([("x", "h" * 16, "s", 1), ("", None, None, -1)], "id string, content_hash string, source string, updated_at bigint")
    good, bad = validate.split_valid(df, validate.record_rules())
    assert good.count() == 1 and [e.path for e in bad.first().errors] == ["id", "metadata.contentHash", "metadata.source", "metadata.updatedAtMs"]
    with pytest.raises(Exception, match="metadata.source"):
        validate.require(df, validate.record_rules()).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"x","content_hash":"0123456789abcdef","source":"s","updated_at":1},{"id":"","source":"s"}]')
    kind = "id string, content_hash string, source string, updated_at bigint"
    good, bad = io.read_records(spark, str(tmp_path / "a.json"), kind, validate.record_rules(), strict=False)
    assert good.count() == 1 and [(r.position, "metadata.contentHash" in r.error) for r in bad.collect()] == [(1, True)]
    with pytest.raises(ValueError, match="element 1: id must not be empty"):
        io.read_records(spark, str(tmp_path / "a.json"), kind, validate.record_rules())
    (tmp_path / "o.json").write_text('{"id":"x"}')
    with pytest.raises(ValueError, match="not a JSON array"):
        io.read_records(spark, str(tmp_path / "o.json"), kind)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/one.gz").write_bytes(gzip.compress(b'{"thoughtforms":[{"id":"p"},{"id":"q"}]}'))
    (tmp_path / "b/two.json").write_bytes(b'[{"id":"r"}]')
    assert sorted(r.id for r in io.read_bundles(spark, str(tmp_path / "b"), "struct<id:string>").collect()) == ["p", "q", "r"]
    snap = spark.createDataFrame([('{"version":"1","concepts":[{"id":"x","tags":["a",1,"b"],"thoughtform":{"k":1},"embedding":[1,2]},{"id":"y"}]}',)], "doc string")
    rows = {r.id: r for r in io.parse_snapshot(snap, "doc").collect()}
    assert rows["x"].tag_list == ["a", "b"] and rows["x"].embedding == [1.0, 2.0] and json.loads(rows["x"].thoughtform) == {"k": 1} and rows["y"].namespace == "default" and rows["y"].tag_list == []
    with pytest.raises(Exception, match="without id at 0"):
        io.parse_snapshot(spark.createDataFrame([('{"concepts":[{"tags":[]}]}',)], "doc string"), "doc").collect()
    c = spark.createDataFrame([concept("x", markdown="m", thoughtform="{}"), concept("y")], CONCEPTS)
    io.write_snapshot(c, str(tmp_path / "snap"))
    assert spark.read.text(str(tmp_path / "snap")).count() == 2
    entries = io.to_entries(c)
    assert sorted(r.key for r in entries.collect()) == ["concepts/x/markdown", "concepts/x/thoughtform"] and io.from_entries(entries).first()[:] == ("x", "m")
    assert io.to_archive(c, ("a",)).first().tags == {"Content-Type": "text/markdown", "tag-a": "true"}


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "mem"))
    ch = spark.createDataFrame([("x", ["t"], "Ada Lovelace wrote `notes`.", [1.0, 0.0]), ("y", None, "two", [0.0, 1.0])], "id string, tag_list array<string>, markdown string, embedding array<float>")
    assert m.save(ch, 1).count() == 0
    assert m.save(spark.createDataFrame([("x", 9)], "id string, expected_version int"), 2).first().current_version == 1
    with pytest.raises(ValueError, match="at least one"):
        m.save(ch.limit(0), 3)
    with pytest.raises(Exception, match="UUID"):
        m.save(ch, 3, uuids=True)
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query int, embedding array<float>")
    assert m.search(q, 1).first().id == "x" and m.stats().first().vectors == 2 and m.list().first().total == 2
    m.backup(3)
    m.backup(4)
    assert m._read("commits", "commit_id string").count() == 1
    assert {r.id for r in m.restore()[0].collect()} == {"x", "y"}
    snap = spark.createDataFrame([('{"concepts":[{"id":"x","markdown":"again"},{"id":"q","markdown":"third"}]}',)], "doc string")
    assert m.import_snapshot(snap, "doc", 5).first()[:] == (1, 1, 0, [])
    assert {r.id: r.markdown for r in m.concepts.collect()} == {"x": "again", "y": "two", "q": "third"}
    m.embed_missing(6, dim=2)
    assert m.index.count() == 3 and abs(m.similarity("ab", "ab").first().similarity - 1) < 1e-6
    m.pull(spark.createDataFrame([("concepts/y/markdown", "pulled", 9), ("concepts/x/markdown", "old", 1), ("other", "z", 9)], "key string, content string, at bigint"), 7, "at")
    assert {r.id: r.markdown for r in m.concepts.collect()} == {"x": "again", "y": "pulled", "q": "third"}
    assert m.push().count() == 3 and m.archive(("t",)).count() == 1
    m.delete(spark.createDataFrame([("q",)], "id string"), 8)
    m.delete(spark.createDataFrame([("x",)], "id string"), 9)
    log = [(r.type, r.id) for r in m.events.orderBy("ts", "id", "type").collect()]
    assert log[:2] == [("created", "x"), ("created", "y")] and log[-2:] == [("deleted", "q"), ("deleted", "x")] and ("updated", "y") in log and ("created", "q") in log
    assert sorted(r.key for r in m.tombstones().collect()) == ["concepts/q/markdown", "concepts/q/thoughtform", "concepts/x/markdown", "concepts/x/thoughtform"]
    assert m.index.count() == 1 and m.health()["ok"]
    with pytest.raises(KeyError):
        m.delete(spark.createDataFrame([("x",)], "id string"))


def test_memory_restores_merges_and_remembers(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "one"))
    assert isinstance(m, Catalog)
    m.bootstrap()
    m.bootstrap()
    assert m.concepts.count() == 0
    ch = spark.createDataFrame([("x", "a", ["t", "u"], "text x", '{"rawText":"x"}', [1.0, 0.0]), ("y", "b", None, "text y", None, None)], "id string, namespace string, tag_list array<string>, markdown string, thoughtform string, embedding array<float>")
    m.save(ch, 10, snapshot_every=3)
    assert m._versions("commits") == [1]
    m.save(ch.filter("id = 'x'").select("id", "markdown"), 11, snapshot_every=3)
    assert m._read("commits", COMMITS).count() == 2 and m.get_state("saves_since_backup") == "0"  # the third save made a backup, a bundle a namespace
    m.save(spark.createDataFrame([("y", "new y")], "id string, markdown string"), 12)
    m.backup(13, author="me")
    last = m._read("commits", COMMITS).filter("created_at_ms = 13").collect()
    assert len(last) == 1 and last[0].author_principal == "me" and last[0].parent_commit_id and last[0].sync_mode == "backup" and last[0].until_ms == 12
    two = Memory(spark, str(tmp_path / "two"))
    for name in ("chunks", "commits"):
        two._write(name, spark.read.parquet(f"{m.root}/{name}/v{m._versions(name)[-1]}"))
    two.save(spark.createDataFrame([("y", "mine")], "id string, markdown string"), 50)
    counts, errors = two.restore_concepts(60)
    assert counts.first()[:] == (1, 0, 1, 2) and errors.count() == 0
    got = {r.id: (r.namespace, r.tag_list, r.markdown, r.thoughtform) for r in two.concepts.collect()}
    assert got == {"x": ("a", ["t", "u"], "text x", '{"rawText":"x"}'), "y": ("default", [], "mine", None)}
    local, remote = ([{"id": "p", "ts": 9_000_000, "hash": "h1", "source": "s", "seq": 1}], [{"id": "p", "ts": 9_500_000, "hash": "h2", "source": "s", "seq": 1}, {"id": "q", "ts": 100, "hash": "h3", "source": "s", "seq": 2}])
    for name, rows in (("l", local), ("r", remote)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    files = [str(tmp_path / "l.json"), str(tmp_path / "r.json")]
    assert m.merge_files(*files, str(tmp_path / "merged")).first().asDict() == {"local_only": 0, "remote_only": 1, "conflicts": 1, "merged": 2}
    assert m.rebase_files(*files, str(tmp_path / "re1"), 1).first().asDict() == {"local_base": 9_500_000, "observed_remote_max": 9_500_000, "delta_rows": 2}
    assert m.rebase_files(*files, str(tmp_path / "re2"), 2).first().delta_rows == 1 and m.get_state("rebase_observed_max") == "9500000"  # later than the last bound
    assert m.rebase_files(*files, str(tmp_path / "re3"), 3, base=0).first().delta_rows == 1  # one bound alone overrides nothing
    part = m.concepts.filter("namespace = 'a'")
    assert "PartitionFilters: [isnotnull(namespace" in part._jdf.queryExecution().toString() or "namespace=a" in " ".join(part.inputFiles())
    errs = m.import_snapshot(spark.createDataFrame([('{"concepts":[{"id":"z","markdown":"1"},{"markdown":"lost"},{"id":"z","markdown":"2"}]}',)], "doc string"), "doc", 70, strict=False).first()
    assert errs[:] == (1, 0, 1, ["concept without id at 1"]) and {r.id: (r.markdown, r.version) for r in m.concepts.filter("id = 'z'").collect()} == {"z": ("2", 2)}


def test_table_service_and_access(spark, tmp_path):
    s = TableService(spark, str(tmp_path / "svc"))
    assert isinstance(s, ChunkService) and isinstance(s, IndexService)
    r = spark.createDataFrame([("x", 1, "h" * 16, "s", "some text", "a")], "id string, ts bigint, hash string, source string, raw_text string, ns string")
    parts, commits = bundle.backup(r, spark.createDataFrame([], "dedupe_key string"), "ns", 7, chunk_size=64)
    asked = commits.selectExpr("commit_id", "dedupe_key", "chunk_count AS expected_chunks", "created_at_ms")
    assert [x.outcome for x in upload(s, parts, asked).collect()] == ["accepted"] and [x.outcome for x in upload(s, parts, asked).collect()] == ["duplicate"]
    assert download(s, s.list_commits(), 2).count() == parts.count() > 2
    assert bundle.restore(s.chunks, commits)[0].first().raw_text == "some text"
    vec = spark.createDataFrame([("x", [1.0])], "id string, embedding array<float>")
    assert s.rebuild(vec, "replace") == 1 and s.rebuild(vec.withColumn("id", F.lit("y")), "upsert") == 2
    g = spark.createDataFrame([("o", None, "owner")], "principal string, author string, role string")
    assert store.change_grants(g, "x", "write", ["w"]).count() == 1
    g = store.change_grants(g, "o", "write", ["w", "w"])
    assert g.count() == 2 and store.change_grants(g, "o", "write", []).count() == 1
    ok, refused = store.writable(spark.createDataFrame([("o", 1), ("w", 2), ("z", 3)], "principal string, n int"), g)
    assert sorted(x.n for x in ok.collect()) == [1, 2] and [(x.n, x.error) for x in refused.collect()] == [(3, "unauthorized")]


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"root": "${HOME_DIR}/data", "compress": "TRUE", "dimension": 8}')
    got = config.load(str(f), {"HOME_DIR": "/x", "LOREKILN_SNAPSHOT_EVERY": "7", "LOREKILN_REQUIRE_ENCRYPTION": "1"})
    assert (got.root, got.compress, got.dimension, got.snapshot_every, got.require_encryption) == ("/x/data", True, 8, 7, True)
    f.write_text('{"nope": 1}')
    with pytest.raises(ValueError, match="nope"):
        config.load(str(f), {})


def _stream(spark, tmp_path, rows):
    schema = "event_id bigint, ts timestamp, id string, type string, embedding array<float>"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [[(1, t(0), "a", "created", [1.0]), (2, t(1), "a", "updated", None), (3, t(2), "b", "created", [2.0])], [(4, t(60), "a", "updated", [3.0]), (5, t(61), "b", "deleted", None), (5, t(61), "b", "deleted", None), (6, t(400), "c", "created", [4.0])]]
    stream = _stream(spark, tmp_path, rows)
    state = {"n": 0}

    def read():
        return spark.read.parquet(str(tmp_path / f"ix/{state['n']}")) if state["n"] else spark.createDataFrame([], "id string, embedding array<float>")

    def write(df, n):
        df.write.parquet(str(tmp_path / f"ix/{state['n'] + 1}"))
        state["n"] += 1

    changes.index_sync(stream, read, write).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame([r for part in rows for r in part], stream.schema)
    want = {r.id: r.embedding for r in changes.apply_to_index(spark.createDataFrame([], "id string, embedding array<float>"), batch).collect()}
    assert {r.id: r.embedding for r in read().collect()} == want == {"a": [3.0], "c": [4.0]}

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    fired = run(changes.save_counter_stream(stream, 2, "id"), "fired")
    assert [r[:] for r in fired.collect()] == [("a", 1, 2)]
    assert run(changes.once(stream, "event_id"), "once_").count() == 6
    got = {(r.id, r.events) for r in run(changes.debounce_stream(stream, "5 seconds", "1 second"), "calm").collect()}
    assert got >= {("a", 2), ("b", 1), ("a", 1)}
    seen = []
    changes.fan_out(stream, lambda b, n: seen.append(b.count()), lambda b, n: seen.append(n)).option("checkpointLocation", str(tmp_path / "cp5")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen[::2]) == 7


def test_save_counter(spark):
    log = spark.range(0, 250).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("k").alias("id"), F.when(F.col("id") % 5 == 0, "deleted").otherwise("updated").alias("type"))
    got = changes.save_counter(log, 50).orderBy("snapshot_no").collect()
    assert [r.snapshot_no for r in got] == [1, 2, 3, 4] and changes.save_counter(log, 0).count() == 0


def test_stages(spark):
    s = stages.write_stage(spark.range(3))
    assert s.df.count() == 3
    s.release()
    assert s.path not in stages._WRITTEN


def test_scopes_remove_their_stages(spark):
    with stages.Scope() as outer:
        with stages.Scope() as inner:
            a, b = stages.write_stage(spark.range(3)), inner.keep(stages.write_stage(spark.range(4), F.col("id") > 1))
        assert a.path not in stages._WRITTEN and b.df.count() == 4 and b.counted == 2
        c = outer.keep(stages.write_stage(spark.range(5).withColumn("x", F.lit(1)), partition_by="id"))
    assert b.path not in stages._WRITTEN and c.df.filter("id = 2").count() == 1 and not stages._SCOPES
    c.release()
