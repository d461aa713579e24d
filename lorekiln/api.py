"""One object over a folder of tables, for callers who want the engine's operations under one roof.

Tables are Parquet folders ``<root>/<name>/v<n>``; the newest version is read. A change is written as a new version and
never over the one being read, so a job that fails leaves the old table as it was; the last ``KEEP`` versions stay. Concepts are
partitioned by namespace, so a filter on it reads only its folder. Change events are appended to a log. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.vectors import cosine
from lorekiln.operators import bundle, catalog, convert, extract, merge, mutate, search, store, validate
from lorekiln.sources import records

CONCEPTS = "id string, namespace string, version int, created_at bigint, updated_at bigint, tag_list array<string>, markdown string, thoughtform string, embedding array<float>"
INDEX = "id string, embedding array<float>"
CHUNKS = "commit_id string, chunk_index int, chunk_count int, payload binary, chunk_hash string, bundle_id string, created_at_ms bigint, idempotency_key string"
COMMITS = (
    "commit_id string, bundle_id string, dedupe_key string, manifest_hash string, created_at_ms bigint, chunk_count int, parent_commit_id string, author_principal string, "
    "sync_mode string, records bigint, since_ms bigint, until_ms bigint"
)
EVENTS = "event_id string, ts timestamp, id string, type string, namespace string"
STATE = "key string, value string"
RECORDS = "id string, ts bigint, hash string, source string, seq bigint"
KEEP = 3
PARTITIONS = {"concepts": "namespace"}


class Memory:
    """Concepts, their vector index, and a chunk store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))

    def _read(self, name: str, schema: str) -> DataFrame:
        v = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{v[-1]}") if v else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame) -> None:
        have = self._versions(name)
        out = df.write
        if name in PARTITIONS:
            out = out.partitionBy(PARTITIONS[name])
        out.parquet(f"{self.root}/{name}/v{(have[-1] if have else 0) + 1}")
        jvm = self.spark.sparkContext._jvm
        for old in have[: -(KEEP - 1)]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def bootstrap(self) -> None:
        """Writes the tables that are not there yet, empty; what is there stays as it is. Columns a later release adds are null in older tables."""
        for name, schema in (("concepts", CONCEPTS), ("index", INDEX), ("chunks", CHUNKS), ("commits", COMMITS)):
            if not self._versions(name):
                self._write(name, self.spark.createDataFrame([], schema))

    @property
    def events(self) -> DataFrame:
        """The log of changes: event_id, ts, id, type, namespace."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/events")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/events")

    def event_stream(self) -> DataFrame:
        """The log as a stream."""
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.root}/events")

    def _emit(self, rows: DataFrame, now_ms: int) -> None:
        ts = F.timestamp_millis(F.lit(now_ms))
        rows.select(F.concat_ws("-", F.lit(str(now_ms)), "type", "id").alias("event_id"), ts.alias("ts"), "id", "type", "namespace").write.mode("append").parquet(f"{self.root}/events")

    def get_state(self, key: str) -> str | None:
        row = self._read("state", STATE).filter(F.col("key") == key).first()
        return row.value if row else None

    def set_state(self, **values: object) -> None:
        """Remembers a value under a key, for the engine's own bookkeeping."""
        kept = {r.key: r.value for r in self._read("state", STATE).collect()} | {k: str(v) for k, v in values.items()}  # a handful of keys
        self._write("state", self.spark.createDataFrame(sorted(kept.items()), STATE))

    @property
    def concepts(self) -> DataFrame:
        return self._read("concepts", CONCEPTS)

    @property
    def index(self) -> DataFrame:
        return self._read("index", INDEX)

    def save(self, changes: DataFrame, now_ms: int, batch: bool = False, snapshot_every: int = 0, index: bool = True, uuids: bool = False) -> DataFrame:
        """Applies changes (with ``seq`` if ``batch``) and brings the index up to date; the rejected ones are returned.

        No change at all is an error. Every change goes to the log of events. ``snapshot_every``: a backup after that many changes, counted over all calls; 0 for none.
        ``uuids``: ids must be UUIDs.
        """
        if changes.isEmpty():
            raise ValueError("at least one change is needed")
        if uuids:
            changes = validate.require(changes, [validate.matches("id", F.col("id"), validate.UUID, "must be a UUID")])
        old = self.concepts.select("id", F.col("version").alias("old"))
        if batch:
            new, rejected = mutate.save_batch(self.concepts, changes, now_ms), self.spark.createDataFrame([], "id string, current_version int")
        else:
            new, rejected = mutate.save(self.concepts, changes, now_ms)
        self._write("rejected", rejected)  # before the table moves on: what was rejected is judged by the old one
        self._write("concepts", new)
        changed = self.concepts.select("id", "namespace", "version").join(changes.select("id").distinct(), "id", "left_semi").join(old, "id", "left").filter(F.col("old").isNull() | (F.col("old") != F.col("version")))
        self._emit(changed.select("id", "namespace", F.when(F.col("old").isNull(), "created").otherwise("updated").alias("type")), now_ms)
        if index:
            self._write("index", search.index_from(self.concepts))
        if snapshot_every > 0:
            seen = int(self.get_state("saves_since_backup") or 0) + self.events.filter((F.col("ts") == F.timestamp_millis(F.lit(now_ms))) & (F.col("type") != "deleted")).count()
            if seen >= snapshot_every:
                self.backup(now_ms)
                seen = 0
            self.set_state(saves_since_backup=seen)
        return self._read("rejected", "id string, current_version int")

    def delete(self, ids: DataFrame, now_ms: int = 0) -> None:
        """An id that is not there is an error."""
        left, missing = mutate.delete(self.concepts, ids)
        if lost := missing.limit(5).collect():
            raise KeyError(", ".join(r.id for r in lost))
        gone = self.concepts.join(ids.select("id"), "id", "left_semi").select("id", "namespace", F.lit("deleted").alias("type"))
        self._emit(gone, now_ms)
        self._write("concepts", left)
        self._write("index", self.index.join(ids.select("id"), "id", "left_anti"))

    def read(self, ids: DataFrame, representations: tuple[str, ...] | None = None) -> DataFrame:
        return catalog.represent(self.concepts.join(ids.select("id"), "id", "left_semi"), representations)

    def list(self, **options) -> DataFrame:
        if not 1 <= options.get("limit", 50) <= 100 or options.get("offset", 0) < 0:
            raise ValueError("limit must be 1..100 and offset 0 or more")
        return catalog.list_page(self.concepts, **options)

    def stats(self, by_namespace: bool = False) -> DataFrame:
        return catalog.stats(self.concepts, self.index.withColumnRenamed("id", "concept_id"), by_namespace)

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        if not 1 <= k <= 100:
            raise ValueError("k must be 1..100")
        return search.search(self.concepts.filter(F.col("embedding").isNotNull()), queries, k, **options)

    def convert(self, source: str, target: str, now_ms: int, ids: DataFrame | None = None, **options) -> None:
        """Converts every concept that has ``source``, or those of ``ids``, and saves the result."""
        rows = self.concepts if ids is None else self.concepts.join(ids.select("id").distinct(), "id", "left_semi")
        made = convert.convert(rows, source, target, now_ms=now_ms, **options)
        if not made.isEmpty():
            self.save(made, now_ms)

    def extract(self, **options) -> DataFrame:
        return extract.extract(self.concepts, "id", "markdown", **options)

    def records(self) -> DataFrame:
        """The concepts as records of a bundle; the hash covers everything that is stored."""
        what = F.to_json(F.struct("namespace", "tag_list", "markdown", "thoughtform"))
        return self.concepts.select(
            "id", "namespace", "version", "tag_list", F.col("updated_at").alias("ts"), F.sha2(what, 256).alias("hash"), F.lit("memory").alias("source"), F.col("markdown").alias("raw_text"), F.col("thoughtform").alias("form")
        )

    def backup(self, now_ms: int, **options) -> None:
        """Adds a bundle of every namespace to the chunk store; contents that are there already are not written again."""
        chunks, commits = self._read("chunks", CHUNKS), self._read("commits", COMMITS)
        more_chunks, more_commits = bundle.backup(self.records(), commits, "namespace", now_ms, **options)
        new_chunks = store.put_chunks(chunks, more_chunks)
        self._write("chunks", chunks.unionByName(new_chunks, allowMissingColumns=True))
        self._write("commits", commits.unionByName(more_commits, allowMissingColumns=True))

    def restore(self, **options) -> tuple[DataFrame, DataFrame]:
        """(records, errors) of the chunk store; records that break the rules are errors."""
        return bundle.restore(self._read("chunks", CHUNKS), self._read("commits", COMMITS), rules=bundle.restored_rules(), **options)

    def restore_concepts(self, now_ms: int, policy: str = "strict_newer", **options) -> tuple[DataFrame, DataFrame]:
        """(counts of inserted, updated, skipped, total; errors): restores, takes over what the policy allows, and rebuilds the index.

        A restored concept keeps its namespace, text, structured form and tags; nothing is saved twice.
        """
        rows, errors = self.restore(**options)
        old = self.concepts.select("id", F.col("updated_at").alias("ms"))
        self._write("restored", rows.join(old, "id", "left").withColumn("action", mutate.decide(F.col("ms"), F.col("ts"), policy)).drop("ms"))
        decided = self.spark.read.parquet(f"{self.root}/restored/v{self._versions('restored')[-1]}")
        take = decided.filter(F.col("action") != "skipped").select("id", "namespace", "tag_list", F.col("raw_text").alias("markdown"), F.col("form").alias("thoughtform"))
        if not take.isEmpty():
            self.save(take, now_ms, index=False)
        self.rebuild_index()
        return mutate.upsert_counts(decided), errors

    def rebuild_index(self, new: DataFrame | None = None, mode: str = "replace") -> None:
        """The index anew from the stored embeddings, or from given rows."""
        self._write("index", search.rebuild_index(self.index, search.index_from(self.concepts) if new is None else new, mode))

    def merge_files(self, local: str, remote: str, out: str, schema: str = RECORDS, **options) -> DataFrame:
        """Merges two files of records; writes merged.json, conflicts and counts under ``out`` and returns the counts."""
        a, b = (records.read_records(self.spark, p, schema)[0] for p in (local, remote))
        merged, conflicts = merge.merge(a, b, **options)
        counts = merge.merge_counts(a, b, **options)
        for name, df in (("merged", merge.canonical_order(merged)), ("conflicts", conflicts), ("counts", counts)):
            df.write.json(f"{out}/{name}")
        return self.spark.read.json(f"{out}/counts")

    def rebase_files(self, local: str, remote: str, out: str, now_ms: int, base: int | None = None, observed: int | None = None, schema: str = RECORDS, **options) -> DataFrame:
        """Rebases a file of records onto the remote delta; the bounds are those of the last run unless **both** are given.

        The state (local base, largest remote time seen, which never falls, time of the run) is kept for the next run.
        """
        if base is None or observed is None:
            base, observed = int(self.get_state("rebase_local_base") or 0), int(self.get_state("rebase_observed_max") or 0)
        a, b = (records.read_records(self.spark, p, schema)[0] for p in (local, remote))
        merged, conflicts, state = merge.rebase(a, b, base, observed, **options)
        for name, df in (("merged", merge.canonical_order(merged)), ("conflicts", conflicts), ("state", state)):
            df.write.json(f"{out}/{name}")
        now = state.first()
        seen = max(int(self.get_state("rebase_observed_max") or 0), now.observed_remote_max)
        self.set_state(rebase_local_base=now.local_base, rebase_observed_max=seen, rebase_at=now_ms)
        return state

    def embed_missing(self, now_ms: int, dim: int = 64, model=None) -> None:
        """Gives a vector to every concept that has markdown and none."""
        wanted = self.concepts.filter(F.col("embedding").isNull())
        made = convert.convert(wanted, "markdown", "vector", dim=dim, model=model)
        if not made.isEmpty():
            self.save(made, now_ms)

    def similarity(self, a: str, b: str, dim: int = 64, model=None) -> DataFrame:
        """The cosine of two texts' vectors."""
        pair = self.spark.createDataFrame([(a, b)], "a string, b string")
        vec = lambda c: convert.text_to_vector(F.col(c), dim, model)
        return pair.select(cosine(vec("a"), vec("b")).alias("similarity"))

    def embed_text(self, texts: DataFrame, column: str, dim: int = 64, model=None) -> DataFrame:
        """The texts with their vectors; blank texts are an error."""
        text = F.when(F.trim(column) == "", F.raise_error(F.lit("text must not be blank")).cast("string")).otherwise(F.col(column))
        return texts.withColumn("embedding", convert.text_to_vector(text, dim, model))

    def import_snapshot(self, documents: DataFrame, column: str, now_ms: int, strict: bool = True) -> DataFrame:
        """Saves the concepts of snapshot documents, each in its order: inserted, updated, skipped, errors.

        Entries of one id are applied one after the other. If not ``strict``, an entry without an id is counted as skipped and named.
        """
        new = records.parse_snapshot(documents, column, strict)
        before = self.concepts.select("id", F.lit(True).alias("old"))
        good = new.filter(F.col("id").isNotNull())
        report = good.select("id").distinct().join(before, "id", "left").agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count("old").alias("updated")).first()
        bad = [f"concept without id at {r.n}" for r in new.filter(F.col("id").isNull()).orderBy("n").limit(100).collect()]
        skipped = new.filter(F.col("id").isNull()).count()
        if not good.isEmpty():
            self.save(good.withColumnRenamed("n", "seq"), now_ms, batch=True)
        return self.spark.createDataFrame([(report.inserted, report.updated, skipped, bad)], "inserted bigint, updated bigint, skipped bigint, errors array<string>")

    def push(self) -> DataFrame:
        """Entries for a key/value repository."""
        return records.to_entries(self.concepts)

    def pull(self, entries: DataFrame, now_ms: int, ts: str | None = None) -> None:
        """Takes over markdown entries that are newer than the concept, and those without a time."""
        times = entries.select(F.get(F.split("key", "/"), F.lit(1)).alias("id"), F.col(ts).alias("ts")) if ts else None
        new = records.from_entries(entries)
        new = new.join(times.groupBy("id").agg(F.max("ts").alias("ts")), "id", "left") if ts else new.withColumn("ts", F.lit(None).cast("long"))
        old = self.concepts.select("id", F.col("updated_at").alias("ms"))
        take = new.join(old, "id", "left").filter(mutate.decide(F.col("ms"), F.col("ts"), "pull") != "skipped")
        if not take.isEmpty():
            self.save(take.select("id", "markdown"), now_ms)

    def archive(self, required: tuple[str, ...] = ()) -> DataFrame:
        """Content and tags of what an archive takes."""
        return records.to_archive(self.concepts, required)

    def tombstones(self, since_ms: int = 0) -> DataFrame:
        """Delete markers for a key/value repository, of the concepts whose last event is a deletion."""
        last = self.events.filter(F.col("ts") > F.timestamp_millis(F.lit(since_ms))).groupBy("id").agg(F.max_by("type", F.struct("ts", "event_id")).alias("type"), F.unix_millis(F.max("ts")).alias("ms"))
        return records.tombstones(last.filter(F.col("type") == "deleted"), F.col("ms"))

    def bridge(self, push=None, archive=None):
        """A stream that hands pushed entries and archive contents of each batch of changes to the given sinks (DataFrame, batch number)."""
        from lorekiln.streaming.changes import fan_out

        def changed(batch: DataFrame) -> DataFrame:
            return self.concepts.join(batch.filter(F.col("type") != "deleted").select("id").distinct(), "id", "left_semi")

        handlers = []
        if push:
            handlers.append(lambda batch, n: push(records.to_entries(changed(batch)), n))
        if archive:
            handlers.append(lambda batch, n: archive(records.to_archive(changed(batch)), n))
        return fan_out(self.event_stream(), *handlers)

    def pull_every(self, entries, interval: str, clock):
        """Pulls at once and then at every tick of ``interval``; ``entries`` gives the repository's entries, ``clock`` the time in milliseconds."""
        self.pull(entries(), clock())
        ticks = self.spark.readStream.format("rate").load()
        return ticks.writeStream.trigger(processingTime=interval).foreachBatch(lambda batch, n: self.pull(entries(), clock()))

    def health(self) -> dict[str, bool]:
        """Whether the tables can be read and the index answers a probe."""
        try:
            self.concepts.limit(1).count()
            self.index.limit(1).count()
            return {"ok": True}
        except Exception:
            return {"ok": False}
