"""What a store, a chunk service and an index must offer, and a chunk service over tables."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from lorekiln.operators import search, store


@runtime_checkable
class Catalog(Protocol):
    """A store of concepts; ``api.Memory`` is one."""

    def bootstrap(self) -> None: ...
    def save(self, changes: DataFrame, now_ms: int, batch: bool = False) -> DataFrame: ...
    def delete(self, ids: DataFrame, now_ms: int = 0) -> None: ...
    def read(self, ids: DataFrame, representations: tuple[str, ...] | None = None) -> DataFrame: ...
    def list(self, **options) -> DataFrame: ...
    def stats(self, by_namespace: bool = False) -> DataFrame: ...
    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame: ...
    def get_state(self, key: str) -> str | None: ...
    def set_state(self, **values: object) -> None: ...


@runtime_checkable
class ChunkService(Protocol):
    """Where bundles go to and come from."""

    def put_chunks(self, chunks: DataFrame) -> int: ...
    def finalize(self, requests: DataFrame) -> DataFrame: ...
    def list_commits(self, since_ms: int = 0, cursor: DataFrame | None = None, limit: int = 50) -> DataFrame: ...
    def chunks_of(self, commit: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame: ...


@runtime_checkable
class IndexService(Protocol):
    def rebuild(self, rows: DataFrame, mode: str) -> int: ...


class TableService:
    """A chunk service and an index over Parquet folders that grow by appending."""

    CHUNKS = "commit_id string, chunk_index int, chunk_count int, payload binary, chunk_hash string, bundle_id string, created_at_ms bigint, idempotency_key string"
    COMMITS = "commit_id string, dedupe_key string, created_at_ms bigint, chunk_count int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._indexed = spark, root.rstrip("/"), 0

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", self.CHUNKS)

    @property
    def commits(self) -> DataFrame:
        return self._table("commits", self.COMMITS)

    def put_chunks(self, chunks: DataFrame) -> int:
        """Stores chunks whose idempotency key is new; how many these were."""
        before = self.chunks.count()
        new = store.put_chunks(self.chunks, chunks)
        new.select(*self.chunks.columns).write.mode("append").parquet(f"{self.root}/chunks")
        return self.chunks.count() - before

    def finalize(self, requests: DataFrame) -> DataFrame:
        """The outcome of each request (commit_id, dedupe_key, expected_chunks, created_at_ms); accepted commits are stored."""
        got = store.finalize(requests.select("commit_id", "dedupe_key", "expected_chunks"), self.commits, self.chunks)
        rows = got.collect()  # one row a request
        done = self.spark.createDataFrame(rows, got.schema)
        ok = requests.join(done.filter("outcome = 'accepted'").select("commit_id"), "commit_id", "left_semi")
        ok.selectExpr("commit_id", "dedupe_key", "created_at_ms", "expected_chunks AS chunk_count").write.mode("append").parquet(f"{self.root}/commits")
        return done

    def list_commits(self, since_ms: int = 0, cursor: DataFrame | None = None, limit: int = 50) -> DataFrame:
        return store.list_commits(self.commits, since_ms, cursor, limit)

    def chunks_of(self, commit: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
        return store.chunks_page(self.chunks, commit, offset, limit)

    def rebuild(self, rows: DataFrame, mode: str) -> int:
        """Replaces or adds to the index (id, embedding); its size."""
        old = self._table(f"index{self._indexed}", "id string, embedding array<float>")
        search.rebuild_index(old, rows, mode).write.parquet(f"{self.root}/index{self._indexed + 1}")
        self._indexed += 1
        return self._table(f"index{self._indexed}", "id string, embedding array<float>").count()


def upload(service: ChunkService, chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Puts the chunks of bundles, then finalizes their commits; what is there already is not written again."""
    service.put_chunks(chunks)
    return service.finalize(requests)


def download(service: ChunkService, commit: DataFrame, page: int = 50) -> DataFrame:
    """All chunks of a commit, page by page."""
    got, offset = service.chunks_of(commit, 0, page), page
    out = got
    while got.count() == page:
        got = service.chunks_of(commit, offset, page)
        out, offset = out.unionByName(got), offset + page
    return out
