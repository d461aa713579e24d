"""Chunks and commits: cutting payloads, putting them together with checks, idempotent writes, finalizing, paging, access."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekiln.functions.hashing import CHUNK_LIMIT, bundle_id, chunk_count, commit_id, idempotency_key, sha256


MOST_RECORDS = 50_000


def in_parts(records: DataFrame, group: str, most: int = MOST_RECORDS) -> DataFrame:
    """Adds ``part``: a group of more than ``most`` records is spread over parts of about that size, by a hash of the id.

    What is put into one document is thus bounded however large a group is.
    """
    n = records.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts")).withColumnRenamed(group, "g")
    rows = records.join(n, F.col(group).eqNullSafe(F.col("g"))).drop("g")
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")


def dedupe_key(records: DataFrame, group: str, compress: str = "none", encrypted: bool = False) -> DataFrame:
    """group, part, records, dedupe_key, bundle_id, commit_id: a key of the contents alone, from the hashes in canonical order.

    One key per group however large, or per part where the records have a column ``part``: the sorted hashes run through one
    digest, so no group is held in memory.
    """
    rows = records if "part" in records.columns else records.withColumn("part", F.lit(0))
    rows = rows.select(F.col(group).alias("g"), "part", "ts", "id", "hash")
    end = f":{compress}:{str(encrypted).lower()}".encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sha, first = None, 0, None, True

        def done() -> pa.RecordBatch:
            sha.update(end)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], kind), pa.array([at[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], ["g", "part", "records", "dedupe_key"])

        for b in batches:
            kind = b.schema.field("g").type
            for g, part, h in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g", "part", "hash"))):
                if (g, part) != at:
                    if at is not None:
                        yield done()
                    at, n, sha, first = (g, part), 0, hashlib.sha256(), True
                n += 1
                if h is not None:
                    sha.update(h.encode() if first else b":" + h.encode())
                    first = False
        if at is not None:
            yield done()

    ordered = rows.repartition("g", "part").sortWithinPartitions("g", "part", "ts", "id", "hash")
    keys = ordered.mapInArrow(digest, f"g {rows.schema['g'].dataType.simpleString()}, part int, records bigint, dedupe_key string").withColumnRenamed("g", group)
    return keys.select(group, "part", "records", "dedupe_key", bundle_id(F.col("dedupe_key")).alias("bundle_id"), commit_id(F.col("dedupe_key")).alias("commit_id"))


def chunk(payloads: DataFrame, key: str, payload: Column, size: int = CHUNK_LIMIT) -> DataFrame:
    """key, chunk_index, chunk_count, payload, chunk_hash; an empty payload is one empty chunk. ``payload``: text or bytes."""
    if not 1 <= size <= CHUNK_LIMIT:
        raise ValueError(f"size must be 1..{CHUNK_LIMIT}")
    n = chunk_count(F.length("p"), size)
    rows = payloads.select(key, payload.alias("p")).filter(F.col("p").isNotNull()).withColumn("chunk_count", n)
    rows = rows.select(key, "chunk_count", "p", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk_index"))
    piece = F.substring("p", F.col("chunk_index") * size + 1, F.lit(size))
    return rows.select(key, "chunk_index", "chunk_count", piece.alias("payload")).withColumn("chunk_hash", sha256(F.col("payload")))


def first_puts(chunks: DataFrame) -> DataFrame:
    """Of each idempotency key the write that came first; the rest are repeats."""
    rest = [c for c in chunks.columns if c != "idempotency_key"]
    order = F.struct("created_at_ms", "bundle_id", "chunk_index", "chunk_hash")
    return chunks.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), order).alias("m")).select("idempotency_key", "m.*")


def put_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming chunks that are new to the store."""
    return first_puts(incoming).join(stored.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def contiguity(chunks: DataFrame, key: str) -> DataFrame:
    """key, stored, expected, contiguous: whether the distinct indices are 0..n-1 and all chunks agree on n."""
    g = chunks.groupBy(key).agg(F.countDistinct("chunk_index").alias("stored"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.min("chunk_count").alias("expected"), F.max("chunk_count").alias("most"))
    ok = (F.col("lo") == 0) & (F.col("hi") == F.col("stored") - 1) & (F.col("stored") == F.col("expected")) & (F.col("expected") == F.col("most"))
    return g.select(key, "stored", "expected", F.coalesce(ok, F.lit(False)).alias("contiguous"))


@F.pandas_udf(T.BinaryType())
def _joined(parts: pd.Series) -> pd.Series:
    """Parts put together at once; each byte is copied once, however many parts there are."""
    return parts.map(lambda p: b"".join(bytes(x) for x in p))


def reassemble(chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, payload, bytes), (key, error)): payloads put together in order, and what is wrong with the others.

    Errors: inconsistent count, missing index, changed content (a chunk's hash is not that of its bytes).
    """
    one = chunks.groupBy(key, "chunk_index").agg(F.min_by(F.struct("chunk_count", "chunk_hash", "payload"), F.struct("created_at_ms", "chunk_hash")).alias("m")).select(key, "chunk_index", "m.*")
    one = one.withColumn("fits", F.coalesce(sha256(F.col("payload")) == F.col("chunk_hash"), F.lit(False)))
    g = one.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_count").alias("lo"), F.max("chunk_count").alias("hi"), F.max("chunk_index").alias("top"), F.min("chunk_index").alias("bottom"), F.bool_and("fits").alias("fits"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "payload"))).alias("parts"),
    )
    error = F.when(F.col("lo") != F.col("hi"), "inconsistent chunk count").when((F.col("n") != F.col("hi")) | (F.col("bottom") != 0) | (F.col("top") != F.col("n") - 1), "missing chunk").when(~F.col("fits"), "hash mismatch")
    g = g.withColumn("error", error)
    ok = g.filter(F.col("error").isNull()).select(key, _joined(F.col("parts.payload")).alias("payload"))
    return ok.withColumn("bytes", F.octet_length("payload")), g.filter(F.col("error").isNotNull()).select(key, "error")


def finalize(requests: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """commit_id, outcome, duplicate_of for requests (commit_id, dedupe_key, expected_chunks).

    In this order: a known dedupe key is not accepted and names the commit that has it; a known commit id, a count other
    than the stored one and a gap are errors; else accepted.
    """
    by_key = known.groupBy("dedupe_key").agg(F.min("commit_id").alias("duplicate_of"))
    ids = known.select("commit_id", F.lit(True).alias("exists")).distinct()
    held = contiguity(chunks, "commit_id")
    r = requests.join(by_key, "dedupe_key", "left").join(ids, "commit_id", "left").join(held, "commit_id", "left")
    stored = F.coalesce("stored", F.lit(0))
    outcome = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("exists"), "commit exists").when(stored != F.col("expected_chunks"), "count mismatch").when(~F.coalesce("contiguous", F.lit(False)), "gap").otherwise("accepted")
    return r.select("commit_id", outcome.alias("outcome"), "duplicate_of")


def list_commits(commits: DataFrame, since_ms: int = 0, cursor: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """A page of commits later than a time by (created_at_ms, commit_id), after the commit that ``cursor`` (one row,
    commit_id) names; an unknown cursor starts from the beginning. A keyset page: no rows are counted off."""
    rows = commits.filter(F.col("created_at_ms") > since_ms)
    if cursor is not None:
        at = rows.join(cursor.select(F.col("commit_id").alias("c")), F.col("commit_id") == F.col("c")).agg(F.max(F.struct("created_at_ms", F.col("commit_id").alias("commit_id"))).alias("at"))
        rows = rows.join(F.broadcast(at)).filter(F.col("at").isNull() | (F.struct("created_at_ms", "commit_id") > F.col("at"))).drop("at")
    return rows.orderBy("created_at_ms", "commit_id").limit(limit)


def next_cursor(commits: DataFrame, limit: int = 50, **options) -> str | None:
    """The commit a next page begins after; None if a page of this length is the last."""
    page = [r.commit_id for r in list_commits(commits, limit=limit + 1, **options).select("commit_id").collect()]
    return page[limit - 1] if len(page) > limit else None


def next_offset(chunks: DataFrame, commit: DataFrame, offset: int = 0, limit: int = 50) -> int | None:
    """Where the next page of a commit's chunks begins; None after the last."""
    more = chunks_page(chunks, commit, offset + limit, 1).limit(1).count()
    return offset + limit if more else None


def chunks_page(chunks: DataFrame, commit: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    own = first_puts(chunks).join(F.broadcast(commit.select("commit_id")), "commit_id", "left_semi")
    return own.orderBy("chunk_index", "idempotency_key").offset(offset).limit(limit)


def writable(requests: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that may write, (request columns, error)): a principal may write as owner or with a grant ``write``.

    ``requests`` have a column ``principal``; reading without a grant gives nothing, writing without one is an error.
    """
    may = grants.filter(F.col("role").isin("owner", "write")).select("principal").distinct()
    ok = requests.join(may, "principal", "left_semi")
    return ok, requests.join(may, "principal", "left_anti").withColumn("error", F.lit("unauthorized"))


def change_grants(grants: DataFrame, caller: str, role: str, principals: list[str]) -> DataFrame:
    """The grants with the list of a role (write or read) replaced; only an owner may do this, for others nothing changes."""
    if role not in ("write", "read"):
        raise ValueError("role must be write or read")
    owner = grants.filter((F.col("principal") == caller) & (F.col("role") == "owner")).limit(1).select(F.lit(True).alias("owner"))
    new = grants.sparkSession.createDataFrame([(p, None, role) for p in dict.fromkeys(principals)], "principal string, author string, role string")
    may = lambda df: df.join(F.broadcast(owner), F.lit(True), "left")
    kept = may(grants).filter(F.col("owner").isNull() | (F.col("role") != role)).drop("owner")
    return kept.unionByName(may(new).filter(F.col("owner")).drop("owner"))


def visible(commits: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Commits that a principal may read: all for an owner, else those of authors who granted reading; others see nothing.

    ``grants``: principal, author (whose commits a reader may see; null for all), role (owner, write, read).
    """
    mine = grants.filter(F.col("principal") == principal)
    every = mine.filter((F.col("role") == "owner") | ((F.col("role") == "read") & F.col("author").isNull())).limit(1).select(F.lit(True).alias("every"))
    some = mine.filter(F.col("role") == "read").select(F.col("author").alias("author_principal")).distinct()
    rows = commits.join(F.broadcast(every), F.lit(True), "left").join(some.withColumn("granted", F.lit(True)), "author_principal", "left")
    return rows.filter(F.coalesce("every", "granted", F.lit(False))).drop("every", "granted")


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("derived_key", idempotency_key(F.col("commit_id"), F.col("chunk_index"), F.col("chunk_hash")))

