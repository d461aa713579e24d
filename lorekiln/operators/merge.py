"""Conflict resolution, merge and rebase of two sets of records, and last-writer-wins.

Records have the columns id, ts (epoch milliseconds), hash, source and, where order matters, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.timing import SKEW_MS, skew_bound
from lorekiln.plans.stages import write_stage

#: Names of policies; the outcomes and reasons in ``resolve`` are fixed values too.
POLICIES = ("updatedAt", "preferLocal", "preferRemote")


def last_by_id(records: DataFrame, *order: str) -> DataFrame:
    """Of each id the record last in the given order. One aggregation, no sort of a group."""
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select("id", "m.*")


def last_writer(records: DataFrame) -> DataFrame:
    """The record of largest (ts, hash); full ties keep the one replayed first."""
    return last_by_id(records.withColumn("first", -F.col("seq")), "ts", "hash", "first").drop("first")


def latest_commit(commits: DataFrame) -> DataFrame:
    return commits.agg(F.max_by(F.struct(*commits.columns), F.struct("created_at_ms", "commit_id")).alias("m")).select("m.*").filter(F.col("commit_id").isNotNull())


def resolve(a: Column, b: Column, policy: str = "updatedAt", prefer: str | None = None, skew_ms: int = SKEW_MS) -> Column:
    """struct(outcome, reason) for structs a (local) and b (remote) of one id; the winner is local unless ``outcome`` is remote.

    For equal hashes the outcome is ``no-conflict``; the later record is kept, the local one in a tie.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    pick = lambda outcome, reason: F.struct(outcome.alias("outcome"), reason.alias("reason"))
    local, remote = F.lit("local"), F.lit("remote")
    same = a["hash"].eqNullSafe(b["hash"])
    out = F.when(same, pick(F.lit("no-conflict"), F.lit("identical-content-hash")))
    if policy == "preferLocal":
        return out.otherwise(pick(local, F.lit("policy-preferLocal")))
    if policy == "preferRemote":
        return out.otherwise(pick(remote, F.lit("policy-preferRemote")))
    apart = F.abs(a["ts"] - b["ts"])
    if prefer is not None:
        out = out.when(apart <= skew_ms, pick(F.lit("local" if prefer == "local" else "remote"), F.concat(F.lit(f"prefer-{prefer}-within-skew (delta="), apart.cast("string"), F.lit("ms)"))))
    by = lambda x, y, reason: pick(F.when(x > y, local).otherwise(remote), reason)
    stamps = F.concat(F.lit("updatedAt (local="), a["ts"].cast("string"), F.lit(", remote="), b["ts"].cast("string"), F.lit(")"))
    out = out.when(a["ts"] != b["ts"], by(a["ts"], b["ts"], stamps)).when(a["hash"] != b["hash"], by(a["hash"], b["hash"], F.lit("contentHash-tiebreak")))
    sa, sb = F.coalesce(a["source"], F.lit("")), F.coalesce(b["source"], F.lit(""))
    return out.when(sa != sb, by(sa, sb, F.lit("source-tiebreak"))).otherwise(pick(local, F.lit("id-tiebreak")))


def align(local: DataFrame, remote: DataFrame, policy: str = "updatedAt", prefer: str | None = None, skew_ms: int = SKEW_MS) -> DataFrame:
    """id, l, r, outcome, reason, winner: both sides by id. Of repeated ids of a side the last (seq) counts.

    Outcomes besides those of ``resolve``: local-only, remote-only.
    """
    side = lambda df, name: last_by_id(df, "seq").select("id", F.struct("ts", "hash", "source").alias(name))
    both = side(local, "l").join(side(remote, "r"), "id", "full_outer")
    one = lambda o: F.struct(F.lit(o).alias("outcome"), F.lit(None).cast("string").alias("reason"))
    got = F.when(F.col("r").isNull(), one("local-only")).when(F.col("l").isNull(), one("remote-only")).otherwise(resolve(F.col("l"), F.col("r"), policy, prefer, skew_ms))
    both = both.withColumn("got", got)
    theirs = (F.col("got.outcome").isin("remote", "remote-only")) | ((F.col("got.outcome") == "no-conflict") & (F.col("r.ts") > F.col("l.ts")))
    return both.select("id", "l", "r", "got.outcome", "got.reason", F.when(theirs, F.col("r")).otherwise(F.col("l")).alias("winner"))


def merge(local: DataFrame, remote: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(merged records in canonical order columns id, ts, hash, source; conflicts incl. no-conflict rows)."""
    got = align(local, remote, **options)
    conflicts = got.filter(F.col("l").isNotNull() & F.col("r").isNotNull()).select("id", "outcome", "reason", "winner")
    return got.select("id", "winner.*"), conflicts


def merge_counts(local: DataFrame, remote: DataFrame, **options) -> DataFrame:
    """local_only, remote_only, conflicts, merged. Rows that are only on one side are counted before repeats of an id are folded."""
    got = align(local, remote, **options)
    o = F.col("outcome")
    ids = lambda df, n: df.groupBy("id").agg(F.count(F.lit(1)).alias(n))
    sizes = got.select("id", "outcome").join(ids(local, "nl"), "id", "left").join(ids(remote, "nr"), "id", "left")
    some = lambda when, n: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).alias
    return sizes.agg(some(o == "local-only", "nl")("local_only"), some(o == "remote-only", "nr")("remote_only"), F.count_if(o.isin("local", "remote")).alias("conflicts"), F.count(F.lit(1)).alias("merged"))


def remote_delta(remote: DataFrame, base: int, observed: int, skew_ms: int = SKEW_MS) -> DataFrame:
    """Remote records later than the skew-safe bound."""
    return remote.filter(F.col("ts") > skew_bound(F.lit(base).cast("long"), F.lit(observed).cast("long"), skew_ms))


def rebase(local: DataFrame, remote: DataFrame, base: int, observed: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, conflicts, state) of the local set and the remote delta; state: local_base, observed_remote_max, delta_rows.

    The observed maximum never falls.
    """
    delta = remote_delta(remote, base, observed, options.get("skew_ms", SKEW_MS))
    merged, conflicts = merge(local, delta, **options)
    top = merged.agg(F.greatest(F.max("ts"), F.lit(0)).alias("local_base"))
    seen = remote.agg(F.greatest(F.max("ts"), F.lit(observed)).alias("observed_remote_max"))
    state = top.join(F.broadcast(seen)).join(F.broadcast(delta.agg(F.count(F.lit(1)).alias("delta_rows"))))
    return merged, conflicts, state


def canonical_order(records: DataFrame, collation: str | None = None) -> DataFrame:
    """By ts, id, hash; binary order, or a collation such as UNICODE."""
    cmp = (lambda c: F.collate(F.col(c), collation)) if collation else F.col
    return records.orderBy("ts", cmp("id"), cmp("hash"))


def canonical_position(records: DataFrame) -> DataFrame:
    """Adds ``position``, from 1, in canonical order (nulls first). Records are cut into ranges of that order, written, counted
    and numbered within their range, so neither the whole nor a span of time is sorted in one task."""
    order = ("ts", "id", "hash")
    ranged = write_stage(records.repartitionByRange(*order).withColumn("range", F.spark_partition_id())).df
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", before.alias("before"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(per), "range").withColumn("position", F.col("before") + F.col("inside")).drop("range", "inside", "before")
