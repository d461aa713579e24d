"""Filling fixed-capacity containers by best-fit decreasing with a segment tree over remaining capacities.

Best-fit decreasing looks only at sizes, so items are counted by size first (at most ``capacity`` numbers, however many
items), and the plan is made on the driver over classes of equal bins: for each size, largest first, the segment tree
gives the smallest remaining capacity that fits; bins of that class take as many items of this size as they hold, which
is what best fit does one item at a time, since a bin just used stays the tightest that fits. The plan is a list of runs
"items of size s with ranks a..b go, q to a bin, to bins from x"; it is the placement of the sequential algorithm exactly.
Its length depends on the capacity, not on the number of items; past ``BROADCAST_RUNS`` runs it is joined by shuffle.

Items are ranked within their size in two steps over hashed slices (counts per slice, then rows within a slice), so that
a size that a third of all items share is spread over many tasks.

An item larger than the capacity is divided: full containers' worth and a remainder. Nothing else is divided.
Cases: null, empty and blank texts have no size and take no container; repeated rows are items of their own; ids need
only be unique for repeatable ranks; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.stages import write_stage

BROADCAST_RUNS, SLICE_ROWS = 50_000, 20_000
#: Runs of letters, digits and underscores, and runs of other characters that are not white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


class _Tree:
    """Which capacities have open bins; the smallest one of at least s in logarithmic time."""

    def __init__(self, n: int):
        self.n = 1 << max(1, n.bit_length())
        self.has = [False] * (2 * self.n)

    def set(self, i: int, on: bool) -> None:
        i += self.n
        self.has[i] = on
        while i > 1:
            i //= 2
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def at_least(self, s: int) -> int | None:
        i = s + self.n
        if self.has[i]:
            return s
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((size, first rank, rank past the last, first bin, items to a bin) ..., number of bins)."""
    tree, open_, runs, bins = _Tree(capacity + 1), [[] for _ in range(capacity + 1)], [], 0

    def give(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            open_[left].append((first, n))
            tree.set(left, True)

    for s in sorted((s for s in counts if 0 < s <= capacity and counts[s] > 0), reverse=True):
        done, todo = 0, counts[s]
        while todo:
            r = tree.at_least(s)
            if r is None:
                r, q = capacity, capacity // s
                first, n = bins, -(-todo // q)
                bins += n
            else:
                q = r // s
                first, n = open_[r].pop(0)
            full, rest = min(n, todo // q), 0
            if full < n and full * q < todo:
                rest = todo - full * q
            taken = full * q + rest
            runs.append((s, done, done + taken, first, q))
            give(r - q * s, first, full)
            used = full + (rest > 0)
            if rest:
                give(r - rest * s, first + full, 1)
            if used < n:
                open_[r].insert(0, (first + used, n - used))
            if not open_[r]:
                tree.set(r, False)
            done, todo = done + taken, todo - taken
    return runs, bins


def pack(df: DataFrame, item_id: str, size: Column, capacity: int) -> DataFrame:
    """item, pieces, piece, size, bin: each item, or each piece of one larger than ``capacity``, with its container.

    Piece i of a divided item holds its tokens from i * capacity on.
    """
    sized = df.select(F.col(item_id).alias("item"), size.cast("long").alias("total")).filter(F.col("total") > 0)
    n = F.ceil(F.col("total") / capacity).cast("int")
    items = sized.select("item", n.alias("pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"), "total")
    part = F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("total") - (F.col("pieces") - 1).cast("long") * capacity)
    items = write_stage(items.select("item", "pieces", "piece", part.cast("int").alias("size")))
    counts = {r[0]: r[1] for r in items.df.groupBy("size").agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    runs, _ = plan_bins(counts, capacity)
    spark = df.sparkSession
    if not runs:
        return items.df.select("*", F.lit(None).cast("long").alias("bin")).limit(0)
    plan = spark.createDataFrame(runs, "size int, lo bigint, hi bigint, first_bin bigint, per_bin bigint")
    slices = max(16, -(-max(counts.values()) // SLICE_ROWS))
    rows = items.df.withColumn("slice", F.pmod(F.xxhash64("item", "piece"), F.lit(slices)))
    per = rows.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("size", "slice", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "slice").orderBy("item", "piece")) - 1
    ranked = rows.withColumn("inside", inside).join(per, ["size", "slice"]).withColumn("rank", F.col("before") + F.col("inside"))
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan
    placed = ranked.join(plan, "size").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("item", "pieces", "piece", "size", (F.col("first_bin") + F.floor((F.col("rank") - F.col("lo")) / F.col("per_bin"))).alias("bin"))
