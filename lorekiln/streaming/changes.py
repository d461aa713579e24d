"""Reactions to change events, each as a batch formulation and as a stream.

Events: type (created, updated, deleted), id, ts (timestamp), event_id, embedding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekiln.operators.search import rebuild_index

#: How change events are read out of the event log. Fixed values.
TYPES = {"signup": "created", "purchase": "updated", "click": "updated", "view": "updated", "error": "deleted"}


def change_log(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    return events.select("event_id", "ts", F.col("user_id").alias("id"), kind.alias("type"), "value").filter(F.col("type").isNotNull())


def final_state(changes: DataFrame) -> DataFrame:
    """id, type, ts, event_id, value of the last event of each id that is not deleted."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("type", "ts", "event_id", "value"), F.struct("ts", "event_id")).alias("m"))
    return last.select("id", "m.*").filter(F.col("type") != "deleted")


def apply_to_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index (id, embedding) after a batch of changes: the last event of an id counts, a null vector changes nothing."""
    seen = changes.filter((F.col("type") == "deleted") | F.col("embedding").isNotNull())
    last = seen.groupBy("id").agg(F.max_by(F.struct("type", "embedding"), F.struct("ts", "event_id")).alias("m")).select("id", "m.*")
    kept = index.join(last.filter(F.col("type") == "deleted").select("id"), "id", "left_anti")
    return rebuild_index(kept, last.filter(F.col("type") != "deleted").select("id", "embedding"), "upsert")


def index_sync(stream: DataFrame, read_index: Callable[[], DataFrame], write_index: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Applies every micro-batch to the index; ``processAllAvailable`` of the started query waits for pending events.

    ``write_index`` gets the batch number: writing it with the table makes a repeated batch harmless.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: write_index(apply_to_index(read_index(), batch), n))


def save_counter(changes: DataFrame, threshold: int, group: str | None = None) -> DataFrame:
    """group, snapshot_no, fired_at: a snapshot after every ``threshold`` saves (created or updated); 0 disables.

    Counted within ``group`` (a namespace); without one the whole log is one count. The running number is found in two
    steps, events of each minute and events within the minute, so the log is never sorted in one task.
    """
    rows = changes.filter(F.col("type").isin("created", "updated")).select((F.col(group) if group else F.lit("all")).alias("grp"), "ts", "event_id", F.date_trunc("minute", "ts").alias("minute"))
    if threshold <= 0:
        return rows.limit(0).select("grp", F.lit(0).cast("long").alias("snapshot_no"), F.col("ts").alias("fired_at"))
    per = rows.groupBy("grp", "minute").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("grp").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("grp", "minute").orderBy("ts", "event_id"))
    rows = rows.withColumn("inside", inside).join(per.select("grp", "minute", before.alias("before")), ["grp", "minute"]).withColumn("n", F.col("before") + F.col("inside"))
    return rows.filter(F.col("n") % threshold == 0).select("grp", (F.col("n") / threshold).cast("long").alias("snapshot_no"), F.col("ts").alias("fired_at"))


def save_counter_stream(stream: DataFrame, threshold: int, key: str) -> DataFrame:
    """key, snapshot_no, saves: fires like ``save_counter`` on a stream; the count is kept as state."""

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        before, seen = seen, seen + sum(len(b) for b in batches)
        state.update((seen,))
        fired = range(before // threshold + 1, seen // threshold + 1)
        yield pd.DataFrame({key: [k[0]] * len(fired), "snapshot_no": list(fired), "saves": [n * threshold for n in fired]})

    saves = stream.filter(F.col("type").isin("created", "updated"))
    kind = stream.schema[key].dataType.simpleString()
    return saves.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, snapshot_no long, saves long", "seen long", "append", GroupStateTimeout.NoTimeout)


def debounce(changes: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """id, start, end, events, last_type: one action per run of events of an id that are closer than ``gap``, none if the
    run ends with a deletion. Works on a batch and, with a watermark set, on a stream."""
    w = F.session_window("ts", gap)
    g = changes.groupBy("id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max_by("type", F.struct("ts", "event_id")).alias("last_type"))
    return g.filter(F.col("last_type") != "deleted").select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last_type")


def debounce_stream(stream: DataFrame, gap: str = "5 seconds", late: str = "5 minutes") -> DataFrame:
    return debounce(stream.withWatermark("ts", late), gap)


def once(stream: DataFrame, *keys: str, late: str = "5 minutes") -> DataFrame:
    """Replays are dropped: the first event of each key, within the time that late events may take."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def fan_out(stream: DataFrame, *handlers: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Every handler gets every micro-batch, read once."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for h in handlers:
                h(batch, n)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)
