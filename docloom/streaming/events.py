"""File events: routing and debouncing, the same in batches and in streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as T
from docloom.operators.filters import DENIED_FOLDERS, visible

GAP = "2 seconds"
EVENT = "event_id long, ts timestamp, path string, op string, old_path string, is_dir boolean"


def file_events(events: DataFrame) -> DataFrame:
    """The test events as file events (event_id, ts, path, op, old_path, is_dir)."""
    op = (
        F.when(F.col("event_type") == "click", "create").when(F.col("event_type").isin("view", "purchase"), "write")
        .when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "rename")
    )
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/f"))
    return events.select("event_id", "ts", path.alias("path"), op.alias("op"), F.lit(None).cast("string").alias("old_path"), (F.col("event_id") % 10 == 0).alias("is_dir"))


def moving_events(events: DataFrame) -> DataFrame:
    """The same with old paths at every third event, and every seventh in a folder of a denied name."""
    base = file_events(events)
    old = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/old"), F.col("path")))
    return base.withColumns({"path": F.when(F.col("event_id") % 7 == 0, F.concat("path", F.lit("/Node_Modules"))).otherwise(F.col("path")), "old_path": old})


def route(events: DataFrame) -> DataFrame:
    """With the action that each event asks for; an unknown operation is dropped.

    A created folder that may be entered is scanned, even if it has an old path, and its write events are dropped; for
    folders of denied names, as for files, a creation with an old path is a rename, then writes are debounced."""
    op = F.col("op")
    name = F.lower(T.basename(F.col("path")))
    folder = F.coalesce("is_dir", F.lit(False)) & F.coalesce(visible(name) & ~name.isin(*DENIED_FOLDERS), F.lit(False))
    action = (
        F.when(folder & (op == "create"), "scan").when(folder & (op == "write"), "drop").when((op == "create") & (F.coalesce("old_path", F.lit("")) != ""), "rename")
        .when(op.isin("create", "write"), "debounce").when(op.isin("remove", "rename"), "soft_delete").otherwise("drop")
    )
    return events.withColumn("action", action)


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the events that a watcher of the disk writes as JSON lines into a shared folder. A batch takes at most
    files_a_batch files: what comes faster waits in the folder, so no event is lost and none overflows."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).json(folder)


def debounce(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(path, first_ts, last_ts, events): bursts of a path's events, each ended by a silence longer than the gap.

    On a stream, give the events a watermark; a burst comes out when the watermark has passed it.
    """
    merged = events.where("path is not null and ts is not null").groupBy("path", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return merged.select("path", "first_ts", "last_ts", "events")


def watch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, lateness: str = "10 seconds", gap: str = GAP) -> StreamingQuery:
    """Run handle(bursts, batch id) on the bursts of a stream of events. Pressure is bounded by the source's own
    options (such as maxFilesPerTrigger), so nothing overflows."""
    routed = route(events.withWatermark("ts", lateness)).where("action = 'debounce'")
    return debounce(routed, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
