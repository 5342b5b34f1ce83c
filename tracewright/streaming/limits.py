"""Streams: progress events, daily limits and caches with a lifetime."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# The order of a scan's states.
STATES = ["queued", "parsing", "taint_analysis", "reasoning", "complete", "failed", "timeout"]


def state_rank(phase: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), phase)


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest phase and progress of each scan; batch or complete-mode stream."""
    last = F.max_by(F.struct("phase", "progress", "message"), F.struct("ts", state_rank(F.col("phase"))))
    return events.groupBy("scan_id").agg(last.alias("_l")).select("scan_id", "_l.*").withColumn("done", F.col("phase").isin("complete", "failed", "timeout"))


def daily_counts(requests: DataFrame, limit: int = 3, lateness: str | None = None) -> DataFrame:
    """Requests of an identity per calendar day, what remains, and whether all passed.

    With ``lateness`` the counts of a stream are kept for that long behind the
    latest event, which is their lifetime.
    """
    rows = requests if lateness is None else requests.withWatermark("ts", lateness)
    counted = rows.groupBy("identity", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("used"))
    return counted.select("identity", F.to_date("w.start").alias("day"), "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"), (F.col("used") <= limit).alias("allowed"))


def read_through(requests: DataFrame, cache: DataFrame, now: Column, lifetime_seconds: int = 3600) -> DataFrame:
    """``requests`` (prompt) with ``cached`` from cache (key, value, stored_at) while it is fresh."""
    fresh = cache.where(F.col("stored_at") >= now - F.make_dt_interval(secs=F.lit(lifetime_seconds))).select(F.col("key").alias("_key"), F.col("value").alias("cached"))
    return requests.withColumn("_key", F.sha2("prompt", 256)).join(fresh, "_key", "left").drop("_key")


# The states that may follow each state.
NEXT = {
    "queued": ["parsing", "failed", "timeout"],
    "parsing": ["taint_analysis", "failed", "timeout"],
    "taint_analysis": ["reasoning", "complete", "failed", "timeout"],
    "reasoning": ["complete", "failed", "timeout"],
    "complete": [], "failed": [], "timeout": [],
}


def transitions(events: DataFrame) -> DataFrame:
    """Events of each scan in order, with the phase before and whether it may be followed by this one."""
    order = Window.partitionBy("scan_id").orderBy("ts", state_rank(F.col("phase")))  # a scan has a handful of events
    rows = events.withColumn("before", F.lag("phase").over(order))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))])
    valid = F.col("before").isNull() | (F.col("before") == F.col("phase")) | F.array_contains(allowed[F.col("before")], F.col("phase"))
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def clone_plan(requests: DataFrame, clones: DataFrame, now: Column, lifetime_seconds: int = 600) -> DataFrame:
    """Repositories asked for, with the folder of a fresh clone, or none: those are to be cloned.

    clones: url, folder, cloned_at.  Of several clones the latest counts.
    """
    fresh = clones.where(F.col("cloned_at") >= now - F.make_dt_interval(secs=F.lit(lifetime_seconds))).groupBy("url").agg(F.max_by("folder", "cloned_at").alias("folder"))
    return requests.join(fresh, "url", "left").withColumn("to_clone", F.col("folder").isNull())


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over what is there; the result is a table in the shared folder.

    Every micro-batch is written under its number, so a repeated batch replaces
    itself; with ``keys`` the latest batch's row of a key counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    fields = T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])
    rows = stream.sparkSession.read.schema(fields).option("recursiveFileLookup", True).parquet(path)
    if not keys:
        return rows.drop("_batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def fan_out(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``sink``; restarts go on where they stopped."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
