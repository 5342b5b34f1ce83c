"""Keyed state that expires by itself.

Counters and caches are stateful processors (``transformWithState``) on
a RocksDB store: a key's state is a few values, however many events it had, and
goes when its lifetime is over, so the store holds the keys of the last lifetime
only.  Time is that of the events: every event sets a timer for the end of its
key's lifetime, which fires when the watermark has passed it and clears the key.
Rows that come later than the watermark allows are dropped, as in any stream.

Each micro-batch hands a processor the rows of a key as an iterator.  Rows of
one key and batch are taken in the order of ``ts`` and the event's number, which
a sort of the batch's rows of that key gives; a batch is bounded by the source
(``maxFilesPerTrigger``).  A key costs a few calls of the state server however
many rows it has, so calls are what a processor saves: it asks for its state
once, writes it once, and touches its timer only where the end has moved.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk with changelog checkpoints, so that memory does not bound the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)


def in_order(rows: Iterator[Row]) -> list[tuple[int, int, int]]:
    """A key's rows of one micro-batch by time and number: milliseconds, number and day."""
    return [(us // 1000, number, day) for us, number, day in sorted((r.us, r.number, r.day) for r in rows)]


class _Expiring(StatefulProcessor):
    """A key's state goes ``lifetime_ms`` after the event that began it (or last refreshed it)."""

    lifetime_ms: int
    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def until(self, end_ms: int, before: int | None) -> None:
        """Exactly one timer a key: that of its present end, which was ``before``."""
        if end_ms != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(end_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class Limiter(_Expiring):
    """At most ``limit`` requests of an identity in a window that begins with its first request and lasts ``lifetime_ms``."""

    fields = "began bigint, used int"

    def __init__(self, limit: int, lifetime_ms: int):
        self.limit, self.lifetime_ms = limit, lifetime_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        began, used = self.state.get() or (None, 0)
        before = None if began is None else began + self.lifetime_ms
        for ms, number, _ in in_order(rows):
            if began is None or ms >= began + self.lifetime_ms:
                began, used = ms, 0
            used += 1
            yield Row(key=key[0], number=number, remaining=max(0, self.limit - used), allowed=used <= self.limit)
        self.state.update((began, used))
        self.until(began + self.lifetime_ms, before)


class DayLimiter(_Expiring):
    """At most ``limit`` requests of an identity and calendar day.

    An identity's state is the counters of the days that rows may still come
    for: days that end ``late_ms`` or more before its last request are over, as
    the watermark has passed them.
    """

    fields = "days array<int>, used array<int>, last bigint"

    def __init__(self, limit: int, late_ms: int):
        self.limit, self.late_ms = limit, late_ms
        #: Beyond a day's last request: no calendar day is longer than this.
        self.lifetime_ms = 26 * 3_600_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        days, counts, last = self.state.get() or ((), (), None)
        before = None if last is None else last + self.lifetime_ms
        used = dict(zip(days, counts, strict=True))
        for ms, number, day in in_order(rows):
            used[day] = used.get(day, 0) + 1
            last = ms if last is None else max(last, ms)
            yield Row(key=key[0], number=number, remaining=max(0, self.limit - used[day]), allowed=used[day] <= self.limit)
        newest = max(used)
        # a day is over a day later, or two where the clocks change
        alive = sorted(d for d in used if (newest - d - 2) * 86_400_000 <= self.late_ms)
        self.state.update((alive, [used[d] for d in alive], last))
        self.until(last + self.lifetime_ms, before)


class ReadThrough(_Expiring):
    """A value is fetched where none is held, or the one held is older than ``lifetime_ms``; reading it does not refresh it."""

    fields = "stored bigint, number bigint"

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        stored, source = self.state.get() or (None, None)
        before = None if stored is None else stored + self.lifetime_ms
        for ms, number, _ in in_order(rows):
            hit = stored is not None and ms < stored + self.lifetime_ms
            if not hit:
                stored, source = ms, number
            yield Row(key=key[0], number=number, hit=hit, source=source)
        self.state.update((stored, source))
        self.until(stored + self.lifetime_ms, before)


def _run(events: DataFrame, lateness: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    use_rocksdb(events.sparkSession)
    # integers of Spark's making: days of the session's time zone, and no time zone inside the processor
    times = [F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unix_date(F.to_date("ts")).alias("day")]
    rows = events.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "number", "ts", *times).withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithState(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def limited(events: DataFrame, limit: int = 3, lifetime_ms: int = 86_400_000, lateness: str = "1 hour") -> DataFrame:
    """A stream of requests (key, number, ts) with what remains after each, and whether it passed.

    Requests without key or time are no one's and are left out.
    """
    kind = events.schema["key"].dataType.simpleString()
    return _run(events, lateness, Limiter(limit, lifetime_ms), f"key {kind}, number bigint, remaining int, allowed boolean")


def limited_by_day(events: DataFrame, limit: int = 3, late_hours: int = 1) -> DataFrame:
    """The same with counters of calendar days (of the session's time zone) in place of windows."""
    kind = events.schema["key"].dataType.simpleString()
    return _run(events, f"{late_hours} hours", DayLimiter(limit, late_hours * 3_600_000), f"key {kind}, number bigint, remaining int, allowed boolean")


def read_through(events: DataFrame, lifetime_ms: int = 3_600_000, lateness: str = "1 hour") -> DataFrame:
    """A stream of look-ups (key, number, ts): whether each found a value that is still alive, and the look-up that stored it."""
    kind = events.schema["key"].dataType.simpleString()
    return _run(events, lateness, ReadThrough(lifetime_ms), f"key {kind}, number bigint, hit boolean, source bigint")
