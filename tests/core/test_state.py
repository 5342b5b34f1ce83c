"""Keyed state: lifetimes end, restarts go on, and the store holds only what is alive."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from tracewright.session import fresh_path
from tracewright.streaming import keyed
from tracewright.streaming.limits import run_to_table

SCHEMA = "key string, number bigint, ts timestamp"
START = dt.datetime(2024, 1, 1)


def arrivals(seed=0):
    """Three batches; most identities come on one day only; some rows share their time, some lack key or time."""
    rnd = random.Random(seed)
    batches, n = [], 0
    for b in range(3):
        rows = []
        for k in [f"daily{i}" for i in range(4)] + [f"once{b}-{i}" for i in range(20)]:
            for _ in range(rnd.randrange(1, 7)):
                rows.append((k, n, START + dt.timedelta(days=2 * b, minutes=rnd.randrange(0, 1440, 5))))
                n += 1
        rnd.shuffle(rows)
        batches.append(rows + [(None, n, START), ("x", n + 1, None)])
        n += 2
    return batches


def run(spark, batches, judge):
    source, out, checkpoint = (fresh_path(spark, n) for n in ("source", "out", "checkpoint"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{source}/batch={i}")
        found = run_to_table(judge(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)), out, checkpoint, "append")
    return found, checkpoint


def ordered(batches):
    held = defaultdict(list)
    for k, n, ts in (r for rows in batches for r in rows):
        if k is not None and ts is not None:
            held[k].append((ts, n))
    return {k: sorted(v) for k, v in held.items()}


@pytest.mark.parametrize("hours", [6, 24])
def test_limits(spark, hours):
    batches = arrivals()
    got, checkpoint = run(spark, batches, lambda s: keyed.limited(s, 2, hours * 3_600_000, "1 minute"))
    want = {}
    for events in ordered(batches).values():
        began = used = None
        for ts, n in events:
            if began is None or ts >= began + dt.timedelta(hours=hours):
                began, used = ts, 0
            used += 1
            want[n] = (max(0, 2 - used), used <= 2)
    assert {r.number: (r.remaining, r.allowed) for r in got.collect()} == want
    # what is left has not ended at the watermark; identities of earlier days are gone
    left = {r.key.key for r in spark.read.format("statestore").option("stateVarName", "state").load(checkpoint).collect()}
    assert left and all(k.startswith(("daily", "once2-")) for k in left)


def test_cache(spark):
    batches = arrivals(1)
    got, _ = run(spark, batches, lambda s: keyed.read_through(s, 3_600_000, "1 minute"))
    want = {}
    for events in ordered(batches).values():
        stored = source = None
        for ts, n in events:
            hit = stored is not None and ts < stored + dt.timedelta(hours=1)
            if not hit:
                stored, source = ts, n
            want[n] = (hit, source)
    assert {r.number: (r.hit, r.source) for r in got.collect()} == want


def test_empty(spark):
    got, _ = run(spark, [[]], lambda s: keyed.limited(s))
    assert got.collect() == []


def test_limits_by_day(spark):
    """Days are counted apart, late rows with their day, and an identity is one key however many days it has."""
    batches = arrivals(2)
    # within the hour that rows may be late, a day's row comes after one of the next day
    batches.append([("late", 9_000, START + dt.timedelta(days=6, minutes=5)), ("late", 9_001, START + dt.timedelta(days=5, minutes=1439))])
    batches.append([("late", 9_002, START + dt.timedelta(days=5, minutes=1438)), ("late", 9_003, START + dt.timedelta(days=6, minutes=6)), ("late", 9_004, START + dt.timedelta(days=5, minutes=1439))])
    got, checkpoint = run(spark, batches, lambda s: keyed.limited_by_day(s, 2))
    want, used = {}, defaultdict(int)
    for rows in batches:
        for ts, k, n in sorted((ts, k, n) for k, n, ts in rows if k is not None and ts is not None):
            used[k, ts.date()] += 1
            want[n] = (max(0, 2 - used[k, ts.date()]), used[k, ts.date()] <= 2)
    assert {r.number: (r.remaining, r.allowed) for r in got.collect()} == want
    left = [r.key.key for r in spark.read.format("statestore").option("stateVarName", "state").load(checkpoint).collect()]
    assert len(left) == len(set(left)) and "late" in left and not any(k.startswith(("once0", "once1")) for k in left)
