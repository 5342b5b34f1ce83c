"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows are placed on a ring of ``2**cell_bits`` cells by a hash of their key.
Every shard owns ``virtual_nodes`` positions.  A row belongs to the first
virtual node at or after its cell; a shard that is full passes what it can't
take clockwise to the next virtual node of a shard with room.  Capacities are
``n // shards`` rows plus one for the first ``n % shards`` shards, so that the
law ``rows`` holds: counts are at most one apart.

Only the histogram of the ring's cells (``2**cell_bits`` rows at most, whatever
the input) reaches the driver.  It yields a table of pieces, each a range of
ranks inside one cell that goes to one shard at consecutive slots; the table
has at most one piece per cell and per visited shard and is broadcast.  Ranks
are taken in ``2**sub_bits`` parts of each cell, so that a cell of many rows is
not sorted by one task; a part's offset is the number of rows in those before.

Defined results: a null key hashes like any other value, a null text has size
1, texts of any length count whole.  Rows that are equal in all keys lie in one
part of one cell; their order among each other is that of the other columns in
``order`` and else open, as they are alike.  Columns called shard or slot are
replaced.  An empty table stays empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(shards: int, virtual_nodes: int, cells: int) -> list[list[int]]:
    """For every cell, the shards met clockwise from it, each once."""
    points: dict[int, list[int]] = {}
    state = 0x9E3779B97F4A7C15
    for s in range(shards):
        for _ in range(virtual_nodes):
            # splitmix64: a fixed, well-mixed sequence, independent of the platform
            state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
            z = state
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
            points.setdefault((z ^ (z >> 31)) % cells, []).append(s)
    at = sorted(points)
    first = {c: next((i for i, p in enumerate(at) if p >= c), 0) for c in range(cells)}
    walks: dict[int, list[int]] = {}
    for i in range(len(at)):
        seen: dict[int, None] = {}
        for p in at[i:] + at[:i]:
            for s in points[p]:
                seen.setdefault(s)
            if len(seen) == shards:
                break
        walks[i] = list(seen)
    return [walks[first[c]] for c in range(cells)]


def pieces(histogram: dict[int, int], shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first rank)."""
    n = sum(histogram.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    capacity = list(room)
    walks = ring(shards, virtual_nodes, cells)
    out, waiting = [], []
    for c in sorted(histogram):  # at first every shard serves its own keys
        k, s = histogram[c], walks[c][0]
        taken = min(k, room[s])
        if taken:
            out.append((c, 0, taken, s, capacity[s] - room[s]))
            room[s] -= taken
        if taken < k:
            waiting.append((c, taken, k))
    for c, lo, hi in waiting:  # then what overflows goes on clockwise
        for s in walks[c]:
            taken = min(hi - lo, room[s])
            if taken:
                out.append((c, lo, lo + taken, s, capacity[s] - room[s]))
                room[s] -= taken
                lo += taken
            if lo == hi:
                break
    return out


def shard_rows(df: DataFrame, keys: list[str], shards: int = 8, virtual_nodes: int = 64, cell_bits: int = 12, sub_bits: int = 10, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (both under the law ``rows``).

    ``keys`` place a row on the ring; ``order`` (default: the keys) makes the
    order inside a cell definite.  Columns called shard or slot are replaced.
    """
    cells = 1 << cell_bits
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    where = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    # the upper bits choose the cell, the whole hash orders rows inside it
    part = F.shiftrightunsigned("_at", 64 - cell_bits - sub_bits)
    placed = df.withColumn("_at", where).withColumn("_part", part)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.shiftright("_part", sub_bits).cast("int"))
    histogram = {r["_cell"]: r["n"] for r in parts.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}  # at most 2**cell_bits rows
    plan = pieces(histogram, shards, virtual_nodes, cells)
    literal = json.dumps([{"c": c, "lo": lo, "hi": hi, "shard": s, "base": b} for c, lo, hi, s, b in plan])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(literal), "array<struct<c:int,lo:bigint,hi:bigint,shard:int,base:bigint>>")).alias("p")).select(F.col("p.c").alias("_c"), F.col("p.lo").alias("_lo"), F.col("p.hi").alias("_hi"), "p.shard", F.col("p.base").alias("_base"))
    before = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # 2**sub_bits rows at most
    offsets = parts.select(F.col("_part"), F.col("_cell"), F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_at", *[F.col(f"`{k}`") for k in order or keys])) - 1
    ranked = placed.join(offsets, "_part").withColumn("_rank", (F.col("_before") + rank).cast("bigint"))
    hit = (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(table), hit).withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_lo")).drop("_at", "_part", "_before", "_cell", "_c", "_lo", "_hi", "_base", "_rank")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_rows(small, ["doc_id", "text_crc32"], 8, order=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
