"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each of the 64 bits of its shingles' hashes
(XXH64, seed 42), set where over half of the hashes have it.  Fingerprints
link at ``radius`` differing bits or fewer.

Equal fingerprints are merged first.  The distinct ones are cut into tiles by
the population counts of their two halves: a cell is a pair (a, b) of counts,
and a cell with more than ``TILE`` fingerprints is cut into several tiles.  Two
fingerprints within the radius have counts that differ by the radius at most in
sum, so only tile pairs within it meet; each such pair is one group of a
shuffle.  In a group, tiles are cut again into runs sorted by the counts of
their bytes; numpy compares two runs by exclusive-or and bit counts, unless the
counts' bounds already differ beyond the radius.  The comparison is exact.

Only the histogram of the cells (33 x 33 numbers at most) reaches the driver and
is broadcast; which tiles meet follows from it where the rows are.  A group
returns a spanning forest, not all pairs, so that a group of n copies yields
n - 1 rows at most.  Components are found by alternating star contractions on
written tables, each dropped when the next one is there.  Joins on a
fingerprint or node that holds many rows go by broadcast for those few keys.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows and null doc_ids are rows of their own (null never is the
least doc_id unless all of a group are null); texts of any length count whole;
other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.rows import map_texts, spare
from tracewright.session import drop_stash, join_skewed, stash

RADIUS, SHINGLE, TILE, RUN = 4, 4, 262_144, 256
_TILE_BITS = 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    h = np.array([digest(view[i:j], 42) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    keep = spare(keep, ["fp"])
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def fn(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in b.column(text).to_pylist()], np.uint64)
        return {c: b.column(c) for c in keep} | {"fp": pa.array(fps.view(np.int64))}

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, out, fn)


class Forest:
    """Union-find over rows 0..n-1 with whole arrays of links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                self.parent[x] = root
                return root
            root = up

    def union(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.find(x), self.find(y)
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.parent))
        root = self.find(every)
        moved = root != every
        return every[moved], root[moved]


def _runs(fp: np.ndarray, run: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order by the byte counts, runs of it, and the counts' least and most in each run."""
    counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    counts = counts[order]
    cuts = [(i, min(i + run, len(fp))) for i in range(0, len(fp), run)]
    at = [i for i, _ in cuts]
    return order, cuts, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, without right, inside) tiles."""
    inside = right is None
    right = left if inside else right
    forest = Forest(len(left) + (0 if inside else len(right)))
    shift = 0 if inside else len(left)
    lo, lcuts, lmin, lmax = _runs(left, run)
    ro, rcuts, rmin, rmax = _runs(right, run)
    ls, rs = left[lo], right[ro]
    for i, (a, b) in enumerate(lcuts):
        # the least that the counts of any two members of the runs differ
        gap = np.maximum(0, np.maximum(lmin[i] - rmax, rmin - lmax[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if inside and j < i:
                continue
            c, d = rcuts[j]
            near = np.bitwise_count(ls[a:b, None] ^ rs[None, c:d]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                forest.union(lo[a + x], ro[c + y] + shift)
    x, y = forest.links()
    both = left if inside else np.concatenate([left, right])
    return both[x], both[y]


def tiles_in(cells: dict[tuple[int, int], int], cell: tuple[int, int], tile: int) -> int:
    return -(-cells.get(cell, 0) // tile)


def tile_name(a: int, b: int, nth: int) -> int:
    return ((33 * a + b) << _TILE_BITS) | nth


def partners(cells: dict[tuple[int, int], int], cell: tuple[int, int], tile: int, radius: int) -> list[int]:
    """Names of all tiles that may hold a fingerprint within the radius of one in the cell."""
    found = []
    for da in range(-radius, radius + 1):
        for db in range(abs(da) - radius, radius - abs(da) + 1):
            other = (cell[0] + da, cell[1] + db)
            found += [tile_name(*other, i) for i in range(tiles_in(cells, other, tile))]
    return found


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (src, dst) that connect all fingerprints within the radius.

    ``fps`` holds distinct fingerprints in ``fp``, written to a table before.
    """
    half = F.lit(0xFFFFFFFF)
    counted = fps.select("fp", F.bit_count(F.col("fp").bitwiseAND(half)).alias("a"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("b"))
    cells = {(r["a"], r["b"]): r["n"] for r in counted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}  # 1,089 cells at most
    sent = fps.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        meet: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            fp = batch.column(0).to_numpy()
            cell = 64 * batch.column(1).to_numpy().astype(np.int64) + batch.column(2).to_numpy()
            with np.errstate(over="ignore"):
                mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for c in np.unique(cell).tolist():
                a, b = divmod(c, 64)
                here = fp[cell == c]
                nth = (mixed[cell == c] % np.uint64(tiles_in(cells, (a, b), tile))).astype(np.int64)
                if (a, b) not in meet:
                    meet[a, b] = partners(cells, (a, b), tile, radius)
                for i in np.unique(nth).tolist():
                    members, own = here[nth == i], tile_name(a, b, i)
                    for other in meet[a, b]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), min(own, other))), pa.array(np.full(len(members), max(own, other))), pa.array(np.full(len(members), int(own > other), np.int32)), pa.array(members)], names=["left", "right", "side", "fp"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["side"].to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        inside = pdf["left"].iloc[0] == pdf["right"].iloc[0]  # a tile with itself
        x, y = tile_links(left, None if inside else right, radius) if len(left) and (inside or len(right)) else (left[:0], left[:0])
        return pd.DataFrame({"src": x.view(np.int64), "dst": y.view(np.int64)})

    dealt = counted.mapInArrow(deal, "left bigint, right bigint, side int, fp bigint")
    return dealt.groupBy("left", "right").applyInPandas(compare, "src bigint, dst bigint")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of every node in ``edges`` (src, dst); root is the least node.

    Large-star and small-star steps alternate on written tables until the
    edges no longer change.  Each step emits at most as many edges as it reads.
    """

    def normal(e: DataFrame) -> DataFrame:
        return e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()

    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    def lower(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    current = stash(normal(edges), name)
    state = size(current)
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lower(both).select("u", F.least("u", "m").alias("m"), "n")
        # large star: neighbours above a node move to the least of its neighbourhood
        large = join_skewed(both.where("v > u"), low, "u", 2 * state[0], "n").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = stash(normal(large), name)
        # small star: a node's lower neighbours and itself move to the least of them
        least = lower(large)
        moved = join_skewed(large, least, "u", state[0], "n").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        after = stash(normal(moved.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))), name)
        drop_stash(current, large)
        current, before, state = after, state, size(after)
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(fps: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``fps`` (a written table with ``fp``) with component_id, the least doc_id reachable."""
    distinct = stash(fps.groupBy("fp").agg(F.min(doc_id).alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    total, kinds = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    stars = components(links(distinct.select("fp"), radius))
    roots = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    member = stash(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("_members"))
    classes = stash(join_skewed(member, lowest, "root", kinds, "_members").select("fp", "component_id", F.col("n").alias("_copies")), "classes")
    drop_stash(distinct, member)
    return join_skewed(fps, classes, "fp", total, "_copies")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable)."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return grouped(stash(add_fingerprints(named, ["doc_id"]), "fingerprints"), radius=radius)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
