"""Repeated passages by column-wise construction over many texts.

A byte goes if it is covered by a ``length``-byte string that also starts
anywhere else, in the same or another text, as UTF-8 bytes.

1. Anchors.  Of every string of ``length`` bytes the anchor is the place of
   the least hash of its ``GRAM``-byte grams (the last of equal ones).  Equal
   strings have equal anchor grams at the same offset, so strings meet if they
   are grouped by anchor gram.  Consecutive strings share an anchor and make a
   passage: one row for each anchor, about one in ``length / 2`` bytes.
2. Anchors whose gram occurs once are dropped; nothing else is.
3. Columns.  The passages of a gram are laid under each other, anchor below
   anchor.  In every round one symbol of each passage is inserted: the order of
   the passages by what precedes the column (the collection's transform in
   positional form, where rows of all passages keep their column) is updated by
   a stable sort on the new symbol, and so is the length that neighbours have in
   common, as one more than the least in between.  Columns lie in a sequential
   temporary file that is read once, a column a round.  Where neighbours have
   ``length`` or more in common, strings repeat.
4. Grams of more than ``GROUP`` passages are not brought to one task: their
   strings are counted by a 128-bit hash with partial sums instead.

Rows carry an internal id, the file that holds them and their place in it, which
stays the same whatever happens to executors or splits.  A table that is no
plain read of Parquet files is written first.  Both joins that need the texts
read one shuffle of them.

Defined results: null texts count as empty, texts below ``length`` bytes are
untouched, texts of any length are searched in pieces, repeated rows (with the
same doc_id or not) are texts of their own and so repeat, an empty table stays
empty, columns called like the digests, ``rid`` or ``spans`` are replaced.
With ``keep_first`` the first occurrence of each string, by row, stays.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.rows import in_workers, numbered, slices
from tracewright.session import stash

LENGTH, GRAM, GROUP = 200, 32, 100_000
PIECE = 1 << 20  # bytes of a text that are scanned at once
BATCH_ROWS = 24_000
SALTS = 32
_rng = np.random.RandomState(7)
_BYTE = _rng.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(3) + np.uint64(1)
_STEP = (_rng.randint(0, 1 << 62, 8).astype(np.uint64) * np.uint64(2)) + np.uint64(1)
_POSITION = np.uint64((1 << 25) - 1)


def gram_hashes(flat: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram (a power of two of bytes)."""
    h, width, i = _BYTE[flat], 1, 0
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * _STEP[i] + h[width:]
            width, i = 2 * width, i + 1
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def pieces_of(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text index, first start, bytes) of pieces that hold each start once, in lists of one piece's size at most."""
    most = PIECE + length - 1
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PIECE):
            piece = t[at : at + most]
            if some and size + len(piece) > most:
                yield some
                some, size = [], 0
            some.append((i, at, piece))
            size += len(piece)
    if some:
        yield some


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text index, gram hash, first and last start of the passage, anchor."""
    found = [_anchors(pieces, length, gram) for pieces in pieces_of(texts, length)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5


def _anchors(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(flat, gram)
    window = length - gram + 1
    # least key in each window: upper bits of the hash, then the later place
    if len(h) > int(_POSITION) + 1:
        raise ValueError(f"{len(h)} places do not fit the key")
    key = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64))
    n = len(h) - window + 1
    blocks = -(-len(h) // window)
    padded = np.full(blocks * window, np.uint64(2**64 - 1))
    padded[: len(h)] = key
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (_POSITION - (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & _POSITION)).astype(np.int64)
    starts = np.repeat(begin, np.maximum(0, sizes - length + 1))
    within = np.arange(len(starts)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    s = starts + within
    a = place[s]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(s)) - 1
    owner = np.searchsorted(begin, s[first], side="right") - 1
    row = np.array([i for i, _, _ in pieces])[owner]
    shift = np.array([at for _, at, _ in pieces])[owner] - begin[owner]
    return row, h[a[first]].view(np.int64), s[first] + shift, s[last] + shift, a[first] + shift


def columns(passages: list[bytes], offset: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first start, last start) of runs of repeated strings.

    ``offset``: the anchor's place in each passage; ``group``: ascending numbers
    of the passages' grams.  Starts count from the passage's first byte.
    """
    m, before = len(passages), length - gram
    width = before + length
    sizes = np.array([len(p) for p in passages])
    begin = (before - offset).astype(np.int64)
    end = begin + sizes
    table = np.zeros((m, width), np.uint8)
    for i in range(0, m, 8192):
        some = slice(i, i + 8192)
        flat = np.frombuffer(b"".join(passages[some]), np.uint8)
        n = sizes[some]
        row = np.repeat(np.arange(len(n)), n)
        table[some][row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n - begin[some], n)] = flat
    hit = np.zeros((width - length + 1, m), bool)
    with tempfile.TemporaryFile() as file:
        np.ascontiguousarray(table.T).tofile(file)
        del table
        file.seek(0)
        order = np.arange(m)
        common = np.zeros(m, np.int32)
        number = np.unique(group, return_inverse=True)[1].astype(np.uint16)
        for t in range(width):
            symbol = np.fromfile(file, np.uint8, m).astype(np.uint16)
            symbol[(t < begin) | (t >= end)] = 256  # outside the passage: last in its group, nothing in common
            here = symbol[order]
            by_symbol = np.argsort(here, kind="stable")
            moved = by_symbol[np.argsort(number[order[by_symbol]], kind="stable")]
            order, here = order[moved], here[moved]
            g = number[order]
            same = np.zeros(m, bool)
            same[1:] = (here[1:] == here[:-1]) & (g[1:] == g[:-1]) & (here[1:] < 256)
            k = np.flatnonzero(same)
            fresh = np.zeros(m, np.int32)
            if len(k):
                low, high = moved[k - 1] + 1, moved[k]
                least = common[high]
                far = np.flatnonzero(low < high)
                if len(far):
                    bounds = np.column_stack([low[far], high[far] + 1]).ravel()
                    least[far] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
                fresh[k] = least + 1
            common = fresh
            if t >= length - 1:
                linked = common >= length
                if linked.any():
                    chosen = linked.copy()
                    chosen[:-1] |= linked[1:]
                    if keep_first:
                        heads = np.flatnonzero(~linked)
                        lowest = np.minimum.reduceat(order, heads)
                        chosen &= order != lowest[np.cumsum(~linked) - 1]
                    hit[t - length + 1, order[chosen]] = True
    edges = np.diff(np.pad(hit.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    p, a = np.nonzero(edges == 1)
    _, b = np.nonzero(edges == -1)
    return p, a - begin[p], b - 1 - begin[p]


def _data(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_first: bool = False) -> DataFrame:
    """(rid, spans) with the merged byte ranges array<struct<start, end>> that repeat.

    ``keyed``: rid, text and others.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            row, h, lo, hi, a = anchors_of(_data(b.column("text")), length, gram)
            rid = b.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(h), pa.array(lo), pa.array((hi - lo).astype(np.int32)), pa.array((a - lo).astype(np.int32))], names=["rid", "h", "lo", "more", "off"])

    anchors = stash(in_workers(keyed.select("rid", "text"), find, "rid bigint, h bigint, lo bigint, more int, off int"), "anchors")
    grams = stash(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    found = anchors.join(grams, "h")
    hot = grams.where(F.col("n") > group).limit(1).count() > 0
    of_text = found.groupBy("rid").agg(F.collect_list(F.struct("h", "n", "lo", "more", "off")).alias("found"))  # a text's own anchors
    located = keyed.join(of_text, "rid", "left")  # all columns and all rows, as in the last join: one shuffle of the texts serves both

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            h, rid, lo, off, seg = [], [], [], [], []
            for r, data, items in zip(b.column("rid").to_pylist(), _data(b.column("text")), b.column("found").to_pylist(), strict=True):
                for x in items or ():
                    if x["n"] <= group:
                        h.append(x["h"]), rid.append(r), lo.append(x["lo"]), off.append(x["off"])
                        seg.append(data[x["lo"] : x["lo"] + x["more"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(rid, pa.int64()), pa.array(lo, pa.int64()), pa.array(off, pa.int32()), pa.array(seg, pa.binary())], names=["h", "rid", "lo", "off", "seg"])

    def run(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        rid, lo = t.column("rid").to_numpy(), t.column("lo").to_numpy()
        p, a, b = columns(t.column("seg").to_pylist(), t.column("off").to_numpy(), t.column("h").to_numpy(), length, gram, keep_first)
        return pa.RecordBatch.from_arrays([pa.array(rid[p]), pa.array(lo[p] + a), pa.array(lo[p] + b + length)], names=["rid", "start", "end"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while b.num_rows:
                waiting.append(b.slice(0, BATCH_ROWS))
                b = b.slice(BATCH_ROWS)
                rows += waiting[-1].num_rows
                if rows < BATCH_ROWS:
                    continue
                h = np.concatenate([w.column("h").to_numpy() for w in waiting])
                cuts = np.flatnonzero(h[1:] != h[:-1]) + 1  # whole groups only
                if len(cuts):
                    joined = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    yield run([joined.slice(0, int(cuts[-1]))])
                    waiting, rows = [joined.slice(int(cuts[-1]))], rows - int(cuts[-1])
        if rows:
            yield run(waiting)

    passages = in_workers(located, cut, "h bigint, rid bigint, lo bigint, off int, seg binary")
    spans = in_workers(passages.repartition("h").sortWithinPartitions("h", "rid", "lo"), match, "rid bigint, start bigint, end bigint")
    if hot:

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1 << 20):
                for r, data, items in zip(b.column("rid").to_pylist(), _data(b.column("text")), b.column("found").to_pylist(), strict=True):
                    at = [s for x in items or () if x["n"] > group for s in range(x["lo"], x["lo"] + x["more"] + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(data[s : s + length]) for s in at], pa.binary()), pa.array(np.full(len(at), r)), pa.array(at, pa.int64())], names=["w", "rid", "start"])

        every = stash(in_workers(located, strings, "w binary, rid bigint, start bigint"), "strings")
        again = every.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start")).alias("low")).where("n > 1")
        # a string may hold a third of all rows: its rows are dealt over salts, the few repeated strings to each
        salted = every.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)))
        more = salted.join(again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["w", "salt"])
        if keep_first:
            more = more.where((F.col("rid") != F.col("low.rid")) | (F.col("start") != F.col("low.start")))
        spans = spans.unionByName(more.select("rid", "start", (F.col("start") + length).alias("end")))
    return spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # a text's own spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def inside_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False, group: int = GROUP, scan: bool = False) -> DataFrame:
    """``docs`` with the text rewritten without repeated passages (characters
    stay whole), and the digests n_bytes, n_removed, n_spans, kept_sha256 of the
    exact removal of bytes.  Columns of those names are replaced.  ``scan``
    says that ``docs`` is one read of Parquet files, at most with columns left out."""
    digests = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*digests, "rid", "spans")
    searched = numbered(docs if scan else stash(docs, "texts"))
    searched = searched.withColumnRenamed(text, "text") if text != "text" else searched
    spans = repeated_spans(searched, length, group=group, keep_first=keep_first)
    joined = searched.join(spans, "rid", "left")
    others = [c for c in searched.columns if c not in ("rid", "text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            new, size, removed, count, digest = [], [], [], [], []
            for original, data, found in zip(b.column("text").to_pylist(), _data(b.column("text")), b.column("spans").to_pylist(), strict=True):
                ranges = merged(found)
                rest = kept(data, ranges)
                size.append(len(data)), removed.append(len(data) - len(rest)), count.append(len(ranges))
                digest.append(hashlib.sha256(rest).hexdigest())
                new.append(kept(data, inside_characters(data, ranges)).decode("utf-8", "replace") if ranges else original)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(new, pa.string()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=[*others, "text", *digests])

    kinds = ", ".join(f"`{c}` {searched.schema[c].dataType.simpleString()}" for c in others)
    out = in_workers(joined.select(*others, "text", "spans"), cut, f"{kinds}, text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("text", text) if text != "text" else out


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rewrite(docs, scan=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
