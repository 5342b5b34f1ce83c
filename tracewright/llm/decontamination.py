"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared after lower-casing, with every run of characters
that aren't letters or digits as one space.  An item of m characters leaks
into a text if a stretch of the text is within ``e = floor(rate * m)`` edits of
it.  Such a stretch shares at least ``m - q + 1 - q * e`` of the item's q-grams,
all of them on e + 1 neighbouring diagonals (place in the text minus place in
the item).  The diagonals are cut into bands of 2e + 1 that overlap by e, so
one band holds them all; bands with fewer shared grams than the bound can't
hold a leak.  The others are verified by a banded alignment that is free at
both ends of the text.

Three more rules find less than a whole item.  Every ``STEP``-th window of
``WINDOW`` characters of a longer item (and its last one) is held to the same
bounds as an item, so an excerpt of ``WINDOW + STEP - 1`` characters always
leaks.  In items too short for a window beside a changed word, one word may be
another or missing.  Items under ``MIN_CHARS`` characters must be there word
for word.

The benchmark's size is measured first: items are sent to the executors in
blocks of about ``BLOCK_CHARS`` characters.  One block goes over the texts in one
pass.  More blocks are broadcast one after the other, each in a pass of its own
that writes the rows it hits, and the hits are joined to the texts at the end;
a worker indexes a block once.  Shared grams are expanded ``PAIRS`` at a time, so
memory does not grow with a text's repeats.

Defined results: null and empty texts leak nothing, texts of any length are
searched whole; items that are null or have no letter or digit identify no text
and are ignored; edits are those of the whole item where it leaks as such, else
of its nearest window, else of the item with the changed word; items of equal
normalised text count as the one of least item_id, a null item_id is reported
as null; repeated rows are judged each; a kept column called
``leaks`` is replaced; an empty benchmark flags nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.rows import in_workers, slices, spare
from tracewright.session import stash

Q, RATE, MIN_CHARS = 12, 0.05, 30
WINDOW, STEP = 60, 20
BLOCK_CHARS = 16_000_000
PAIRS = 1 << 20
NO_ID = (1 << 63) - 1  # stands for a null item_id while items are matched
_BITS = 22
_OTHER = re.compile(r"[\W_]+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram: grams of powers of two, then two overlapping ones."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, i = codes.astype(np.uint64) * _M[0], 1, 1
        while 2 * width <= q:
            h = h[:-width] * _M[i % 4] + h[width:]
            width, i = 2 * width, i + 1
        n = len(codes) - q + 1
        h = h[:n] * _M[i % 4] + h[q - width : q - width + n]
        h ^= h >> np.uint64(31)
        h *= _M[1]
        return h ^ (h >> np.uint64(29))


class Items:
    """The benchmark with an index of its grams.

    With ``window`` its units are the items, then the windows of longer ones.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, window: int = 0, step: int = STEP):
        self.q = q
        self.ids = [i for i, _ in items]
        self.text = [t for _, t in items]
        self.codes = [points(t) for t in self.text]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.window, self.step = window, step
        self.windows = np.where(size > window, -(-(size - window) // step) + 1, 0) if window else np.zeros(len(size), np.int64)
        self.base = len(size) + np.cumsum(self.windows) - self.windows  # an item's first window
        owner = np.repeat(np.arange(len(size)), self.windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.item = np.concatenate([np.arange(len(size)), owner])
        self.start = np.concatenate([np.zeros(len(size), np.int64), np.minimum(nth * step, size[owner] - window)])
        self.whole = size
        size = np.concatenate([size, np.full(len(owner), window, np.int64)])
        self.size = size
        self.budget = np.minimum(np.floor(rate * size).astype(np.int64), (size - q) // q)  # so that the bound is 1 at least
        self.bound = size - q + 1 - q * self.budget
        self.least = self.bound[: len(items)].copy()
        np.minimum.at(self.least, owner, self.bound[len(items) :])
        # a changed word of w characters leaves all but w + 2q - 2 grams (the rest beside a window's length holds one)
        self.one_word = np.zeros(len(items), np.int64)
        if window:
            longest = np.array([max(map(len, t.split(" ")), default=0) for t in self.text], np.int64)
            near = self.whole < 2 * (window + step) + longest
            self.one_word[near] = np.maximum(1, self.whole - longest - 2 * q + 2)[near]
            self.least = np.where(near, np.minimum(self.least, self.one_word), self.least)
        hashes = [grams(c, q) for c in self.codes]
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.known, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.known >> np.uint64(64 - _BITS)] = True


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int:
    """Least edits between the item and any stretch of the text whose alignment
    keeps to the diagonals low..high; budget + 1 if there are more."""
    d = np.arange(low, high + 1)
    slope = np.arange(len(d))
    padded = np.concatenate([text, np.full(1, 0xFFFFFFFF, np.uint32)])
    cost = np.zeros(len(d), np.int64)  # the stretch may begin anywhere
    cost[(d < 0) | (d > len(text))] = budget + 1
    for r, c in enumerate(item):
        at = d + r
        inside = (at >= 0) & (at < len(text))
        step = cost + np.where(inside, padded[np.where(inside, at, -1)] != c, budget + 1)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)  # a character of the item is missing
        step[(at + 1 < 0) | (at + 1 > len(text))] = budget + 1
        step = np.minimum.accumulate(step - slope) + slope  # characters of the text are extra
        cost = np.minimum(step, budget + 1)
        if cost.min() > budget:
            return budget + 1
    return int(cost.min())


def changed_word(item: str, text: str) -> int | None:
    """Edits of a stretch of the text that is the item but for one word, another or missing."""
    words = item.split(" ")
    if " ".join(words[: len(words) // 2]) not in text and " ".join(words[len(words) // 2 :]) not in text:
        return None  # one half at least is unchanged
    best = None
    for i in range(len(words)):
        left, right = " ".join(words[:i]), " ".join(words[i + 1 :])
        key = left or right
        at = text.find(key) if key else -1
        while at >= 0:
            end = at + len(key)
            after = end
            if left and right:
                rest = text[end : end + 1] == " "
                space = text.find(" ", end + 1)
                rest = rest and (text.startswith(right, end + 1) or (space > 0 and text.startswith(right, space + 1)))
                after = (space if space > 0 else end) + len(right) + 1
            else:
                rest = True
            if rest:
                a = max(0, at - len(words[0]) - 40)
                stretch = points(text[a : after + len(words[-1]) + 40])
                edits = banded_edits(points(item), stretch, -len(item), len(stretch), len(item))
                best = edits if best is None else min(best, edits)
                break
            at = text.find(key, at + 1)
    return best


class Short:
    """Items that are too short for edits, by their length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.of: dict[int, tuple[np.ndarray, dict[str, int]]] = {}
        for n in sorted({len(t) for _, t in items}):
            same = {t: i for i, t in items if len(t) == n}
            self.of[n] = np.unique(np.concatenate([grams(points(t), n) for t in same])), same

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text the (item id, 0) of the items that are in it as whole words."""
        out: list[set[int]] = [set() for _ in texts]
        plain = [normal(t) for t in texts] if self.of else []
        joined = "\x00".join(plain)
        codes = points(joined)
        begin = np.cumsum([0, *(len(t) + 1 for t in plain)])
        edge = lambda c, inner: c in " \x00" or inner >= "\u2e80"  # noqa: E731  (scripts without spaces have no edges of words)
        for n, (hashes, same) in self.of.items():
            for at in np.flatnonzero(np.isin(grams(codes, n), hashes)).tolist():
                t = joined[at : at + n]
                if t in same and (at == 0 or edge(joined[at - 1], t[0])) and (at + n == len(joined) or edge(joined[at + n], t[-1])):
                    out[int(np.searchsorted(begin, at, side="right")) - 1].add(same[t])
        return [[(i, 0) for i in sorted(x)] for x in out]


def units(items: Items, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shared grams of items as those of the units that hold them: unit, place in it, diagonal."""
    able = total[item] >= items.bound[item]
    out = [(item[able], place[able], diagonal[able])]
    held = items.windows[item] > 0
    item, place, diagonal = item[held], place[held], diagonal[held]
    reach, last = items.window - items.q, items.windows[item] - 1
    for back in range(reach // items.step + 1):
        nth = place // items.step - back
        ok = (nth >= 0) & (nth < last) & (place - nth * items.step <= reach)
        out.append((items.base[item[ok]] + nth[ok], place[ok], diagonal[ok]))
    ok = place >= items.whole[item] - items.window
    out.append((items.base[item[ok]] + last[ok], place[ok], diagonal[ok]))
    unit, place, diagonal = (np.concatenate(x) for x in zip(*out, strict=True))
    return unit, place - items.start[unit], diagonal + items.start[unit]


def totals(items: Items, which: np.ndarray) -> np.ndarray:
    """For each item the grams (slots, with repeats) that a text shares with it."""
    slot, n = np.unique(which, return_counts=True)
    times = items.count[slot]
    entry = np.repeat(items.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.bincount(items.owner[entry], np.repeat(n, times), len(items.ids)).astype(np.int64)


def shared_places(items: Items, where: np.ndarray, which: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Distinct (unit, band, place in the unit) of the grams that a text shares with items that have enough of them."""
    n = items.count[which]
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(n) - n) // PAIRS)) + 1).tolist(), len(which)]
    parts = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        k = n[a:z]
        entry = np.repeat(items.first[which[a:z]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        item, place = items.owner[entry], items.place[entry]
        enough = total[item] >= items.least[item]
        item, place, diagonal = item[enough], place[enough], np.repeat(where[a:z], k)[enough] - place[enough]
        if items.window:
            item, place, diagonal = units(items, item, place, diagonal, total)
        step = items.budget[item] + 1
        band = diagonal // step
        also = diagonal - (band - 1) * step < 2 * items.budget[item] + 1
        rows = np.concatenate([np.stack([item, band, place], 1), np.stack([item[also], band[also] - 1, place[also]], 1)])
        parts.append(distinct_rows(rows))  # each place of the item counts once in a band
    return parts[0] if len(parts) == 1 else distinct_rows(np.concatenate(parts))


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def leaks(texts: list[str | None], items: Items) -> list[list[tuple[int, int]]]:
    """For each text the (item id, edits) of the items that leak into it."""
    found: list[dict[int, int]] = [{} for _ in texts]
    n_items = len(items.ids)
    if not items.ids:
        return [[] for _ in texts]
    plain = [normal(t) for t in texts]
    sizes = np.array([len(t) for t in plain], np.int64)
    codes = points("\x00".join(plain))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    h = grams(codes, items.q)
    at = np.flatnonzero(items.seen[h >> np.uint64(64 - _BITS)])
    slot = np.searchsorted(items.known, h[at])
    slot[slot == len(items.known)] = 0
    same = items.known[slot] == h[at]
    at, slot = at[same], slot[same]
    cuts = np.searchsorted(at, np.stack([begin, begin + sizes]))
    for k in np.flatnonzero(cuts[0] < cuts[1]).tolist():
        where, which = at[cuts[0, k] : cuts[1, k]] - begin[k], slot[cuts[0, k] : cuts[1, k]]
        total = totals(items, which)
        if not (total >= items.least).any():  # fewer in the whole text can't do
            continue
        rows = shared_places(items, where, which, total)
        head = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[: len(rows)])
        shared = np.diff(np.append(head, len(rows)))
        part: dict[int, int] = {}
        for i, b in rows[head[shared >= items.bound[rows[head, 0]]], :2].tolist():
            e, m, of = int(items.budget[i]), int(items.size[i]), int(items.item[i])
            if found[k].get(i) == 0 or (i >= n_items and (of in found[k] or part.get(of) == 0)):  # an item comes before its windows
                continue
            low, high = b * (e + 1) - e, b * (e + 1) + 3 * e
            a, z = max(0, low), min(int(sizes[k]), high + m + e)
            stretch = plain[k][a:z]
            own = slice(int(items.start[i]), int(items.start[i]) + m)
            edits = 0 if items.text[of][own] in stretch else banded_edits(items.codes[of][own], codes[begin[k] + a : begin[k] + z], low - a, high - a, e)
            if edits <= e:
                to = found[k] if i < n_items else part
                to[of] = min(edits, to.get(of, edits))
        found[k] = part | found[k]
        for i in np.flatnonzero((items.one_word > 0) & (total >= np.maximum(1, items.one_word))).tolist():
            if i not in found[k] and (edits := changed_word(items.text[i], plain[k])) is not None:
                found[k][i] = edits
    return [sorted((items.ids[i], k) for i, k in f.items()) for f in found]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks whose size is checked, one at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = total // block_chars + 1
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        best: dict[str, int] = {}
        for r in part.collect():  # block_chars characters, about
            t = normal(r["t"])
            if t:
                best[t] = min(NO_ID if r["i"] is None else r["i"], best.get(t, NO_ID))
        yield sorted((i, t) for t, i in best.items())


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", q: int = Q, rate: float = RATE, window: int = WINDOW, step: int = STEP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns and ``leaks`` array<struct<item_id, edits>>."""
    keep = spare(keep, ["leaks"])
    blocks = item_blocks(benchmark, block_chars=block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(docs.select(*dict.fromkeys([*keep, text])), first, keep, text, q, rate, window, step)
    rows = stash(docs.select(*dict.fromkeys([*keep, text])).withColumn("_rid", F.monotonically_increasing_id()), "texts")
    hits: list[DataFrame] = []
    for block in chain([first, second], blocks):
        hits.append(stash(_search(rows.select("_rid", text), block, ["_rid"], text, q, rate, window, step).select("_rid", F.explode("leaks").alias("l")), "hits"))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    found = every.groupBy("_rid").agg(F.sort_array(F.collect_set("l")).alias("leaks"))  # a text's own items
    none = F.array().cast("array<struct<item_id: bigint, edits: bigint>>")
    return rows.join(found, "_rid", "left").select(*keep, F.coalesce("leaks", none).alias("leaks"))


_indexes: dict[str, tuple[Items, Short]] = {}


def forget() -> None:
    _indexes.clear()


def indexed(name: str, block: list[tuple[int, str]], *settings) -> tuple[Items, Short]:
    """The index of a block, made once in a worker; one block's is held."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Items([x for x in block if len(x[1]) >= MIN_CHARS], *settings), Short([x for x in block if len(x[1]) < MIN_CHARS])
    return _indexes[name]


def _search(docs: DataFrame, block: list[tuple[int, str]], keep: list[str], text: str, q: int, rate: float, window: int, step: int) -> DataFrame:
    """``keep`` columns and ``leaks`` of one block of items."""
    sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # about block_chars characters
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, short = indexed(name, sent.value, q, rate, window, step)
        for b in slices(batches, text, 2 << 20):
            texts = b.column(text).to_pylist()
            out = [sorted(x + y) for x, y in zip(leaks(texts, items), short.found(texts), strict=True)]
            found = pa.array([[{"item_id": None if i == NO_ID else i, "edits": k} for i, k in x] for x in out], pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), found], names=[*keep, "leaks"])

    return in_workers(docs, run, f"{fields}, leaks array<struct<item_id: bigint, edits: bigint>>", "decontamination", forget)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.get("leaks.item_id", F.lit(0)).alias("item_id"), F.get("leaks.edits", F.lit(0)).alias("edits"), F.col("leaks.item_id").alias("item_ids"))
