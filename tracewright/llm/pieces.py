"""Encoding long texts chunk by chunk with a cache of what was seen before.

A tokenizer that never looks across certain borders gives the same ids for a
text as for its chunks one after another.  Natural text repeats its chunks, so
the library encodes each distinct chunk once, in batches on several threads,
and texts are put together from the cached bytes.  The cache is bounded and
emptied when full.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Hashable

MAX_CHUNKS = 1_000_000


def as_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers (the machines' order is little-endian)."""
    return array("I", ids).tobytes()


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def threaded(on: bool) -> None:
    """Whether the tokenizers library's next batch runs on several threads; it looks each time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


class _Known(dict):
    """Chunks and their ids; a chunk that is not there gets an empty place, filled at the batch's end."""

    def __init__(self):
        self.new: dict[Hashable, bytearray] = {}

    def __missing__(self, chunk: Hashable) -> bytearray:
        self.new[chunk] = self[chunk] = place = bytearray()
        return place


class ChunkCache:
    """Ids of chunks as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[list], list[bytes]], limit: int = MAX_CHUNKS, threads: bool = False):
        self.encode, self.limit, self.threads, self.known = encode, limit, threads, _Known()

    def __call__(self, chunked: list[list[Hashable]]) -> list[bytes]:
        """The ids of texts given as lists of chunks."""
        if len(self.known) > self.limit:
            self.known = _Known()
        known = self.known
        get = known.__getitem__
        found = [list(map(get, chunks)) for chunks in chunked]
        new, known.new = known.new, {}
        chunks = list(new)
        threaded(self.threads)
        try:
            for i in range(0, len(chunks), 20_000):
                part = chunks[i : i + 20_000]
                for chunk, ids in zip(part, self.encode(part), strict=True):
                    new[chunk][:] = ids
                    known[chunk] = ids
        except BaseException:
            self.known = _Known()  # empty places must not pass for ids
            raise
        return [b"".join(x) for x in found]
