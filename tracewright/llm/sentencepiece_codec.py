"""SentencePiece models run by the tokenizers library.

The model file (a protocol buffer) is parsed here; its pieces, scores and
kinds, normaliser settings and trainer flags rebuild a ``Tokenizer``: the
normaliser with the metaspace marker, a unigram model with its scores or a BPE
model whose merges follow from the scores, byte fall-back, and the decoder.
:func:`verify` compares it with the reference implementation.

Large inputs are encoded chunk by chunk (see :mod:`tracewright.llm.pieces`):
a run of markers and what follows it is a chunk, a line feed is another.  This
is exact if no piece has a marker behind another character and none of several
characters holds a line feed, which is checked; else texts are encoded whole.
Distinct chunks go to ``encode_batch`` on ``threads`` threads.

Defined results: null and empty texts have no ids and decode to the empty text.
A text of any length decodes to itself but that every marker character in it
becomes a space.  Repeated rows are encoded each, an empty table gives an empty
one, kept columns called like the results are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.pieces import ChunkCache, as_bytes, threaded
from tracewright.llm.rows import in_workers, slices, spare

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = 1, False
        self.dummy_prefix, self.collapse, self.escape, self.charsmap = True, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, NORMAL)))
            elif field == 2:
                part = dict(_fields(value))
                self.kind, self.byte_fallback = part.get(3, 1), bool(part.get(35, 0))
            elif field == 3:
                part = dict(_fields(value))
                self.charsmap = part.get(2, b"")
                self.dummy_prefix, self.collapse, self.escape = (bool(part.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best score first."""
        known = {p: s for p, s, k in self.pieces if k in (NORMAL, USER, UNUSED)}
        found = []
        for rank, (p, s, k) in enumerate(self.pieces):
            if k in (NORMAL, USER, UNUSED) and len(p) > 1:
                found += [(-s, rank, i, (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        return [pair for *_, pair in sorted(found, key=lambda x: x[:3])]

    def chunkable(self) -> bool:
        several = [p for p, _, k in self.pieces if k in (NORMAL, USER, UNUSED) and len(p) > 1]
        inner = re.compile(f"[^{MARK}]{MARK}")
        return not self.charsmap and not self.collapse and self.escape and not any(inner.search(p) or "\n" in p for p in several)


def build_tokenizer(model: Model):
    """The model as a ``tokenizers.Tokenizer`` with normaliser and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == 2:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == 1:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model(path)
        self.tokenizer = bare = build_tokenizer(self.model)  # one only: every worker holds it
        self.cache = None
        if self.model.chunkable():
            bare.normalizer = None
            self.cache = ChunkCache(lambda chunks: [as_bytes(e.ids) for e in bare.encode_batch_fast(chunks, add_special_tokens=False)], 100_000, threads=True)
            self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        # a piece's bytes; the decoder's steps put together for one piece
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cache is None:
            threaded(True)
            return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        prefix = MARK if self.model.dummy_prefix else ""
        return self.cache([self.chunks(prefix + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids: list[bytes]) -> list[str]:
        get, strip = self.bytes.__getitem__, self.model.dummy_prefix
        out = []
        for x in ids:
            data = b"".join(map(get, np.frombuffer(x, "<u4").tolist()))
            out.append((data[1:] if strip and data[:1] == b" " else data).decode("utf-8", "replace"))
        return out


def verify(path: str, texts: list[str]) -> None:
    """Raise unless ids and decoded texts equal the reference implementation's."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = Codec(path)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        mine = np.frombuffer(ids, "<u4").tolist()
        theirs = other.encode(text)
        if mine != theirs or codec.decode([ids])[0] != other.decode(theirs):
            raise AssertionError(f"ids or text differ for {text[:80]!r}")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget() -> None:
    _codecs.clear()


def encode_documents(docs: DataFrame, model: str, keep: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
    """``keep`` columns, token_ids (optional), n_tokens, ids_crc32,
    decoded_sha256 and round_trip (the decoded text is the text, its markers
    as spaces)."""
    keep = spare(keep, ["token_ids", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    out = ", ".join([*fields, *(["token_ids array<int>"] if with_ids else []), "n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 2 << 20):
            texts = b.column(text).to_pylist()
            ids = codec(model).encode(texts)
            back = codec(model).decode(ids)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            arrays = [b.column(c) for c in keep]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
            arrays += [pa.array(sizes), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()), pa.array([x == (t or "").replace(MARK, " ") for x, t in zip(back, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(["token_ids"] if with_ids else []), "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return in_workers(docs.select(*dict.fromkeys([*keep, text])), run, out, "sentencepiece", forget)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model or default_model(), ["doc_id"], with_ids=False)
