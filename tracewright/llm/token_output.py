"""Token ids as Parquet list columns.

Each document is encoded, closed by an end id and written in ascending doc_id
order to Parquet files: ``token_ids`` is a list of 32-bit ids, beside small
columns (doc_id, n_tokens, part, start_in_part).  The writer's second version
gives dictionary encoding with a fall-back to delta encoding for the integers;
row groups and pages are bounded, and page indexes let a reader fetch the
metadata of all or the tokens of few documents without the rest.

Files are as many as the input's size asks for (``target_bytes`` of it each, by
the optimiser's statistics of the scan).  The range sort is by doc_id and a hash
of the text, so that rows of one doc_id may lie in several files.

Defined results: null and empty texts have the end id only; null doc_ids come
first, rows of equal doc_id follow by a hash of the text and the text; repeated
rows are written each; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import codecs
import gc
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.pieces import ChunkCache, as_bytes, byte_alphabet, threaded
from tracewright.llm.rows import in_workers, slices

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a dictionary doesn't pay
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.truncate.length": "64",
    "compression": "snappy",
}
SCHEMA = "doc_id bigint, n_tokens bigint, part int, start_in_part bigint, token_ids array<int>"
_caches: dict[str, ChunkCache | None] = {}


#: A lower-case word of Latin letters, with a run of ASCII marks behind it (no apostrophe).
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-^`{-~]*)")
#: A comma or full stop behind a letter below U+0180.
_MARK = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])|(?<=[\xc4\xc5][\x80-\xbf]))([,.])(?=[ \n])")
#: One that may be one piece with the mark before it; where there is none, plain replacements set all of them apart.
_JOINED = re.compile(rb"[,.](?=[ \n])(?:(?<=[!-/:-@\[-`{-~].)|(?<=\xc2[\x80-\xbf].)|(?<=\xc3[\x97\xb7].)|(?<=\xcc[\x80-\xbf].))", re.DOTALL)
#: Bytes that begin characters from U+0180 on; below, texts are composed and lower case is plain.
_FAR = bytes(range(0xC6, 0x100))


#: What a file must say for its texts to be cut at white space and their plain words lower-cased and encoded by themselves.
_STEPS = {"NFC", "Lowercase"}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANKS = re.compile(r"\\s\+")


def _steps(part: dict | None, key: str) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer, one or a sequence of them."""
    return [] if part is None else part[key] if part.get("type") == "Sequence" else [part]


def word_tokenizer(path: str) -> bool:
    """Whether a tokenizer file is of the kind :func:`word_cache` knows: texts lower-cased and composed, white space
    collapsed, words split off and dropped blanks between them, byte-level pieces, ``</w>`` at a word's end."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model = settings["model"]
    if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
        return False
    if any("<|" not in t["content"] or len(t["content"].split()) != 1 or t["normalized"] for t in settings["added_tokens"]):
        return False  # the short way looks out for these strings by how they begin
    names = set()
    for step in _steps(settings["normalizer"], "normalizers"):
        if step["type"] == "Replace":
            if not _BLANKS.fullmatch(step["pattern"].get("Regex", "")) or step["content"] != " ":
                return False
        elif step["type"] not in _STEPS:
            return False
        names.add(step["type"])
    before = _steps(settings["pre_tokenizer"], "pretokenizers")
    kinds = [s["type"] for s in before]
    splits = kinds == ["Split", "ByteLevel"] and before[0]["behavior"] == "Removed" and before[0]["invert"] is True and not before[1]["add_prefix_space"]
    return "Lowercase" in names and splits and WORD_PATTERN == before[0]["pattern"].get("Regex")


def word_cache(path: str) -> ChunkCache | None:
    """None if the file is no :func:`word_tokenizer`; else a tokenizer whose pre-tokenizer drops white space: ASCII white space is
    a border of chunks, as is the end of a plain word before marks.  Plain
    words need neither the normaliser nor the pre-tokenizer's pattern; many are
    encoded as one text and told apart by their closing pieces; their bytes are
    put as the byte-level characters beforehand, many words at once."""
    if path not in _caches and not word_tokenizer(path):
        _caches[path] = None
    if path not in _caches:
        from tokenizers import Tokenizer, pre_tokenizers

        whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for each in (whole, plain):  # a file's own limit would cut texts
            each.no_padding()
            each.no_truncation()
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = {b: c for c, b in byte_alphabet().items()} | {32: " "}
        byte_level = "".join(letters[b] for b in range(256))
        closing = np.zeros(whole.get_vocab_size(), bool)
        closing[[i for piece, i in whole.get_vocab().items() if piece.endswith("</w>")]] = True
        words: dict[bytes, bytes] = {}
        match = _PLAIN.fullmatch

        def encode_words(new: list[bytes]) -> None:
            parts = [new[i : i + 500] for i in range(0, len(new), 500)]
            texts = [codecs.charmap_decode(b" ".join(p), "strict", byte_level)[0] for p in parts]
            for part, e in zip(parts, plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = e.ids
                raw = as_bytes(ids)
                ends = (4 * np.flatnonzero(closing[ids]) + 4).tolist()
                words.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

        def encode(chunks: list[bytes]) -> list[bytes]:
            if len(words) > 100_000:
                words.clear()
            # most chunks are ASCII words; the pattern looks at the others only
            mixed = {c: m.groups() if (m := match(c)) else (b"", c) for c in chunks if not (c.isalpha() and c.islower())}
            stems = {w for w, _ in mixed.values() if w}
            encode_words(list(stems.union(c for c in chunks if c not in mixed).difference(words)))
            other = list({x for _, x in mixed.values() if x})
            rest = dict(zip(other, (as_bytes(e.ids) for e in whole.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)), strict=True))
            rest[b""] = words[b""] = b""
            joined = {c: words[w] + rest[x] for c, (w, x) in mixed.items()}
            return [joined[c] if c in joined else words[c] for c in chunks]

        _caches[path] = ChunkCache(encode, 400_000)  # no threads: a task has one core, and idle threads would spin
    return _caches[path]


def _chunks(text: str | None) -> list[bytes]:
    """The tokenizer lower-cases anyway; where that is plain it is done at once,
    so that more chunks are alike.  Special strings keep their case."""
    data = (text or "").encode("utf-8", "replace")
    if b"<|" not in data and len(data) == len(data.translate(None, _FAR)):
        # a mark between a letter and white space is a piece of its own: as a chunk of its own it is known already
        data = text.lower().encode() if text else b""
        if _JOINED.search(data):
            data = _MARK.sub(rb" \1", data)
        else:
            data = data.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")
    return data.split()


def forget() -> None:
    """Drop this worker's tokenizers and what they know."""
    _caches.clear()
    _whole.clear()


_whole: dict[str, Callable[[list[str]], list[bytes]]] = {}


def whole_texts(path: str) -> Callable[[list[str]], list[bytes]]:
    """Any other tokenizer file: the library encodes the texts as they are."""
    if path not in _whole:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_padding()
        made.no_truncation()
        _whole[path] = lambda texts: [as_bytes(e.ids) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    return _whole[path]


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    cache = word_cache(path)
    if cache is None:
        threaded(False)
        return whole_texts(path)([t or "" for t in texts])
    return cache([_chunks(t) for t in texts])


def file_count(docs: DataFrame, target_bytes: int) -> int:
    """Files of ``target_bytes`` of the scanned input each, at least one a core."""
    scanned = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-scanned // target_bytes))


def write_tokens(docs: DataFrame, path: str, encode: Callable[[list[str | None]], list[bytes]], end_id: int, partitions: int | None = None, target_bytes: int = 16 << 20) -> None:
    """Write ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""
    files = partitions or file_count(docs, target_bytes)
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    close = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        gc.disable()  # a batch makes many small objects and no cycles
        try:
            for b in slices(batches, "text"):
                data = [x + close for x in encode(b.column("text").to_pylist())]
                sizes = np.array([len(x) // 4 for x in data], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(np.full(len(data), part, np.int32)), pa.array(start + offsets[:-1]), tokens], names=["doc_id", "n_tokens", "part", "start_in_part", "token_ids"])
                start += int(offsets[-1])
        finally:
            gc.enable()

    in_workers(ordered, run, SCHEMA, "token_output", forget).write.options(**WRITER).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before) without tokens."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens", "part", "start_in_part")
    return with_start(rows, rows)


def with_start(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """``start`` from ``start_in_part`` and the totals of all parts before."""
    parts = metadata.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file's partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("part").alias("_part"), before.alias("_before"))
    return rows.join(F.broadcast(offsets), F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_part", "_before")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Tokens of all or of some documents; the filter reaches the page index."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens (recounted) and crc32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("token_ids")
            offsets = tokens.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * int(i) : 4 * int(j)]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("start_in_part"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    found = rows.select("doc_id", "part", "start_in_part", "token_ids")
    return in_workers(found, run, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint", "token_digests")


def op5_token_output(spark, sf_dir: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    from tracewright.session import fresh_path

    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, lambda texts: encode_texts(tokenizer, texts), end_id)
    starts = with_start(token_digests(read_tokens(spark, path)), read_metadata(spark, path))
    return starts.select("doc_id", "start", "n_tokens", "ids_crc32")
