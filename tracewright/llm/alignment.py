"""Alignment of two tokenizers over the same texts.

:func:`tokenise` is the only Python step.  It gives token ids and byte ends of
both tokenizers; all that follows is Spark's higher-order functions: the ends
that both share (``array_intersect``) cut the tokens into groups, every pair of
a group's tokens is a link.

Texts repeat their words, so documents are handed on in batches that share a
dictionary: the distinct chunks of a batch, each once, and for each document
the ``sequence`` of its chunks.  ``ids`` and ``ends`` run over the dictionary's
chunks one behind another; ``chunk_ends`` says where each closes.  A chunk's
border is one that neither tokenizer looks across, a single space between other
characters, so both have a token's end there and groups never cross it.
Tokenizers without such borders have one chunk a text; results are the same.

Positions of shared ends are read off one sort of an end array with the shared
ends (each of which then stands beside its double), so a text of any length
costs n log n.

Pair counts: documents are counted once for each pair by partial sums, and each
document's distinct pairs meet their counts in a join whose frequent pairs go
by broadcast (fewer than ``session.SHARES``); no pair's rows meet in one task.

Defined results: null and empty texts, and texts whose token bytes differ from
a space and the text (those with a marker character, say), have no tokens:
zeros and no groups.  Rows count as documents each, so repeated rows raise the
counts of their pairs; ties for the highest count are all best; kept columns
called like the results are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.llm.pieces import as_bytes, byte_alphabet, threaded
from tracewright.llm.rows import in_workers, slices, spare
from tracewright.llm.sentencepiece_codec import BYTE, CONTROL, MARK, UNKNOWN, Model, default_model
from tracewright.session import join_skewed, stash

LISTS = ["ids_a", "ends_a", "ids_b", "ends_b", "chunk_ends"]
MADE = ["n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "links"]
#: Bytes of text that share a dictionary, but for a longer single text.
BATCH_BYTES = 3 << 20
#: A worker's cache keeps only the last batch's chunks when it holds more chunks or characters than these.
MAX_CHUNKS, MAX_CHARS = 250_000, 4_000_000
_RUN = re.compile(r"\s\s")
_BORDER = re.compile(r"(?<=\S)(?= \S)")


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut before single spaces between other characters.

    Every chunk begins with a space, which is left out.  A space at the text's
    end has no character behind it and belongs to the last chunk.
    """
    if _RUN.search(text) or text[0].isspace() or text[-1] == " ":
        return [c[1:] for c in _BORDER.split(" " + text)]
    return text.split(" ")


class Tokenizers:
    """A byte-level tokenizer (A) and a SentencePiece model (B), chunk by chunk."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        model = Model(b_path)
        with open(a_path, encoding="utf-8") as f:
            settings = json.load(f)
        before = settings["pre_tokenizer"] or {}
        cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not settings["normalizer"]
        self.chunked = cuts and model.chunkable() and model.dummy_prefix
        of = byte_alphabet()
        special = {t["id"] for t in settings["added_tokens"]}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = piece.encode() if i in special else bytes(of[c] for c in piece)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, k in model.pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int32) for v in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """A space and each text: its bytes and its ids of A and of B."""
        first = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for t, x, y in zip(texts, first, self.b.encode(texts, num_threads=1), strict=True):
            yield (" " + t).encode("utf-8", "replace"), x.ids, y

    def same(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))

    def learn(self, chunks: set[str]) -> None:
        """Ids of both for each chunk, or None where their bytes aren't the chunk's."""
        new = [c for c in chunks if c not in self.known]
        threaded(False)  # a task has one core
        # chunks that no white space ends keep their borders when they are put together
        plain = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()] if self.chunked else []
        alone = list(set(new).difference(plain))
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, (data, a, b) in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(c.encode("utf-8", "replace")) + 1 for c in group])
            cuts = [(as_bytes(x), np.cumsum(n[x])) for x, n in ((a, self.len_a), (b, self.len_b))]
            places = [np.searchsorted(at, ends) for _, at in cuts]
            if not self.same(data, a, b) or any((at[p] != ends).any() for (_, at), p in zip(cuts, places, strict=True)):
                alone += group
                continue
            parts = []
            for (raw, _), p in zip(cuts, places, strict=True):
                stops = (4 * p + 4).tolist()
                parts.append([raw[i:j] for i, j in zip([0, *stops], stops, strict=False)])
            self.known.update(zip(group, zip(*parts, strict=True), strict=True))
        for c, (data, a, b) in zip(alone, self.encode(alone), strict=True):
            self.known[c] = (as_bytes(a), as_bytes(b)) if self.same(data, a, b) else None
        self.chars += sum(map(len, new))
        if len(self.known) > MAX_CHUNKS or self.chars > MAX_CHARS:
            self.known = {c: self.known[c] for c in chunks}
            self.chars = sum(map(len, chunks))

    def __call__(self, texts: list[str | None]) -> tuple[list[array], list[np.ndarray]]:
        """Each text's chunks by their places in the dictionary, and the dictionary's lists."""
        cut = [(chunks_of(t) if self.chunked else [t]) if t else [] for t in texts]
        every = set().union(*cut)
        self.learn(every)
        bad = {c for c in every if self.known[c] is None}
        if bad:
            cut = [c if bad.isdisjoint(c) else [] for c in cut]
            every = set().union(*cut)
        index = {c: i for i, c in enumerate(every)}
        get = index.__getitem__
        found = [self.known[c] for c in index]
        a, b = (np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.len_a[a], dtype=np.int32), np.cumsum(self.len_b[b], dtype=np.int32)
        last = np.cumsum([len(x[0]) // 4 for x in found], dtype=np.int64) - 1
        return [array("i", map(get, c)) for c in cut], [a, ends_a, b, ends_b, ends_a[last]]


_made: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """This worker's pair of tokenizers with its cache; one pair is held."""
    if (a_path, b_path) not in _made:
        _made.clear()
        _made[a_path, b_path] = Tokenizers(a_path, b_path)
    return _made[a_path, b_path]


def forget() -> None:
    _made.clear()


def tokenise(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Batches: ``docs`` (structs of the ``keep`` columns and ``sequence``) and the integer lists of :data:`LISTS`."""
    numbers = T.ArrayType(T.IntegerType(), False)
    doc = T.StructType([*[docs.schema[c] for c in spare(keep, [*MADE, "sequence"])], T.StructField("sequence", numbers, False)])
    out = T.StructType([T.StructField("docs", T.ArrayType(doc, False), False), *[T.StructField(c, numbers, False) for c in LISTS]])
    schema = to_arrow_schema(out)

    def lists(values: list, kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(v, np.int32) for v in values if len(v)]])), type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, BATCH_BYTES):
            sequences, dictionary = tokenizers(a_path, b_path)(b.column(text).to_pylist())
            kind = schema.field("docs").type
            fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
            rows = pa.StructArray.from_arrays([lists(sequences, f.type) if f.name == "sequence" else b.column(f.name).cast(f.type) for f in fields], fields=fields)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows, type=kind), *[lists([v], schema.field(c).type) for c, v in zip(LISTS, dictionary, strict=True)]], schema=schema)

    return in_workers(docs.select(*dict.fromkeys([*doc.fieldNames()[:-1], text])), run, out, "alignment", forget, BATCH_BYTES)


def doubles(merged: str) -> Column:
    """Places of values that stand before an equal one in a sorted array."""
    return F.array_compact(F.transform(merged, lambda x, j: F.when(x == F.get(merged, j + 1), j)))


def counts_upto(found: str) -> Column:
    """The g-th double stands behind its own values and g doubles: how many values are at or below it."""
    return F.transform(found, lambda j, g: j - g + 1)


def part(values: str, upto: str, g: Column) -> Column:
    """The values of the g-th stretch (none is empty), ``upto`` telling how many there are to its end.

    ``slice`` would copy the whole array for each stretch.
    """
    places = F.sequence(F.coalesce(F.get(upto, g - 1), F.lit(0)), F.get(upto, g) - 1)
    return F.transform(places, lambda i: F.get(values, i))


def made_once(made: Column, *arrays: str) -> Column:
    """``made``, which looks into the array columns element by element.

    The optimiser moves an expression into the only place that mentions it, here
    a lambda, where it would be computed for every element; a second mention
    keeps it in its own projection.
    """
    return F.when(F.greatest(F.lit(0), *[F.size(a) for a in arrays]) >= 0, made)


def aligned_chunks(tokens: DataFrame) -> DataFrame:
    """Batches with their dictionary aligned.

    ``_ca`` and ``_cb`` (tokens of A and B to the end of each group), ``upto``
    (groups to the end of each chunk), and each chunk's tokens and groups.
    """
    out = tokens.withColumn("_s", F.array_intersect("ends_a", "ends_b"))
    out = out.withColumns({"_ma": F.sort_array(F.concat("ends_a", "_s")), "_mb": F.sort_array(F.concat("ends_b", "_s")), "_mc": F.sort_array(F.concat("_s", "chunk_ends"))})
    out = out.withColumns({"_ja": doubles("_ma"), "_jb": doubles("_mb"), "_jc": doubles("_mc")}).drop("_ma", "_mb", "_mc")
    out = out.withColumns({"_ca": counts_upto("_ja"), "_cb": counts_upto("_jb"), "upto": counts_upto("_jc")}).drop("_ja", "_jb", "_jc")
    zero = F.lit(0)
    size = lambda upto: F.transform("upto", lambda u, c: F.get(upto, u - 1) - F.coalesce(F.get(upto, F.get("upto", c - 1) - 1), zero))
    groups = F.transform("upto", lambda u, c: u - F.coalesce(F.get("upto", c - 1), zero))
    return out.withColumns({"_na": size("_ca"), "_nb": size("_cb"), "_ng": groups}).select("docs", "ids_a", "ids_b", "_ca", "_cb", "upto", "_na", "_nb", "_ng")


def _first(g: Column) -> tuple[Column, Column, Column]:
    """Places of a group's first tokens, and whether it has one of each, as most have."""
    a, b = (F.coalesce(F.get(upto, g - 1), F.lit(0)) for upto in ("_ca", "_cb"))
    return a, b, (F.get("_ca", g) - a == 1) & (F.get("_cb", g) - b == 1)


def group_pairs(g: Column) -> Column:
    """Every pair of the g-th group's tokens as one number, the A id above the B id."""
    # none is null, which the type must say: arrays that may hold nulls are sorted as objects
    pair = lambda a, b: F.coalesce(F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint")), F.lit(0).cast("bigint"))
    a, b, single = _first(g)
    every = F.flatten(F.transform(part("ids_a", "_ca", g), lambda x: F.transform(part("ids_b", "_cb", g), lambda y: pair(x, y))))
    return F.when(single, F.array(pair(F.get("ids_a", a), F.get("ids_b", b)))).otherwise(every)


def group_text(g: Column) -> Column:
    """``a1,a2|b1`` of the g-th group, from the columns ``_ta`` and ``_tb`` of ids as text."""
    a, b, single = _first(g)
    every = F.concat(F.array_join(part("_ta", "_ca", g), ","), F.lit("|"), F.array_join(part("_tb", "_cb", g), ","))
    return F.when(single, F.concat(F.get("_ta", a), F.lit("|"), F.get("_tb", b))).otherwise(every)


def group_ids(g: Column) -> Column:
    return F.struct(part("ids_a", "_ca", g).alias("a"), part("ids_b", "_cb", g).alias("b"))


def align(tokens: DataFrame, digest: bool = False) -> DataFrame:
    """Tokenised batches to documents: kept columns, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``links`` (distinct pairs ``pair`` with the number ``n`` of their
    links) and ``groups`` (structs of the ids ``a`` and ``b``) in order, or with
    ``digest`` their ``groups_sha256``.
    """
    out = aligned_chunks(tokens)
    if digest:
        out = out.withColumns({"_ta": F.col("ids_a").cast("array<string>"), "_tb": F.col("ids_b").cast("array<string>")})
    # what a chunk's groups are, chunk by chunk
    each = lambda made: F.transform("upto", lambda u, c: F.transform(F.sequence(F.coalesce(F.get("upto", c - 1), F.lit(0)), u - 1), made))
    linked = F.transform(each(group_pairs), F.flatten)
    own = F.transform(each(group_text), lambda x: F.array_join(x, ";")) if digest else each(group_ids)
    seen = ["ids_a", "ids_b", "_ca", "_cb", *(["_ta", "_tb"] if digest else [])]
    out = out.withColumns({"_links": made_once(linked, *seen), "_own": made_once(own, *seen)}).select("docs", "_na", "_nb", "_ng", "_links", "_own")
    keep = [f.name for f in tokens.schema["docs"].dataType.elementType if f.name != "sequence"]

    def document(d: Column) -> Column:
        of_chunks = lambda values: F.transform(d["sequence"], lambda c: F.get(values, c))
        total = lambda values: F.aggregate(d["sequence"], F.lit(0).cast("bigint"), lambda x, c: x + F.get(values, c))
        text = F.when(F.size(d["sequence"]) > 0, F.sha2(F.array_join(of_chunks("_own"), ";"), 256)).otherwise("")
        made = text.alias("groups_sha256") if digest else F.flatten(of_chunks("_own")).alias("groups")
        return F.struct(*[d[k].alias(k) for k in keep], total("_na").alias("n_a"), total("_nb").alias("n_b"), total("_ng").alias("n_groups"), made, F.flatten(of_chunks("_links")).alias("_l"))

    rows = out.select(F.inline(made_once(F.transform("docs", document), "_na", "_nb", "_ng", "_links", "_own")))
    # equal pairs side by side: the last place of each, and how far it is from that of the pair before
    rows = rows.withColumn("_l", F.sort_array("_l"))
    rows = rows.withColumn("_last", F.array_compact(F.transform("_l", lambda x, j: F.when(~x.eqNullSafe(F.get("_l", j + 1)), j + 1))))
    links = F.transform("_last", lambda j, k: F.struct(F.get("_l", j - 1).alias("pair"), (j - F.coalesce(F.get("_last", k - 1), F.lit(0))).alias("n")))
    return rows.select(*keep, "n_a", "n_b", "n_groups", F.size("_l").cast("bigint").alias("n_links"), "groups_sha256" if digest else "groups", links.alias("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n_docs (rows of ``links``, which has ``pair`` once a document, that hold it) and whether it is the highest of its A id."""
    counted = stash(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    highest = counted.groupBy("a").agg(F.max("n_docs").alias("_most"))  # a row an entry of A's vocabulary
    return counted.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """Aligned rows (written once) with ``n_best`` and ``count_sum``; ``links`` goes."""
    rows = stash(aligned.withColumn("_rid", F.monotonically_increasing_id()), "aligned")
    links = rows.select("_rid", F.explode("links").alias("_l")).select("_rid", "_l.pair", "_l.n")
    counts = stash(pair_counts(links.select("pair")), "counts")
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    judged = join_skewed(links, counts.withColumn("_n", F.col("n_docs")), "pair", total, "_n")
    sums = judged.groupBy("_rid").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("_b"), F.sum(F.col("n") * F.col("n_docs")).alias("_c"))
    out = rows.drop("links").join(sums, "_rid", "left")
    return out.withColumns({"n_best": F.coalesce("_b", F.lit(0)).cast("bigint"), "count_sum": F.coalesce("_c", F.lit(0)).cast("bigint")}).drop("_rid", "_b", "_c")


def op11_cross_tokenizer(spark, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Every document's groups, links and how common its links are in the corpus."""
    if a_path is None:
        import public_tokenizers

        a_path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_link_counts(align(tokenise(docs, a_path, b_path or default_model(), ["doc_id"]), digest=True))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
