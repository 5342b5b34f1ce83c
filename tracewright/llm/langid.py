"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from labelled text.  A text is
parsed greedily into the longest phrases that occur in that language's text;
with c phrases, a text of n symbols and N symbols of training text the
estimate is ``c * log2(N) / n`` bits a symbol.  The language needing fewest
such normalised phrases wins.

Symbols are the UTF-8 bytes of the lower-cased text in which every run of
characters that aren't letters is one space.  Phrases end at every
``BLOCK``-th symbol, for every language alike, so that numpy can walk all
blocks of a batch at once: an automaton becomes a table
state x symbol -> state, with a mark where a new phrase begins.

The training sample is bounded in its number of rows: every labelled text is
cut into stretches of ``STRETCH`` characters from its first to its last, and of
all stretches of a language those with the ``per_lang`` smallest hashes are
taken, so every part of every text may be drawn.  Prediction covers every whole
text.

Defined results: ``und`` with score 0 for a null text or one without letters
(Unicode category L), and for all texts if there is no labelled text.  Ties go
to the language first in alphabetical order.  Repeated rows are predicted each;
texts of any length are walked block by block.  Kept columns called like the
results are replaced.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.rows import map_texts, of_rest, spare, unit


def _numerals() -> str:
    """Ranges of characters that a pattern's ``\\w`` takes in but that are no letters."""
    found = [i for i in range(sys.maxunicode + 1) if chr(i).isalnum() and not chr(i).isalpha()]
    runs = [[x for _, x in g] for _, g in groupby(enumerate(found), lambda p: p[1] - p[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


NOT_LETTERS = re.compile(rf"[\W_{_numerals()}]+")
BLOCK = 512
PER_LANG, STRETCH = 100, 512
_FLAG = np.uint32(1 << 31)


def symbols(text: str | None) -> bytes:
    """Lower-cased letters with single spaces between; empty if there is none."""
    if not text:
        return b""
    s = NOT_LETTERS.sub(" ", text.lower()).strip()
    return s.encode("utf-8", "replace")


def suffix_automaton(data: Iterable[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in data:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """Cross-parses texts against the training text of several languages."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(k for k, v in samples.items() if v)
        present = sorted(set(b"".join(samples[k] for k in self.langs)))
        self.code = np.zeros(256, np.uint32)  # 0: not in any training text
        for i, b in enumerate(present):
            self.code[b] = i + 1
        width = len(present) + 1
        self.tables, self.bits = [], []
        for k in self.langs:
            automaton = suffix_automaton([int(self.code[b]) for b in samples[k]])
            # an unknown symbol is a phrase of its own: the next one begins anew in the extra state at the end
            root = np.full(width, _FLAG | np.uint32(len(automaton) * width), np.uint32)
            for c, to in automaton[0].items():
                root[c] = np.uint32(to * width) | _FLAG
            table = np.tile(root, (len(automaton), 1))
            for s, row in enumerate(automaton):
                for c, to in row.items():
                    table[s, c] = to * width
            # the extra state, where every step is marked, is also that of a block's start
            self.tables.append(np.concatenate([table, root[None]]).ravel())
            self.bits.append(np.log2(len(samples[k]) + 1))
        self.width = width

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of every text (rows) for every language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        flat = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        if not len(flat):
            return np.zeros((len(texts), len(self.langs)), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        blocks = -(-sizes // BLOCK)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")  # blocks with a t-th symbol
        columns = np.zeros((BLOCK, len(begin)), np.uint32)
        for t in range(BLOCK):
            if active[t] == 0:
                break
            columns[t, : active[t]] = flat[begin[: active[t]] + t]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.full(len(begin), len(table) - self.width, np.uint32)
            count = np.zeros(len(begin), np.int64)
            for t in range(BLOCK):
                m = active[t]
                if m == 0:
                    break
                to = table[state[:m] + columns[t, :m]]
                count[:m] += to >> np.uint32(31)
                state[:m] = to & ~_FLAG
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        data = [symbols(t) for t in texts]
        sizes = np.array([len(d) for d in data], np.float64)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        entropy = self.phrases(data) * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        rest = entropy.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isinf(second), 1.0, np.where(second > 0, 1 - low / np.maximum(second, 1e-9), 0.0))
        lang = [self.langs[i] if n else "und" for i, n in zip(best, sizes, strict=True)]
        return lang, [float(min(1.0, max(0.0, s))) if n else 0.0 for s, n in zip(score, sizes, strict=True)]


def training_text(docs: DataFrame, per_lang: int = PER_LANG, stretch: int = STRETCH) -> dict[str, bytes]:
    """A bounded sample of labelled text for each language.

    Learns from rows with a language whose crc32(doc_id) mod 5 is not 0.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~of_rest("doc_id", 5, 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("k"), F.ceil(F.char_length("text") / stretch).cast("int").alias("n"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").collect()}  # a row for each language
    if not counts:
        return {}
    # a stretch is drawn if its hash lies under its language's share: about twice per_lang, cut exactly below
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * per_lang / n))])[F.col("lang")]
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(unit(F.col("k"), i).alias("u"), i.alias("i"))), lambda x: x["u"] < F.col("share"))
    rows = known.where("n > 0").withColumn("share", share).select("lang", "k", F.explode(drawn).alias("d"), "text").select("lang", "d.u", "k", "d.i", F.substring("text", F.col("d.i") * stretch + 1, F.lit(stretch)).alias("text"))
    # copies draw the same stretches: one of each counts
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "k", "i"))
    sample = rows.groupBy("lang", "u", "k", "i").agg(F.min("text").alias("text")).withColumn("r", rank).where(F.col("r") <= per_lang).orderBy("lang", "r")
    taken: dict[str, list[bytes]] = {}
    for r in sample.collect():  # per_lang stretches a language
        taken.setdefault(r["lang"], []).append(symbols(r["text"]))
    return {k: b" ".join(x for x in v if x) for k, v in taken.items()}


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # per_lang stretches a language
    keep = spare(keep, ["lang_pred", "score"])
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    key = hash(tuple(sorted(samples.items())))

    def fn(b: pa.RecordBatch) -> dict:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(sent.value)
        lang, score = _parsers[key].predict(b.column(text).to_pylist())
        return {c: b.column(c) for c in keep} | {"lang_pred": lang, "score": score}

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, out, fn, limit=8 << 20)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.col("doc_id").isNotNull() & of_rest("doc_id", 5, 0)
    return identify(docs, training_text(docs), ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")
