"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are its lower-cased word 1-grams, 2-grams and skip-grams
(two words with one between), and the stems of its words (their first 4, 6 and
8 characters, which inflected and compound forms share), hashed to ``2**bits``
coordinates; a feature that occurs twice or more makes a second one.  Training
visits a bounded sample of labelled documents (about ``max_train``, half of
each label at most, taken by the hash of doc_id, a documented parameter) in a
definite order.  FTRL's per-coordinate rates and its L1 term leave few non-zero
weights, which are broadcast as two short arrays (at most ``2**bits`` entries).

Where the score crosses 0.7 is found on the training rows: each of ``FOLDS``
folds is scored by a model of the others, and the cut with the greatest recall
less ``ALARM`` times the share of false alarms becomes 0.7 by a shift of the
intercept.  Scoring covers every whole text.

Defined results: null and empty texts have the score of the intercept, capped
below the threshold; labels that are null are ignored, several labels of one
document count as their maximum, of several texts of one doc_id the least
trains; with no label at all every score is 0.  Repeated rows are scored each.
A kept column called like the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.rows import in_workers, map_texts, of_rest, spare, unit

WORD = re.compile(r"[^\W_]+")
MAX_TRAIN, BITS = 5_000, 20
STEMS = (4, 6, 8)
FOLDS, ALARM, THRESHOLD = 3, 10.0, 0.7
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
Model = tuple[np.ndarray, np.ndarray, float]


class Words:
    """Hashes of the words seen and of their stems; emptied when full."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(STEMS)), np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        """The row of ``table`` for each word of the text; rows hold until the next call."""
        words = WORD.findall(text.lower())
        if len(self.number) > self.limit:
            self.number.clear()
        number = self.number
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = number.get(w)
            if n is None:
                n = number[w] = len(number)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n] = [xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(w[:k], k) for k in STEMS)]
            at[i] = n
        return at


_words = Words()


def forget() -> None:
    _words.clear()


def grams_of(text: str, piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """64-bit hashes of the word grams, skip-grams and stems of a text, with repeats, ``piece`` words at a time."""
    at = _words(text)
    for a in range(0, len(at), piece):
        hashes = _words.table[at[a : a + piece + 2]]
        h, n = hashes[:, 0], min(piece, len(at) - a)
        with np.errstate(over="ignore"):
            yield np.concatenate([h[:n] * _M1, ((h[:-1] * _M2 + h[1:]) * _M1)[:n], ((h[:-2] * _M3 + h[2:]) * _M1)[:n], hashes[:n, 1:].ravel() * _M1])


def _again(grams: np.ndarray) -> np.ndarray:
    """The feature of a gram that occurs twice or more."""
    with np.errstate(over="ignore"):
        return (grams ^ np.uint64(2)) * _M4


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a text."""
    if not text:
        return np.empty(0, np.int32)
    grams = [*grams_of(text)]
    if not grams:
        return np.empty(0, np.int32)
    found, n = np.unique(np.concatenate(grams), return_counts=True)
    return np.unique((np.concatenate([found, _again(found[n > 1])]) >> np.uint64(64 - bits)).astype(np.int32))


def weighty(text: str | None, known: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The features of a text that are ``known``; as those are few, only they are sorted."""
    if not text:
        return np.empty(0, np.int64)
    shift = np.uint64(64 - bits)
    single, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for part in grams_of(text):
        at = (part >> shift).astype(np.int64)
        single.append(at[known[at]])
        grams.append(part[known[(_again(part) >> shift).astype(np.int64)]])
    found, n = np.unique(np.concatenate(grams), return_counts=True)
    return np.unique(np.concatenate([*single, (_again(found[n > 1]) >> shift).astype(np.int64)]))


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def weights_of(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """All weights, the intercept last."""
    model = Ftrl(bits)
    positives = max(1, sum(y for _, y in rows))
    up = min(3.0, max(1.0, (len(rows) - positives) / positives))  # weight of the rarer label
    for _ in range(epochs):
        for at, y in rows:
            model.learn(at, y, up if y else 1.0)
    return model.weights(slice(None))


def best_cut(z: np.ndarray, y: np.ndarray, alarm: float = ALARM) -> float:
    """The cut of greatest recall less ``alarm`` times the false alarms, midway to the next value."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if y.all() or not y.any():
        return 0.0
    gain = np.cumsum(y) / y.sum() - alarm * np.cumsum(1 - y) / (1 - y).sum()
    i = int(np.argmax(gain))
    return float(z[i] + z[min(i + 1, len(z) - 1)]) / 2


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 4, folds: int = FOLDS) -> Model:
    """Indices and values of the non-zero weights, and the intercept, of rows of features and labels."""
    z, y = np.zeros(len(rows)), np.array([y for _, y in rows])
    for k in range(folds):
        w = weights_of([r for i, r in enumerate(rows) if i % folds != k], bits, epochs)
        for i in range(k, len(rows), folds):
            z[i] = w[rows[i][0]].sum() + w[-1]
    w = weights_of(rows, bits, epochs)
    at = np.flatnonzero(w[:-1])
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(z, y)
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1] + shift)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> Model | None:
    """Learn from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~of_rest("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect() if r["_y"] in (0, 1)}  # two rows
    if not n:
        return None
    share = F.lit(0.0)
    for y, count in n.items():
        share = F.when(F.col("_y") == y, min(1.0, max_train / 2 / count)).otherwise(share)
    sample = known.where(unit("doc_id") < share)  # about max_train rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_y", T.IntegerType()), T.StructField("at", T.BinaryType())])
    hashed = map_texts(texts, "text", out, lambda b: {"doc_id": b.column("doc_id"), "_y": b.column("_y"), "at": [features(t, bits).tobytes() for t in b.column("text").to_pylist()]}, owner="toxicity", drop=forget)
    one = hashed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")  # features of the bounded sample; the algorithm is sequential

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(at, np.int32), y) for b in batches for at, y in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if rows:
            at, w, bias = train(rows, bits)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], names=["at", "w", "bias"])

    model = in_workers(one, run, "at binary, w binary, bias double", "toxicity", forget).collect()  # one row, at most 8 * 2**bits bytes
    if not model:
        return None
    return np.frombuffer(model[0]["at"], np.int32), np.frombuffer(model[0]["w"], np.float32), model[0]["bias"]


def score_texts(df: DataFrame, model: Model | None, keep: list[str], text: str = "text", bits: int = BITS, score: str = "_score") -> DataFrame:
    """``keep`` columns of ``df`` and ``score`` (0 to 1) of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    keep = spare(keep, [score])
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())])
    tables: list[np.ndarray] = []

    def table() -> tuple[np.ndarray, np.ndarray, float]:
        if not tables:
            dense = np.zeros(1 << bits, np.float32)
            dense[sent.value[0]] = sent.value[1]
            tables.extend([dense, dense != 0])
        return tables[0], tables[1], sent.value[2]

    def one(t: str | None) -> float:
        if sent.value is None:
            return 0.0
        w, known, bias = table()
        at = weighty(t, known, bits)
        z = float(w[at].sum()) + bias
        if not len(at):
            z = min(z, 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    def fn(b: pa.RecordBatch) -> dict:
        return {c: b.column(c) for c in keep} | {score: [one(t) for t in b.column(text).to_pylist()]}

    return map_texts(df.select(*dict.fromkeys([*keep, text])), text, out, fn, owner="toxicity", drop=forget)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_texts(docs, fit(docs, labels), ["doc_id"], score="score")
    held = F.col("doc_id").isNotNull() & of_rest("doc_id", 3, 1)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
