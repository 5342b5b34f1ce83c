"""Quality rules as a short-circuit cascade.

A text's measures are made when a rule or the caller first asks for them.  The
rules of a cascade decide in order and stop at the first that rejects.  Their
order is found on a sample of about ``SAMPLE`` rows, drawn row by row and
measured where they lie: each rule's time, with the measures it pulls, and its
rejections are summed, and rules run by rejections per cost, highest first.
The verdict is that of all rules together, so the order (and the sample, which
may differ from run to run) changes the time a document takes, never the result.

Words are ``[^\\x20\\x09-\\x0D]+``.  Rules use exact integer comparisons.

Defined results: null and empty texts have no word, fail the base rules and
are not kept; repeated rows are judged each; whole texts count whatever their
length; kept columns called like the measures are replaced; an empty table
gives an empty one, its rules in the order they are written.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.rows import map_texts, slices, spare

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, SAMPLE = 8, 500
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_KEEP_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_KEEP_ALPHA = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of 8 words that occur twice or more."""
    if len(words) < window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    width, kinds = 1, len(names)
    while width < window:  # ids of 2, 4 and 8 words from those of half the length
        pairs = ids[:-width] * kinds + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        width, kinds = 2 * width, len(distinct)
        if kinds == len(ids):
            return 0
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window][again] += 1
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Text:
    """A text whose measures are made on demand, each once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


Rules = dict[str, Callable[[Text], bool]]
#: Rules of the default cascade: name, and whether it rejects a text.
RULES: Rules = {
    "base": lambda t: t.base_failed,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
    "dup_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "wordlike": lambda t: 10 * sum(1 for w in t.words if _LETTER.search(w)) < 7 * t.n_words,
    "shouting": lambda t: 2 * len(t.data.translate(None, _KEEP_UPPER)) > len(t.data.translate(None, _KEEP_ALPHA)),
}
MEASURES = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType()}


def estimate(docs: DataFrame, rules: Rules, text: str = "text", sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on a bounded sample of rows."""
    n = docs.count()
    share = min(1.0, sample / n) if n else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for b in slices(batches, text):
            for s in b.column(0).to_pylist():
                seen += 1
                for name, rule in rules.items():
                    t = Text(s)  # anew, so that a rule pays for the measures it pulls
                    began = time.perf_counter()
                    rejected[name] += bool(rule(t))
                    spent[name] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(spent.values())), pa.array(list(rejected.values())), pa.array([seen] * len(rules))], names=["rule", "cost", "rejected", "n"])

    found = docs.sample(share, seed=7).select(text).mapInArrow(run, "rule string, cost double, rejected bigint, n bigint")  # rows stay where they lie
    sums = found.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()  # a row a rule
    of = {r["rule"]: r for r in sums}
    return [(k, of[k]["cost"] / of[k]["n"], of[k]["rejected"] / of[k]["n"]) for k in rules if k in of]


def order_rules(estimates: list[tuple[str, float, float]]) -> list[str]:
    """By rejections per cost; rules that the sample didn't see rejecting come last, cheap ones first."""
    return [name for name, _, _ in sorted(estimates, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))]


def apply_rules(docs: DataFrame, order: list[str], keep: list[str], rules: Rules | None = None, text: str = "text", measures: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``kept`` and the ``measures`` asked for (none by default)."""
    rules = rules or RULES
    cascade = [rules[k] for k in order] + [rule for k, rule in rules.items() if k not in order]
    made = measures or []
    keep = spare(keep, [*made, "kept"])
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, MEASURES[c]) for c in made] + [T.StructField("kept", T.BooleanType())])

    def fn(b: pa.RecordBatch) -> dict:
        texts = [Text(s) for s in b.column(text).to_pylist()]
        kept = [not any(rule(t) for rule in cascade) for t in texts]
        return {c: b.column(c) for c in keep} | {c: [getattr(t, c) for t in texts] for c in made} | {"kept": kept}

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, out, fn)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs, order_rules(estimate(docs, RULES)), ["doc_id"], measures=list(MEASURES))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] AS words,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
m AS (SELECT rid, doc_id, text, words, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len([x for x in words if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_wordlike,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_alpha FROM w),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g FROM m, unnest(range(1, n_words - 6)) AS t(i) WHERE n_words >= 8),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS t(k) GROUP BY rid),
r AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_wordlike < 7 * n_words OR 2 * n_upper > n_alpha) AS kept
FROM b
"""
