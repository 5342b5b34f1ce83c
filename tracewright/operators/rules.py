"""Detection rules as rows, first-match lookup and file selection.

A rule row is (kind, lang_group, framework, ord, pattern, tag, severity, power,
effective_for).  The catalogue is a parameter: any DataFrame of that shape.
:func:`default_rules` gives the full one.  Rule order is data (``ord``): the
first rule that matches wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.catalogue import CATALOGUE, MORE_RULES

RULE_SCHEMA = "kind string, lang_group string, framework string, ord int, pattern string, tag string, severity string, power double, effective_for array<string>"

# Names of languages that share the rules of another.
LANGUAGE_ALIASES = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "cpp": "c"}


def default_rules(spark: SparkSession, more: bool = False) -> DataFrame:
    """The catalogue as a table, with ``more`` the opt-in rules behind it."""
    rows = [(k, g, fw, i, p, t, s, w, e) for i, (k, groups, fw, p, t, s, w, e) in enumerate([*CATALOGUE, *(MORE_RULES if more else [])]) for g in groups.split()]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def lang_group(language: Column) -> Column:
    out = language
    for name, group in LANGUAGE_ALIASES.items():
        out = F.when(language == name, group).otherwise(out)
    return out


#: What a literal in a Java pattern needs a backslash for.
_SPECIAL = r"([^\p{L}\p{N}_])"


#: Values of ``boundary`` and what must stand before a pattern that begins with a letter or ``_``: a word boundary, where
#: letters of every script are parts of words (the reference's), or none of the ASCII letters, digits and ``_``.
BOUNDARIES = {True: r"\b", "ascii": "(?<![0-9A-Za-z_])"}


def matches(code: Column, pattern: Column, boundary: bool | str = True) -> Column:
    """Substring match; patterns that begin with a letter or ``_`` need a boundary of :data:`BOUNDARIES` before."""
    plain = F.contains(code, pattern)
    if not boundary:
        return (pattern != "") & plain
    # the cheap substring test decides first; the boundary is looked at behind it only
    bounded = F.regexp_like(code, F.concat(F.lit(BOUNDARIES[boundary]), F.regexp_replace(pattern, _SPECIAL, r"\\$1")))
    return (pattern != "") & plain & (~F.regexp_like(pattern, F.lit("^[\\p{L}_]")) | bounded)


def any_pattern(patterns: list[str], boundary: bool | str = True) -> str:
    """One pattern for all of the literals; it finds a text if one of them matches it."""

    def one(p: str) -> str:
        literal = re.sub(r"([^\w])", r"\\\1", p)
        return BOUNDARIES[boundary] + literal if boundary and (p[0].isalpha() or p[0] == "_") else literal

    return "|".join(one(p) for p in sorted(set(patterns)) if p)


_LIST = "array<struct<ord:int,pattern:string,tag:string,severity:string,power:double,effective_for:array<string>>>"
EVERY = "*"  # the group of a language that no rule names: it has all rules


def rule_lists(spark: SparkSession, key: str, lists: dict[str, list[Row]], kinds: list[str]) -> DataFrame:
    """``key`` and, for each kind, the ordered rules of every list, as ``<key>_<kind>``."""
    fields = ["ord", "pattern", "tag", "severity", "power", "effective_for"]
    rows = [(name, *[sorted((tuple(r[f] for f in fields) for r in held if r["kind"] == k), key=lambda x: x[0]) for k in kinds]) for name, held in lists.items()]
    return spark.createDataFrame(rows, f"{key} string, " + ", ".join(f"{key}_{k} {_LIST}" for k in kinds), verifySchema=False)


def first_matches(rows: DataFrame, rules: DataFrame, code: str, lang: str | None, kinds: dict[str, bool | str], framework: Column | None = None) -> DataFrame:
    """``rows`` with the first rule of each kind that matches (a struct, or null) as ``_<kind>``.

    ``kinds``: whether a kind's patterns need a word boundary before, and which.  ``rules``
    is a catalogue: some hundreds of rows, which the driver holds.  One compiled
    pattern a kind tells the rows that no rule matches, which are most; for the
    others the ordered lists of each language, and behind them those of each
    framework's profile, are broadcast.  No row is multiplied by the rules.
    """
    spark, held = rows.sparkSession, rules.collect()
    base = [r for r in held if r["framework"] is None]
    known = sorted({r["lang_group"] for r in base} - {EVERY})
    group = F.lit(EVERY) if lang is None else F.when(lang_group(F.col(lang)).isin(*known), lang_group(F.col(lang))).otherwise(EVERY)
    languages = {g: [r for r in base if g in (EVERY, r["lang_group"])] for g in [*known, EVERY]}
    out = rows.withColumn("_g", group).join(F.broadcast(rule_lists(spark, "_base", languages, list(kinds))), F.col("_g") == F.col("_base"), "left").drop("_g", "_base")
    names = sorted({r["framework"] for r in held if r["framework"]}) if framework is not None else []
    if names:
        # a profile's rules count for every language, each once
        profiles = {n: list({r["ord"]: r for r in held if r["framework"] == n}.values()) for n in names}
        out = out.withColumn("_p", framework).join(F.broadcast(rule_lists(spark, "_more", profiles, list(kinds))), F.col("_p") == F.col("_more"), "left").drop("_p", "_more")
    used = [r for r in held if r["framework"] is None or names]
    for kind, boundary in kinds.items():
        listed = [r["pattern"] for r in used if r["kind"] == kind and r["pattern"]]
        every = F.concat(F.col(f"_base_{kind}"), F.coalesce(F.col(f"_more_{kind}"), F.array().cast(_LIST))) if names else F.col(f"_base_{kind}")
        hit = F.filter(every, lambda r: matches(F.col(code), r["pattern"], boundary))  # noqa: B023
        found = F.when(F.col(code).rlike(any_pattern(listed, boundary)), F.get(hit, F.lit(0))) if listed else F.get(hit, F.lit(0))
        out = out.withColumn(f"_{kind}", found)
    return out.drop(*[f"{t}_{k}" for t in ("_base", "_more") for k in kinds])


def first_match(rows: DataFrame, rules: DataFrame, code: str, lang: str | None, kind: str, boundary: bool | str = True, out: str = "rule") -> DataFrame:
    """``rows`` with ``out``: struct of the first rule of ``kind`` that matches, or null."""
    return first_matches(rows, rules, code, lang, {kind: boundary}).withColumnRenamed(f"_{kind}", out)


def matchable(node_type: Column) -> Column:
    """Types of nodes that may be sources and sinks."""
    return node_type.isin("call", "assignment", "statement", "expression", "return")


def annotate(nodes: DataFrame, rules: DataFrame, framework: str | None = None) -> DataFrame:
    """Nodes with their first source, sink and sanitizer rule.

    ``framework`` names the profile of all nodes; without it a column
    ``framework`` of the nodes, where there is one, names that of each (a
    profile that the catalogue lacks counts as none).
    """
    profile = F.lit(framework) if framework is not None else F.col("framework") if "framework" in nodes.columns else None
    out = first_matches(nodes, rules, "code", "language", {"source": True, "sink": True, "sanitizer": False}, profile)
    fits = matchable(F.col("node_type"))
    return out.select(
        *nodes.columns,
        F.when(fits, F.col("_source.tag")).alias("source_type"),
        F.when(fits, F.col("_sink.tag")).alias("sink_class"),
        F.when(fits, F.col("_sink.severity")).alias("sink_severity"),
        F.col("_sanitizer.pattern").alias("san_pattern"),
        F.col("_sanitizer.power").alias("san_power"),
        F.col("_sanitizer.effective_for").alias("san_for"),
    )
