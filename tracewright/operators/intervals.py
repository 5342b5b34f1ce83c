"""Trees as nested intervals: what lies below a node is found by a join, not by walking.

A node of a tree spans the places (pre-order numbers) of all that stands below
it, so "all names in this subtree" asks which points fall into an interval.
Intervals are cut into aligned blocks of 1, 8, 64, ... places, at most 14 of a
size; a point lies in one block of each size, so the containment is an
equi-join by (scope, size, block), and a pair of an interval and a point within
it meets in exactly one block.  Points are multiplied by the number of sizes,
a third of what blocks of 1, 2, 4, ... would need.

:func:`names_below` and :func:`totals_below` bring a block's points together
before the join: a block that many intervals hold is gathered once.

Defined results: intervals and points with a null place are in nothing and
hold nothing, as are intervals that end before they begin; null scopes are one
scope; a node without points below is absent; repeated points count each.
Places are not negative and below 2^62.  The intervals are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _down(value: Column, k: Column) -> Column:
    return F.call_function("shiftright", value, k)


#: Bits that a size of blocks has more than the one below it.
STEP = 3


def _blocks(first: Column, last: Column, top: int) -> Column:
    """The largest aligned blocks that fill ``first`` to ``last``, as (size, block); size is the power of two."""

    def at(k: Column) -> Column:
        # what blocks of this size cover, less what those of the next size do
        up = F.least(k + STEP, F.lit(top))
        left = lambda shift: _down(first + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1, shift)
        low, high, inner_low, inner_high = left(k), _down(last + 1, k), left(up), _down(last + 1, up)
        block = lambda b: F.struct(k.alias("size"), b.alias("block"))
        run = lambda a, b: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), block)).otherwise(F.array().cast("array<struct<size:int,block:bigint>>"))
        inside = (inner_low < inner_high) & (k + STEP <= top)
        widened = lambda b: b * (1 << STEP)
        return F.when(inside, F.concat(run(low, widened(inner_low)), run(widened(inner_high), high))).otherwise(run(low, high))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top), F.lit(STEP)), at))


def _cut(spans: DataFrame, points: DataFrame, first: str, last: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their blocks (``_size``, ``_block``); sizes go no further than the longest span."""
    spans = spans.where(F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(last) >= F.col(first)))
    longest = spans.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0] or 1
    top = int(longest).bit_length() - 1
    top -= top % STEP
    begin, end, at = (F.col(c).cast("bigint") for c in (first, last, place))
    left = spans.withColumn("_b", F.explode(_blocks(begin, end, top))).withColumns({"_size": F.col("_b.size"), "_block": F.col("_b.block")}).drop("_b")
    right = points.where(F.col(place).isNotNull()).withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(STEP))))
    return left, right.withColumn("_block", _down(at, F.col("_size")))


def _meet(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """The join by scope and block; scopes of the right side go."""
    names = {c: f"_r_{c}" for c in [*scope, "_size", "_block"]}
    other = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(other[r]) for c, r in names.items()]
    return left.join(other, same).drop(*names.values(), "_size", "_block")


def points_below(spans: DataFrame, points: DataFrame, scope: list[str], first: str = "first", last: str = "last", place: str = "place") -> DataFrame:
    """Every span with every point in it: as many rows as the answer has, no more.

    Columns of ``points`` beside the scope must not be called like those of ``spans``.
    """
    left, right = _cut(spans, points, first, last, place)
    return _meet(left, right, scope)


def names_below(spans: DataFrame, points: DataFrame, scope: list[str], node: list[str], name: str = "name", first: str = "first", last: str = "last", place: str = "place") -> DataFrame:
    """(scope, node, name, at, n): the distinct names below a node, with their first place and number."""
    left, right = _cut(spans.select(*scope, *node, first, last), points.select(*scope, name, place), first, last, place)
    gathered = right.groupBy(*scope, "_size", "_block", name).agg(F.min(place).alias("_at"), F.count(F.lit(1)).alias("_n"))
    met = _meet(left, gathered, scope)
    return met.groupBy(*scope, *node, name).agg(F.min("_at").alias("at"), F.sum("_n").alias("n"))


def totals_below(spans: DataFrame, points: DataFrame, scope: list[str], node: list[str], value: str, first: str = "first", last: str = "last", place: str = "place") -> DataFrame:
    """(scope, node, n, total): number of points below a node and the sum of their values."""
    left, right = _cut(spans.select(*scope, *node, first, last), points.select(*scope, value, place), first, last, place)
    gathered = right.groupBy(*scope, "_size", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    met = _meet(left, gathered, scope)
    return met.groupBy(*scope, *node).agg(F.sum("_n").alias("n"), F.sum("_v").alias("total"))
