"""What lies below the nodes of trees, by intervals; and parsers that others bring."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import intervals, parse

SPANS = "scope string, node bigint, first bigint, last bigint"
POINTS = "scope string, place bigint, name string, v bigint"


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    spans = [(rnd.choice(["p", "q", None]), i, a, a + rnd.randrange(-1, rnd.choice([2, 40, 3000]))) for i, a in enumerate(rnd.randrange(3000) for _ in range(60))] + [("p", 90, None, 3), ("p", 91, 1 << 61, (1 << 61) + 5)]
    points = [(rnd.choice(["p", "q", None]), rnd.randrange(4000), rnd.choice("abcde"), i) for i in range(300)] + [("p", None, "a", 1), ("p", (1 << 61) + 5, "far", 2)]
    left, right = spark.createDataFrame(spans, SPANS), spark.createDataFrame(points, POINTS)
    inside = [(s, p) for s in spans for p in points if None not in (s[2], s[3], p[1]) and s[0] == p[0] and s[2] <= p[1] <= s[3]]
    got = intervals.points_below(left, right, ["scope"]).collect()
    assert sorted((r.node, r.v) for r in got) == sorted((s[1], p[3]) for s, p in inside)
    names = {}
    for s, p in inside:
        at, n = names.get((s[1], p[2]), (p[1], 0))
        names[s[1], p[2]] = (min(at, p[1]), n + 1)
    assert {(r.node, r.name): (r["at"], r.n) for r in intervals.names_below(left, right, ["scope"], ["node"]).collect()} == names
    sums = {}
    for s, p in inside:
        n, v = sums.get(s[1], (0, 0))
        sums[s[1]] = (n + 1, v + p[3])
    assert {r.node: (r.n, r.total) for r in intervals.totals_below(left, right, ["scope"], ["node"], "v").collect()} == sums


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SPANS), spark.createDataFrame([("p", 3, "a", 1)], POINTS)
    assert intervals.names_below(none, some, ["scope"], ["node"]).collect() == []
    spans = spark.createDataFrame([("p", 1, 1, 5)], SPANS)
    assert intervals.names_below(spans, some.where("false"), ["scope"], ["node"]).collect() == []


SOURCE = """
import os
def f(a, b=g(1)):
    x[h(a)] = y = p(q(r(a, b), c), z)
    a.b(c)(d)
    if t(x):
        return u(v(w))
    x: int = k(1)
    x += m(n)
    for i in s(j): pass
    assert f(a), e
class C(D): y = l(o)
"""
DEEP = "v = " + "f(" * 40 + "a" + ")" * 40


def test_uses_and_calls_of_nodes(spark):
    files = spark.createDataFrame([("s", "a.py", "python", SOURCE, 0), ("s", "b.py", "python", DEEP, 1), ("s", "c.js", "javascript", "a(b)", 2), ("s", "d.py", "python", "(", 3), ("s", "e.py", "python", None, 4)], "scope string, path string, language string, source string, ord int")
    places = parse.parse_places(files).cache()
    got = {}
    for r in parse.names_of_nodes(places).collect():
        got.setdefault((r.file, r.node_ord, r.of), set()).add(r.name)
    wanted = {}
    for r in parse.parse_files(files).where("kind = 'node' AND file LIKE '%.py'").collect():
        for of, names in (("use", r.uses), ("call", r.calls)):
            if names:
                wanted[r.file, r.node_ord, of] = set(names)
    assert got == wanted
    assert places.where("file = 'b.py'").count() < 300  # 40 nodes deep, and no square of it


def test_registered_parser(spark):
    def tiny(source):
        if "!" in source:
            raise ValueError("no")
        for i, line in enumerate(source.split("\n")):
            yield "node", {"node_ord": i + 1, "parent_ord": None, "node_type": "statement", "label": line, "line": i, "col": 0, "code": line, "defs": [], "uses": [], "calls": []}

    files = spark.createDataFrame([("s", "a.tiny", "tiny", "one\ntwo", 0), ("s", "b.tiny", "tiny", "!", 1)], "scope string, path string, language string, source string, ord int")
    parse.register_parser("tiny", tiny)
    try:
        rows = parse.parse_files(files).select("file", "kind", "code", "message").collect()
    finally:
        del parse.PARSERS["tiny"]
    assert sorted(map(tuple, rows), key=str) == [("a.tiny", "node", "one", None), ("a.tiny", "node", "two", None), ("b.tiny", "error", None, "no")]
    assert parse.parse_files(files).where(F.col("kind") == "error").count() == 0  # the lexer takes them again


def test_points_are_in_few_blocks(spark):
    """A span of a million places has seven sizes of blocks, not twenty."""
    spans = spark.createDataFrame([("p", 1, 1, 1_000_000), ("p", 2, 7, 16)], SPANS)
    left, right = intervals._cut(spans, spark.createDataFrame([("p", 9, "a", 1)], POINTS), "first", "last", "place")
    assert right.count() == 7 and left.where("node = 1").count() <= 14 * 7
    # 7, the block 8 to 15, 16
    assert sorted((r._size, r._block) for r in left.where("node = 2").collect()) == [(0, 7), (0, 16), (3, 1)]
