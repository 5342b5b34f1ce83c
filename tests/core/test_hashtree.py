"""What a tree finds is what a full comparison finds, with few rows compared."""

import random

import pytest

from tracewright.operators.findings import changed_files
from tracewright.sources import hashtree

SCHEMA = "scope string, path string, sha256 string"


@pytest.mark.parametrize("seed", range(2))
def test_equals_full_diff(spark, seed):
    rnd = random.Random(seed)
    name = lambda: "/".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 4))) + rnd.choice(["/", ""]) + f"f{rnd.randrange(60)}"
    old = {(rnd.choice("pq"), name()): str(rnd.random()) for _ in range(80)}
    new = {k: (v if rnd.random() < 0.9 else "x") for k, v in old.items() if rnd.random() < 0.9} | {("p", name()): "n" for _ in range(4)} | {("r", "only/new"): "n"}
    tables = [spark.createDataFrame([(*k, v) for k, v in m.items()], SCHEMA) for m in (old, new)]
    got = hashtree.diff(*tables, *[hashtree.tree(m).cache() for m in tables])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, changed_files(*tables).collect()))


def test_rows_compared_follow_the_change(spark):
    files = {("p", f"d{i % 10}/e{i % 30}/f{i}.py"): str(i) for i in range(3000)}
    old = spark.createDataFrame([(*k, v) for k, v in files.items()], SCHEMA)
    new = spark.createDataFrame([(*k, "x" if k[1].endswith("f7.py") else v) for k, v in files.items()], SCHEMA)
    trees = [hashtree.tree(m).cache() for m in (old, new)]
    buckets, compared = hashtree.differing(*trees)
    assert buckets.count() == 1 and compared < 150 < trees[0].count()
    same, compared = hashtree.differing(trees[0], trees[0])
    assert same.count() == 0 and compared == 1


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("p", "a", "1"), ("p", None, None)], SCHEMA)
    assert hashtree.diff(none, none, hashtree.tree(none), hashtree.tree(none)).collect() == []
    assert {(r.path, r.reason) for r in hashtree.diff(none, some, hashtree.tree(none), hashtree.tree(some)).collect()} >= {("a", "new")}
