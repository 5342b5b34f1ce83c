"""Pages by key and stored scans, against plain sorts and comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.findings import compare
from tracewright.session import fresh_path
from tracewright.sources import colocated, keyset


@pytest.mark.parametrize("order", [["score", "id"], ["-score", "id"], ["-score", "-id"]])
def test_pages(spark, order):
    rnd = random.Random(len(order[0]))
    rows = [(i, rnd.choice([None, *range(9)]), f"t{i}") for i in range(500)]
    path = fresh_path(spark, "runs")
    keyset.save_runs(spark.createDataFrame(rows, "id int, score int, title string"), path, order, rows=40)
    sign = lambda v, down: (-v if down else v)
    rank = {"score": lambda r: sign(-1 if r[1] is None else r[1], order[0][0] == "-"), "id": lambda r: sign(r[0], order[1][0] == "-")}
    rows.sort(key=lambda r: (rank["score"](r), rank["id"](r)))
    for number, size in [(1, 10), (3, 17), (50, 10), (51, 10), (5, 120), (6, 99)]:
        got = keyset.page_number(spark, path, order, number, size)
        assert list(map(tuple, got.collect())) == rows[(number - 1) * size : number * size]
    for at in (0, 39, 40, 250, 498, 499):
        got = keyset.page_after(spark, path, order, {"id": rows[at][0], "score": rows[at][1]}, 30)
        assert list(map(tuple, got.collect())) == rows[at + 1 : at + 31]
    files = keyset.page_number(spark, path, order, 40, 12).inputFiles()
    assert 1 <= len(files) <= 3  # of thirteen or more
    assert len(keyset.page_after(spark, path, order, {"id": rows[300][0], "score": rows[300][1]}, 30).inputFiles()) <= 4


def test_no_rows_no_pages(spark):
    path = fresh_path(spark, "runs")
    keyset.save_runs(spark.createDataFrame([], "id int"), path, ["id"])
    assert keyset.page_number(spark, path, ["id"], 1, 10).collect() == []
    assert keyset.page_after(spark, path, ["id"], {"id": 3}, 10).columns == ["id"]


def test_scans_meet_without_exchange(spark):
    rnd = random.Random(3)
    row = lambda: (rnd.choice(["a", "b", "", None]), rnd.choice([1, 2, 11, None]), rnd.choice("xyz"))
    sides = [spark.createDataFrame([row() for _ in range(n)], "file string, line int, note string") for n in (9, 12)]
    for name, df in zip(("scan_a", "scan_b"), sides, strict=True):
        colocated.save_scan(df, name, fresh_path(spark, name), ["file", "line"], buckets=4)
    colocated.save_scan(sides[0].where("false"), "scan_none", fresh_path(spark, "none"), ["file", "line"], buckets=4)
    try:
        got = colocated.compare_saved(spark, "scan_a", "scan_b", ["file", "line"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        wanted = compare(*sides, ["file", "line"])
        assert sorted(map(str, got.select("file", "line", "bucket").collect())) == sorted(map(str, wanted.collect()))
        assert got.agg(F.sum("n_old"), F.sum("n_new")).first()[:] == (9, 12)
        assert {r.bucket for r in colocated.compare_saved(spark, "scan_none", "scan_b", ["file", "line"]).collect()} == {"new"}
    finally:
        for name in ("scan_a", "scan_b", "scan_none"):
            colocated.drop_scan(spark, name)
