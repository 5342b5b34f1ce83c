"""Bundles read in byte ranges give what the whole payload gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import datasource
from tracewright.sources.files import split_payload


def payload(rnd):
    line = lambda: rnd.choice(["x = 1", "", "  ", "# === FILE", "# comment", "é" * rnd.randrange(40), "\ty"])
    marker = lambda: rnd.choice(["# === FILE: {} ===", "#====FILE:{}=====  ", "# ===  FILE: src/{} ==="]).format(rnd.choice(["a.py", "b", "c.js", "d.ts"]))
    return "\n".join(marker() if rnd.random() < 0.2 else line() for _ in range(rnd.randrange(1, 60)))


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_equals_whole_payload(spark, tmp_path, split):
    rnd = random.Random(split)
    texts = {f"p{i}.txt": payload(rnd) for i in range(6)} | {"plain.txt": "a = 1\nb = 2\n", "end.txt": "# === FILE: z.py ==="}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = datasource.bundle_files(datasource.read_bundles(spark, str(tmp_path), split))
    got = {(r.scope.rsplit("/", 1)[1], r.path): r.source for r in found.collect()}
    whole = split_payload(spark.createDataFrame(list(texts.items()), "scope string, payload string"))
    assert got == {(r.scope, r.path): r.source for r in whole.collect()}


def test_filters_reach_the_reader(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text("# === FILE: x.py ===\nx\n# === FILE: y.py ===\ny\n")
    rows = datasource.read_bundles(spark, str(tmp_path))
    reader = datasource.BundleReader(str(tmp_path), 1 << 20)
    left = list(reader.pushFilters([datasource.EqualTo(("bundle",), f"{tmp_path}/a"), datasource.In(("name",), ("y.py",)), datasource.EqualTo(("at",), 3)]))
    assert len(left) == 1 and [p.file for p in reader.partitions()] == [f"{tmp_path}/a"]
    assert [r[2:] for p in reader.partitions() for r in reader.read(p)] == [("y.py", "\ny\n")]
    assert rows.where(F.col("name") == "y.py").count() == 2
    assert rows.where(F.col("bundle") == f"{tmp_path}/b").select("name").collect()[0][0] == "x.py"


def test_empty_folder(spark, tmp_path):
    assert datasource.read_bundles(spark, str(tmp_path)).collect() == []
