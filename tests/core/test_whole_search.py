"""Nothing cuts the search unless a bound is asked for."""

from pyspark.sql import functions as F

from tracewright.operators.taint import taint_paths
from tracewright.plans import queries_rules, registry, scan  # noqa: F401

NODES = "scope string, node_id bigint, ord bigint, file string, line int, source_type string, sink_class string, sink_severity string, san_power double, san_for array<string>"


def test_more_states_than_the_reference_pops(spark):
    """10,020 sources that are sinks themselves; before, those behind the 10,000th had no path."""
    nodes = spark.range(10_020).select(F.lit("s").alias("scope"), F.col("id").alias("node_id"), F.col("id").alias("ord"), F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.lit("in").alias("source_type"), F.lit("sqli").alias("sink_class"), F.lit("high").alias("sink_severity"), F.lit(None).cast("double").alias("san_power"), F.lit(None).cast("array<string>").alias("san_for"))
    assert taint_paths(nodes, None).count() == 10_020
    assert taint_paths(nodes, None, max_pops=10_000).count() == 10_000


def test_longer_paths_than_the_reference_walks(spark):
    """A chain of 53 nodes from a source to a sink; before, nothing beyond the 50th was met."""
    n = 53
    nodes = spark.createDataFrame([("s", i, i, "f", i, "in" if not i else None, "sqli" if i == n - 1 else None, "high" if i == n - 1 else None, None, None) for i in range(n)], NODES)
    edges = spark.createDataFrame([("s", i, i + 1, i + 1) for i in range(n - 1)], "scope string, src bigint, dst bigint, edge_ord bigint")
    assert [(r.sink_id, r.path_len, list(r.path)) for r in taint_paths(nodes, edges).collect()] == [(n - 1, n, list(range(n)))]


def suppliers(spark, path, n):
    """``n`` suppliers of one nation, all in debt: each is a file with one path."""
    spark.range(n).select((F.col("id") + 1).alias("s_suppkey"), F.lit(3).alias("s_nationkey"), F.lit(-1.0).alias("s_acctbal")).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_analyse_projects_of_one_large_project(spark, tmp_path):
    got = registry.QUERIES["analyse_projects"](spark, suppliers(spark, tmp_path, 2600)).select("file").collect()
    assert len(got) == len(set(got)) == 2600


def test_path_steps_of_one_large_project(spark, tmp_path):
    """Four steps of each path; before, paths behind the 10,000th state of a project had none."""
    got = registry.QUERIES["path_steps"](spark, suppliers(spark, tmp_path, 2600)).groupBy("file").count().collect()
    assert len(got) == 2600 and {r["count"] for r in got} == {4}


def test_steps_of_a_long_path(spark):
    """A path of 52 nodes that no folding shortens is shown whole."""
    n = 52
    nodes = spark.createDataFrame([("s", i, i, "f", i, "in" if not i else None, "sqli" if i == n - 1 else None, "high" if i == n - 1 else None, None, None) for i in range(n)], NODES)
    edges = spark.createDataFrame([("s", i, i + 1, i + 1, []) for i in range(n - 1)], "scope string, src bigint, dst bigint, edge_ord bigint, folded array<bigint>")
    paths = taint_paths(nodes, edges).withColumn("path_id", F.lit("p"))
    steps = scan.steps_of(paths, edges, nodes.withColumn("label", F.col("node_id").cast("string"))).collect()
    assert sorted((r.pos, r.label) for r in steps) == [(i, str(i)) for i in range(n)]
