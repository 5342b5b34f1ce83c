"""Manifests as hash trees: what changed is found by descending only where digests differ.

A node is a directory, or below it one of 256 buckets of its files (by a hash
of the path), so that a directory of any size has bounded children.  A node's
digest is the exclusive-or of the SHA-256 of (path, file digest) of all files
below it, in four parts, with their number: it needs no order, so partial sums
make it and no directory's files meet in one task.

:func:`diff` compares the children of nodes that differ, level by level, and
at the end the files of the buckets that differ; a table of a level is read
through the parents that differ.  The result is that of a full comparison, with
rows compared in proportion to what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.findings import changed_files
from tracewright.session import stash

PARTS = ["d0", "d1", "d2", "d3"]


def _folders(path: Column) -> Column:
    """The folders of a path from the root (empty) down, then its bucket."""
    names = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    bucket = F.concat(F.element_at(folders, -1), F.lit("/#"), F.left(F.sha2(path, 256), F.lit(2)))
    return F.concat(folders, F.array(bucket))


def tree(manifest: DataFrame) -> DataFrame:
    """(scope, level, parent, node, leaf, n, d0..d3) of a manifest (scope, path, sha256).

    Nulls in path or sha256 count as empty.
    """
    path, sha = F.coalesce("path", F.lit("")), F.coalesce("sha256", F.lit(""))
    rows = manifest.select("scope", _folders(path).alias("_f"), F.sha2(F.concat_ws("\n", path, sha), 256).alias("_h"))
    # sixteen hexadecimal digits as a signed number, half by half
    piece = lambda i: F.shiftleft(F.conv(F.substring("_h", 16 * i + 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring("_h", 16 * i + 9, 8), 16, 10).cast("bigint"))
    rows = rows.withColumns({d: piece(i) for i, d in enumerate(PARTS)})
    nodes = rows.select("scope", "_f", *PARTS, F.posexplode("_f").alias("level", "node"))
    parent = F.when(F.col("level") > 0, F.get("_f", F.col("level") - 1))
    leaf = F.col("level") == F.size("_f") - 1
    return nodes.groupBy("scope", "level", parent.alias("parent"), "node", leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(d).alias(d) for d in PARTS])


def save_tree(manifest: DataFrame, path: str) -> None:
    """The tree, one folder a level."""
    tree(manifest).write.mode("overwrite").partitionBy("level").parquet(path)


def load_tree(spark, path: str) -> DataFrame:
    kinds = "scope string, parent string, node string, leaf boolean, n bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint, level int"
    return spark.read.schema(kinds).parquet(path)


def differing(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """Buckets (scope, node) that differ between two trees, and how many nodes were compared."""
    depth = max((t.agg(F.max("level")).first()[0] or 0) for t in (old, new))
    front, buckets, compared = None, None, 0
    for level in range(depth + 1):
        sides = []
        for side in (old, new):
            rows = side.where(F.col("level") == level)
            if front is not None:
                rows = rows.join(front.withColumnRenamed("node", "parent"), ["scope", "parent"], "left_semi")
            sides.append(rows.select("scope", "node", "leaf", F.struct("n", *PARTS).alias("digest")))
        both = stash(sides[0].withColumnRenamed("digest", "_old").join(sides[1], ["scope", "node", "leaf"], "full_outer"), "compared")
        compared += both.count()
        apart = both.where(~F.col("_old").eqNullSafe(F.col("digest"))).select("scope", "node", "leaf")
        found = apart.where("leaf").select("scope", "node")
        buckets = found if buckets is None else buckets.unionByName(found)
        front = apart.where("NOT leaf").select("scope", "node")
        if front.isEmpty():
            break
    return buckets, compared


def diff(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame) -> DataFrame:
    """scope, path, reason (new, changed, deleted) of two manifests with their trees."""
    buckets = stash(differing(old_tree, new_tree)[0], "buckets")
    near = lambda m: m.withColumn("node", F.element_at(_folders(F.coalesce("path", F.lit(""))), -1)).join(buckets, ["scope", "node"], "left_semi")
    return changed_files(near(old), near(new))
