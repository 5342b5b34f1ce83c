"""Queries of stored runs, stored scans, trees as intervals and the data source of bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.operators import intervals
from tracewright.operators.order import ranked
from tracewright.plans.registry import query
from tracewright.session import fresh_path, stash
from tracewright.sources import colocated, datasource, keyset
from tracewright.sources.files import chunk_text


@query("""SELECT o_orderkey, o_orderdate, 'by number' AS how FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 950)
UNION ALL SELECT o_orderkey, o_orderdate, 'after a key' FROM (SELECT * FROM orders WHERE o_orderdate < DATE '1995-06-17' OR (o_orderdate = DATE '1995-06-17' AND o_orderkey > 1000) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)""")
def keyset_page(t):
    """The twentieth page of the latest orders, and the page after a key, both from the files that hold them."""
    path, order = fresh_path(t.spark, "runs"), ["-o_orderdate", "o_orderkey"]
    keyset.save_runs(t.orders, path, order, rows=20_000)
    key = {"o_orderdate": F.lit("1995-06-17").cast(t.orders.schema["o_orderdate"].dataType), "o_orderkey": 1000}
    found = keyset.page_number(t.spark, path, order, 20, 50).withColumn("how", F.lit("by number"))
    found = found.unionByName(keyset.page_after(t.spark, path, order, key, 50).withColumn("how", F.lit("after a key")))
    return found.select("o_orderkey", "o_orderdate", "how")


@query("""WITH o AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
SELECT coalesce(o.l_partkey, n.l_partkey) AS l_partkey, coalesce(o.l_suppkey, n.l_suppkey) AS l_suppkey, CASE WHEN o.n IS NULL THEN 'new' WHEN n.n IS NULL THEN 'resolved' ELSE 'unchanged' END AS bucket, coalesce(o.n, 0) AS n_old, coalesce(n.n, 0) AS n_new
FROM o FULL JOIN n ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey""")
def compare_stored_scans(t):
    """Two stored scans, of the first and of the last lines of orders, met bucket by bucket."""
    keys, names = ["l_partkey", "l_suppkey"], [f"scan_{uuid.uuid4().hex}" for _ in range(2)]
    for name, rows in zip(names, ("l_linenumber <= 4", "l_linenumber >= 3"), strict=True):
        colocated.save_scan(t.lineitem.where(rows).select(*keys, "l_linenumber"), name, fresh_path(t.spark, name), keys, buckets=8)
    return colocated.compare_saved(t.spark, *names, keys)


@query("""WITH l AS (SELECT c_nationkey AS k, o_custkey AS c, o_orderkey AS o, l_linenumber AS n, l_returnflag || l_linestatus AS name, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
b AS (SELECT 'nation' AS kind, k AS node, name, count(*) AS n, sum(q) AS q FROM l GROUP BY k, name UNION ALL SELECT 'customer', c, name, count(*), sum(q) FROM l GROUP BY c, name UNION ALL SELECT 'order', o, name, count(*), sum(q) FROM l GROUP BY o, name)
SELECT kind, node, string_agg(name, ',' ORDER BY name) AS names, sum(n)::BIGINT AS n, sum(q)::DOUBLE AS total FROM b GROUP BY kind, node""")
def subtree_names(t):
    """A nation's customers, their orders and lines as a tree: what stands below every node, found through its interval."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.select("c_nationkey", "o_custkey", "o_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").alias("value"))
    points = stash(ranked(lines, ["c_nationkey"], ["o_custkey", "o_orderkey", "l_linenumber"]).withColumnRenamed("_rank", "place"), "points")
    of = {"nation": "c_nationkey", "customer": "o_custkey", "order": "o_orderkey"}
    node = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("bigint").alias("node")) for kind, c in of.items()]))
    spans = stash(points.select("c_nationkey", "place", node.alias("_n")).groupBy("c_nationkey", "_n.kind", "_n.node").agg(F.min("place").alias("first"), F.max("place").alias("last")), "spans")
    names = intervals.names_below(spans, points, ["c_nationkey"], ["kind", "node"])
    totals = intervals.totals_below(spans, points, ["c_nationkey"], ["kind", "node"], "value").select("kind", "node", "total")
    # flags and states have six values together
    listed = names.groupBy("kind", "node").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.sum("n").alias("n"))
    return listed.join(totals, ["kind", "node"]).select("kind", "node", "names", "n", F.col("total").cast("double").alias("total"))


@query("""SELECT doc_id, 'd' || doc_id || '.py' AS path, sha256(chr(10) || '# a document' || chr(10) || coalesce(text, '') || chr(10) || chr(10)) AS sha FROM documents""")
def bundle_source(t):
    """Documents as sections of bundles, read back through the data source in ranges of 1 MB."""
    body = F.concat(F.lit("# a document\n"), F.coalesce("text", F.lit("")))
    path = fresh_path(t.spark, "bundles")
    t.documents.select(chunk_text(F.concat(F.lit("d"), "doc_id"), body).alias("value")).write.text(path)
    found = datasource.bundle_files(datasource.read_bundles(t.spark, path, 1 << 20))
    return found.select(F.regexp_extract("path", r"^d(-?\d+)\.py$", 1).cast("bigint").alias("doc_id"), "path", F.sha2("source", 256).alias("sha"))
