"""Queries of keyed state with lifetimes, as streams over ``events`` in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.registry import query
from tracewright.session import fresh_path
from tracewright.streaming import keyed
from tracewright.streaming.limits import run_to_table

#: Batches of equal time that the events arrive in.
BATCHES = 4


def arriving(t, key: str, judge) -> DataFrame:
    """Events (key, number, ts) written batch by batch in the order of time; after each the stream goes on from its
    checkpoint, as after a restart, and takes what is new as one micro-batch.  Returns all that ``judge`` gave.

    A batch's files are as many as the shuffle has partitions; no batch passes through one task.
    """
    spark, source, out = t.spark, fresh_path(t.spark, "events"), fresh_path(t.spark, "judged")
    checkpoint = fresh_path(spark, "stream")
    rows = t.events.select(F.expr(key).alias("key"), F.col("event_id").cast("bigint").alias("number"), F.col("ts").cast("timestamp").alias("ts"))
    ms = F.unix_millis("ts")
    first, last = rows.agg(F.min(ms), F.max(ms)).first()
    width = ((last or 0) - (first or 0)) // BATCHES + 1
    nth = F.coalesce(F.least(F.lit(BATCHES - 1), F.floor((ms - (first or 0)) / width)), F.lit(0))
    for i in range(BATCHES):
        rows.where(nth == i).write.mode("append").parquet(f"{source}/batch={i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source)
        found = run_to_table(judge(stream), out, checkpoint, "append")
    return found


MS = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"


@query("""SELECT event_id, greatest(0, 3 - row_number() OVER w)::INT AS remaining, row_number() OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)""")
def limit_by_day(t):
    """Three requests an identity and calendar day; an identity's state is the counters of its open days."""
    found = arriving(t, "user_id", keyed.limited_by_day)
    return found.select(F.col("number").alias("event_id"), "remaining", "allowed")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {MS} AS ms FROM events),
b AS (SELECT user_id, min(ms) AS began FROM e GROUP BY 1 UNION ALL SELECT b.user_id, min(e.ms) FROM b JOIN e ON e.user_id = b.user_id AND e.ms >= b.began + 43200000 GROUP BY b.user_id, b.began),
j AS (SELECT e.*, (SELECT max(began) FROM b WHERE b.user_id = e.user_id AND b.began <= e.ms) AS began FROM e)
SELECT event_id, greatest(0, 2 - row_number() OVER w)::INT AS remaining, row_number() OVER w <= 2 AS allowed FROM j WINDOW w AS (PARTITION BY user_id, began ORDER BY ts, event_id)""")
def limit_window(t):
    """Two requests in twelve hours that begin with the first of them."""
    found = arriving(t, "user_id", lambda s: keyed.limited(s, 2, 43_200_000))
    return found.select(F.col("number").alias("event_id"), "remaining", "allowed")


@query(f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS k, event_id, ts, {MS} AS ms FROM events),
b AS (SELECT k, min(ms) AS began FROM e GROUP BY 1 UNION ALL SELECT b.k, min(e.ms) FROM b JOIN e ON e.k = b.k AND e.ms >= b.began + 14400000 GROUP BY b.k, b.began),
j AS (SELECT e.*, (SELECT max(began) FROM b WHERE b.k = e.k AND b.began <= e.ms) AS began FROM e)
SELECT event_id, row_number() OVER w > 1 AS hit, first_value(event_id) OVER w AS source FROM j WINDOW w AS (PARTITION BY k, began ORDER BY ts, event_id)""")
def cache_hits(t):
    """Look-ups of forty prompts in a cache whose values live for four hours, and which look-up stored what was found."""
    found = arriving(t, "user_id % 40", lambda s: keyed.read_through(s, 14_400_000))
    return found.select(F.col("number").alias("event_id"), "hit", "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'false positive' ELSE 'open' END AS state FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def versioned_findings(t):
    """Scans of customers in debt are deleted with their findings and urgent findings triaged, in one version; a writer
    that never commits leaves no trace."""
    from tracewright.sources.versions import Store

    store = Store(t.spark, fresh_path(t.spark, "store"))
    first = store.begin()
    first.append("scans", t.customer.select(F.col("c_custkey").alias("scan_id"), F.col("c_acctbal").alias("balance")))
    first.append("findings", t.orders.select("o_orderkey", F.col("o_custkey").alias("scan_id"), F.col("o_orderpriority").alias("priority"), F.lit("open").alias("state")))
    first.commit()
    change = store.begin()
    change.remove("findings", change.read("scans").where("balance < 0"), ["scan_id"])
    change.delete("scans", F.col("balance") < 0)
    change.update("findings", F.col("priority") == "1-URGENT", {"state": F.lit("false positive")})
    change.commit()
    store.begin().delete("findings", F.lit(True))
    return store.read("findings").select("o_orderkey", "state")


@query("""SELECT source AS scope, 'y' || n_chars % 10 || '/z' || doc_id % 7 || '/d' || doc_id || '.txt' AS path, CASE WHEN doc_id % 50 = 3 THEN 'changed' WHEN doc_id % 50 = 4 THEN 'new' ELSE 'deleted' END AS reason FROM documents WHERE doc_id % 50 IN (3, 4, 5)""")
def manifest_tree(t):
    """Files of documents in folders: what changed between two manifests, found through their stored trees."""
    from tracewright.sources import hashtree

    path = F.concat(F.lit("y"), F.col("n_chars") % 10, F.lit("/z"), F.col("doc_id") % 7, F.lit("/d"), "doc_id", F.lit(".txt"))
    files = t.documents.select(F.col("source").alias("scope"), path.alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    old = files.where("doc_id % 50 <> 4")
    new = files.where("doc_id % 50 <> 5").withColumn("sha256", F.when(F.col("doc_id") % 50 == 3, "other").otherwise(F.col("sha256")))
    places = [fresh_path(t.spark, "tree"), fresh_path(t.spark, "tree")]
    for manifest, place in zip((old, new), places, strict=True):
        hashtree.save_tree(manifest, place)
    return hashtree.diff(old, new, *[hashtree.load_tree(t.spark, p) for p in places])
