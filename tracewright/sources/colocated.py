"""Stored scans that are compared without a shuffle.

A scan is stored with a key table beside its findings: a row for each distinct
key, bucketed and sorted by the key as one text.  The key tables of any two
scans with the same number of buckets lie bucket by bucket together, so a
comparison is a merge join of sorted files, with no exchange and no row of a
frequent key twice.  The shuffle is paid once, when a scan is stored, and sends
one row a key and task.

Bucketed tables need a catalogue; the tables are external, their files lie in
the folder given.  Null key columns are equal to each other and to nothing
else; an empty scan has no keys, so all of the other side is new or resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_text(keys: list[str]) -> Column:
    """The key columns as one text, from which they could be read back: null apart, values behind their length."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.char_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in keys])


def save_scan(findings: DataFrame, name: str, path: str, keys: list[str], buckets: int = 64) -> None:
    """Store ``findings`` below ``path`` and their keys as the table ``name``.

    ``buckets`` is to be the same for all scans that are compared, and such that
    the keys of the largest one fill each with some hundred MB.
    """
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    stored = findings.sparkSession.read.schema(findings.schema).parquet(f"{path}/findings")
    distinct = stored.withColumn("_key", key_text(keys)).groupBy("_key").agg(*[F.first(c).alias(c) for c in keys], F.count(F.lit(1)).alias("n"))
    spread = distinct.repartition(buckets, "_key")  # one file a bucket
    spread.write.bucketBy(buckets, "_key").sortBy("_key").mode("overwrite").option("path", f"{path}/keys").format("parquet").saveAsTable(name)


def compare_saved(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """Keys of two stored scans with ``bucket`` (new, resolved or unchanged), ``n_old`` and ``n_new``."""
    a, b = spark.table(old), spark.table(new)
    # the hint keeps the small side of two unlike scans from a broadcast, which would still be right
    met = a.hint("merge").join(b, a["_key"] == b["_key"], "full")
    bucket = F.when(a["_key"].isNull(), "new").when(b["_key"].isNull(), "resolved").otherwise("unchanged")
    number = lambda t: F.coalesce(t["n"], F.lit(0)).alias
    values = [F.when(a["_key"].isNull(), b[k]).otherwise(a[k]).alias(k) for k in keys]
    return met.select(*values, bucket.alias("bucket"), number(a)("n_old"), number(b)("n_new"))


def drop_scan(spark: SparkSession, name: str) -> None:
    """Forget a stored scan; its files go with their folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
