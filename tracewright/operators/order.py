"""Ranks and running totals over keys that may hold most of the rows.

A window by such a key would bring its rows to one task.  Here rows are range
sorted by key and order and written; ranks and totals are taken inside each
part, and the few keys that lie in several parts get the sums of the parts
before from a table that has two rows a part at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stash


def ranked(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``_rank`` (1, 2, ... in each key's order) and, with a weight, ``_sum`` (its running total)."""
    one = F.lit(0) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    rows = stash(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(one).alias("_w"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"_parts": F.count(F.lit(1)).over(by_key), "_n0": F.sum("_n").over(before), "_w0": F.sum("_w").over(before)}).where("_parts > 1 AND _n0 IS NOT NULL")
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), "_n0", "_w0")
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    out = rows.withColumn("_rank", F.row_number().over(inside))
    if weight is not None:
        out = out.withColumn("_sum", F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(F.broadcast(offsets), same, "left")  # two rows a part at most
    made = {"_rank": F.col("_rank") + F.coalesce("_n0", F.lit(0))}
    if weight is not None:
        made["_sum"] = F.col("_sum") + F.coalesce("_w0", F.lit(0))
    return out.withColumns(made).drop("_part", "_at", "_n0", "_w0", *[f"_k{i}" for i in range(len(keys))])
