"""Session helpers shared by operators that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the tables read for one part where :func:`spread` deals rows out.
PART_BYTES = 32 << 20
#: Of a join's rows, keys that hold more than one part in so many go by broadcast.
SHARES = 4096


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting
    is absent and all runs on one machine (tests, notebooks) is a temporary
    folder chosen and recorded; executors elsewhere would each write to their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    fs, where = _hadoop(spark, folder)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor.  The table
    lasts until :func:`drop_stash` or the end of the application.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def spread(df: DataFrame, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` dealt out by ``keys``, one part for each core at least.

    For rows that are small but cost much each, as files to parse: by their bytes
    alone they would all be one task.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # the greatest number stands for those that are not known
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), *keys)


def drop_stash(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`stash` that nothing lazy reads any more."""
    for df in tables:
        if df is not None and getattr(df, "stash_path", None):
            drop_path(df.sparkSession, df.stash_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table; missing paths are fine."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def join_skewed(left: DataFrame, right: DataFrame, key: str, total: int, count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and, in ``count``,
    the number of left rows of that key (``total`` in all).

    Keys with more than one part in :data:`SHARES` of the rows are fewer than
    that many and are broadcast, so the rows of no key meet in one task.
    """
    hot = F.col(count) * SHARES > total
    often, seldom = right.where(hot).drop(count), right.where(~hot).drop(count)
    rest = left.join(F.broadcast(often.select(key)), key, "left_anti")
    return left.join(F.broadcast(often), key).unionByName(rest.join(seldom, key, how), allowMissingColumns=True)
