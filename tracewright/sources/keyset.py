"""Pages by key: sorted runs whose index leads a reader to the few files that hold a page.

A table is written in the order of its keys, in files of bounded rows, with an
index of a row a file: its first and last key, its number of rows and how many
stand before it.  A page by number or the rows after a key are then in a
bounded number of files, however far back they lie, where an offset would sort
all rows before them.

The order must be definite: its columns together tell rows apart (a tie would
fall on either page).  A column is ascending, or descending with ``-`` before
its name; nulls count as least, as in Spark's own order.  Pages beyond the end
are empty; an empty table has no pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.order import ranked

#: Rows of a file.
ROWS = 100_000


def _columns(order: list[str]) -> list[tuple[str, bool]]:
    return [(c[1:], True) if c.startswith("-") else (c, False) for c in order]


def _sorted_by(order: list[str], within: str = "") -> list[Column]:
    return [F.col(within + c).desc_nulls_last() if down else F.col(within + c).asc_nulls_first() for c, down in _columns(order)]


def _beyond(order: list[str], left: str, key: dict) -> Column:
    """Whether the columns ``left``... stand after ``key`` in the order, null being least."""
    out, equal = [], F.lit(True)
    for c, down in _columns(order):
        mine, other = F.col(left + c), F.lit(key[c])
        less, more = (mine, other) if down else (other, mine)
        out.append(equal & F.coalesce(less < more, less.isNull() & more.isNotNull()))
        equal = equal & mine.eqNullSafe(other)
    return reduce(lambda a, b: a | b, out)


def save_runs(df: DataFrame, path: str, order: list[str], rows: int = ROWS) -> None:
    """``df`` as sorted runs of ``rows`` rows at most, and their index."""
    spark = df.sparkSession
    keys = _sorted_by(order)
    runs = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs.write.option("maxRecordsPerFile", rows).parquet(f"{path}/runs")
    stored = spark.read.schema(df.schema).parquet(f"{path}/runs").select(F.struct(*[c for c, _ in _columns(order)]).alias("_k"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_i"))
    files = stored.groupBy("file").agg(F.min_by("_k", "_i").alias("first"), F.max_by("_k", "_i").alias("last"), F.count(F.lit(1)).alias("n"))
    # names tell the range and, in it, the file: part-00012-...-c003
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("int")
    files = files.withColumns({"_all": F.lit(0), "_range": number(r"^part-(\d+)"), "_nth": number(r"-c(\d+)\.")})
    places = ranked(files, ["_all"], ["_range", "_nth"], "n")
    places.select("file", "first", "last", "n", (F.col("_sum") - F.col("n")).alias("before")).coalesce(1).write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The rows of some files with ``_place``, their place in the whole order; read from these files alone."""
    names = [(r.file, r.before) for r in found.select("file", "before").collect()]
    schema = spark.read.parquet(f"{path}/runs").schema
    if not names:
        return spark.createDataFrame([], schema).withColumn("_place", F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).parquet(*[f"{path}/runs/{n}" for n, _ in names])
    before = F.coalesce(*[F.when(F.col("_metadata.file_name") == n, F.lit(b)) for n, b in names])
    return rows.withColumn("_place", (before + F.col("_metadata.row_index")).cast("bigint"))


def page_number(spark: SparkSession, path: str, order: list[str], number: int, size: int) -> DataFrame:
    """The page of a number, from 1: the files it lies in are read, rows are known by their place."""
    begin = (number - 1) * size
    rows = _files(spark, path, _index(spark, path).where((F.col("before") < begin + size) & (F.col("before") + F.col("n") > begin)))
    return rows.where((F.col("_place") >= begin) & (F.col("_place") < begin + size)).drop("_place").orderBy(*_sorted_by(order))


def page_after(spark: SparkSession, path: str, order: list[str], key: dict, size: int) -> DataFrame:
    """The ``size`` rows after ``key`` (a value for each column of the order)."""
    files = _index(spark, path)
    start = files.where(_beyond(order, "last.", key)).agg(F.min(F.struct("before", "n"))).first()[0]
    if start is None:
        return _files(spark, path, files.where("false")).drop("_place")
    # the first file that goes beyond the key holds one row of the page at least, those after it hold the rest
    found = files.where((F.col("before") >= start.before) & (F.col("before") < start.before + start.n + size))
    return _files(spark, path, found).where(_beyond(order, "", key)).orderBy(*_sorted_by(order)).limit(size).drop("_place")
