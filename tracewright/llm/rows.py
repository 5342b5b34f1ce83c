"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a batch function gets at most, but for a longer single text.
BATCH_BYTES = 4 << 20


#: Bytes of rows that the executor hands to a worker at once, but for a longer single row.
ARROW_BYTES = 4 << 20
_held: dict[str, Callable[[], None]] = {}


def take_over(owner: str, drop: Callable[[], None] | None) -> None:
    """Drop what other operators left in this worker, which later stages use again; ``drop`` will drop the owner's."""
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    if others:
        give_back()
    if drop:
        _held[owner] = drop


def give_back() -> None:
    """Return freed memory of the worker to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only one C library has it
    if trim:
        trim(0)


def in_workers(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, owner: str = "", drop: Callable[[], None] | None = None, arrow_bytes: int = ARROW_BYTES) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded by bytes and nothing left behind in the workers but the owner's caches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", arrow_bytes)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(owner, drop)
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each weigh ``limit`` bytes at most."""
    for batch in batches:
        weight, first = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if weight and weight + n > limit:
                yield batch.slice(first, i - first)
                weight, first = 0, i
            weight += n
        if batch.num_rows > first:
            yield batch.slice(first)


def map_texts(df: DataFrame, text: str, out: T.StructType, fn: Callable[[pa.RecordBatch], dict], limit: int = BATCH_BYTES, owner: str = "", drop: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` (a batch to columns of ``out``) to bounded slices of ``df``."""
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            columns = fn(part)
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return in_workers(df, run, out, owner, drop)


def spare(keep: list[str], made: Iterable[str]) -> list[str]:
    """The columns to keep but for those that the operator makes anew."""
    taken = {m.lower() for m in made}
    return [c for c in keep if c.lower() not in taken]


def unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def of_rest(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text has this remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def numbered(scan: DataFrame, name: str = "rid") -> DataFrame:
    """``scan``, one read of files, with a 64-bit row id of the file's number and the row's place in it.

    The id says where a row is stored, so it is the same however the files are
    split and whichever executors read them.  The files' names reach the driver,
    as they do for any read.
    """
    placed = scan.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    files = sorted(r["_file"] for r in placed.select("_file").distinct().collect())
    table = scan.sparkSession.createDataFrame(list(enumerate(files)), "_nth bigint, _file string")
    out = placed.join(F.broadcast(table), "_file")  # a row for each file
    return out.withColumn(name, F.shiftleft("_nth", 40).bitwiseOR(F.col("_row"))).drop("_file", "_row", "_nth")
