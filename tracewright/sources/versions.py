"""Tables with versions: changes of several tables that are seen together or not at all.

A store is a folder with ``data`` (Parquet files, never changed once written)
and ``log`` (one small JSON file a version: for each table its columns and the
folder of its list of files).  A transaction writes new data files, then the
lists, and last of all the log file of the next version, which it makes by a
rename that fails if the file is there.  Readers take the last version of the
log, so a writer that is killed before that rename has changed nothing, and of
two writers that began with the same version the second one gets a
:class:`Conflict`.

Deletes and updates are copy-on-write: only files that hold a row they touch
(``_metadata.file_path``) are read and written anew; the others are listed
again as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.session import _hadoop


class Conflict(RuntimeError):
    """Another writer has made the version that this transaction began before."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, where = _hadoop(self.spark, f"{self.path}/log")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def _entry(self, version: int | None) -> tuple[int, dict]:
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/log/{version:020d}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def files(self, name: str, version: int | None = None) -> DataFrame:
        """The list of a table's files: ``file``."""
        entry = self._entry(version)[1].get(name)
        if entry is None:
            raise KeyError(name)
        return self.spark.read.schema("file string").parquet(entry["list"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (default: the last one)."""
        entry = self._entry(version)[1].get(name)
        if entry is None:
            raise KeyError(name)
        return self._of(self.spark.read.schema("file string").parquet(entry["list"]), StructType.fromJson(entry["schema"]))

    def _of(self, files: DataFrame, schema: StructType) -> DataFrame:
        names = [r["file"] for r in files.collect()]  # names of files, as the driver holds for any scan
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Changes of a store's tables, each made on what the ones before it left; :meth:`commit` shows all of them at once."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.version, self.tables = store._entry(None)

    def _schema(self, name: str) -> StructType:
        return StructType.fromJson(self.tables[name]["schema"])

    def _files(self, name: str) -> DataFrame:
        return self.spark.read.schema("file string").parquet(self.tables[name]["list"])

    def read(self, name: str) -> DataFrame:
        """The table as this transaction sees it."""
        return self.store._of(self._files(name), self._schema(name))

    def _list(self, name: str, files: DataFrame, schema: StructType) -> None:
        path = f"{self.store.path}/lists/{uuid.uuid4().hex}"
        files.write.parquet(path)
        self.tables = self.tables | {name: {"list": path, "schema": schema.jsonValue()}}

    def _write(self, df: DataFrame) -> DataFrame:
        """The files that ``df`` makes."""
        path = f"{self.store.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return found.select(F.col("path").alias("file"))  # names only, contents are not read

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; the first ones make the table.  Columns go by name, those that are missing are null."""
        if name not in self.tables:
            self._list(name, self._write(df), df.schema)
            return
        schema = self._schema(name)
        fitted = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        self._list(name, self._files(name).unionByName(self._write(fitted)), schema)

    def _rewrite(self, name: str, touched: DataFrame, change) -> None:
        """Replace the files that ``touched`` rows lie in by what ``change`` makes of them."""
        schema, files = self._schema(name), self._files(name)
        hit = touched.select(F.col("_file").alias("file")).distinct()
        rest = files.join(hit, "file", "left_anti")
        old = files.join(hit, "file", "left_semi")
        if old.isEmpty():
            return
        self._list(name, rest.unionByName(self._write(change(self.store._of(old, schema)))), schema)

    def _placed(self, name: str) -> DataFrame:
        return self.read(name).withColumn("_file", F.col("_metadata.file_path")) if not self._files(name).isEmpty() else self.read(name).withColumn("_file", F.lit(""))

    def delete(self, name: str, condition: Column) -> None:
        """Remove the rows for which the condition is true."""
        self._rewrite(name, self._placed(name).where(condition), lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))

    def remove(self, name: str, gone: DataFrame, on: list[str]) -> None:
        """Remove the rows whose ``on`` columns are in ``gone`` (a cascade)."""
        keys = gone.select(*on).distinct()
        self._rewrite(name, self._placed(name).join(keys, on, "left_semi"), lambda rows: rows.join(keys, on, "left_anti"))

    def update(self, name: str, condition: Column, values: dict[str, Column]) -> None:
        """Set columns of the rows for which the condition is true."""
        hit = F.coalesce(condition, F.lit(False))
        change = lambda rows: rows.select(*[(F.when(hit, values[f.name]).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
        self._rewrite(name, self._placed(name).where(condition), change)

    def commit(self) -> int:
        """Make the next version; raises :class:`Conflict` if another writer has made it."""
        number = self.version + 1
        fs, target = _hadoop(self.spark, f"{self.store.path}/log/{number:020d}.json")
        if number in self.store.versions():
            raise Conflict(number)
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(target.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.store.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(self.tables).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(number)
        self.version = number
        return number
