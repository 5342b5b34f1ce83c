"""A data source for bundles: ``spark.read.format("bundle").load(folder)``.

A bundle is a text file of sections, each behind a line ``# === FILE: name ===``.
Files are split in byte ranges, and a task reads the sections whose marker
begins in its range, on beyond its end where the last one goes on; so a payload
of any size is split over tasks and read by line, and only one section at a
time is in memory.

Rows: ``bundle`` (the file), ``at`` (byte offset of the marker), ``name`` and
``source``.  Text before the first marker is a row with ``at`` -1 and without a
name; if it is empty there is none.  Filters ``bundle =`` and ``bundle IN`` leave other files unread;
``name =`` and ``name IN`` leave the texts of other sections behind in the reader.

A marker is one line (ended by a line feed, with or without a carriage
return); white space after it goes with it, up to the last line end before the
section's first visible character, or all of it where the file ends.  Bytes that aren't UTF-8 become U+FFFD.
Files whose names begin with ``_`` or ``.`` are left out; an empty folder has no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

_MARKER = re.compile(rb"^#[ \t\f\v]*={3,}[ \t\f\v]*FILE:[ \t\f\v]*(.+?)[ \t\f\v]*={3,}[ \t\f\v]*\r?\n?$")
_BLANK = re.compile(rb"[ \t\n\v\f\r]*")
_LINE_END = re.compile(rb"\r\n|\n|\r")


def _body(lines: list[bytes], tail: bytes, ended: bool) -> str:
    """A section's text: ``tail`` (the marker's line end) and its lines, less the leading white space that the marker takes.

    ``ended``: the file ends here, so the marker takes all of a blank section.
    """
    text = tail + b"".join(lines)
    blank = _BLANK.match(text)[0]
    if ended and len(blank) == len(text):
        return ""
    ends = [m.start() for m in _LINE_END.finditer(blank)]
    return text[ends[-1] if ends else 0 :].decode("utf-8", "replace")


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


class BundleReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.bundles: set[str] | None = None
        self.names: set[str] | None = None

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("file:", "/")) else (fs.LocalFileSystem(), self.path)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("bundle",), ("name",)):
                field = f.attribute[0] + "s"
                known = getattr(self, field)
                setattr(self, field, values if known is None else known & values)
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        where, root = self._open()
        found = where.get_file_info(fs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        if self.bundles is not None:
            files = [f for f in files if f.path in self.bundles]
        return [Range(f.path, i, min(i + self.split, f.size)) for f in files for i in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        where, _ = self._open()
        with where.open_input_file(partition.file) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            at = partition.begin
            if at:  # a line that begins before the range is the task's before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            yield from self._sections(f, at, partition)

    def _sections(self, f: io.BufferedReader, at: int, p: Range) -> Iterator[tuple]:
        name, start, lines, tail = None, -1, [], b""
        open_section = p.begin == 0  # the text before the first marker belongs to the first task

        def row(ended: bool) -> Iterator[tuple]:
            label = None if name is None else name.decode("utf-8", "replace")
            if open_section and (name is not None or lines) and (self.names is None or label in self.names):
                yield p.file, start, label, _body(lines, tail, ended) if name is not None else b"".join(lines).decode("utf-8", "replace")

        for line in f:
            found = _MARKER.match(line) if line.startswith(b"#") else None
            if (found or not open_section) and at >= p.end:
                yield from row(False)
                return
            if found:
                yield from row(False)
                name, start, lines, open_section = found[1], at, [], True
                tail = line[len(line.rstrip(b"\r\n")) :]
            elif open_section and (self.names is None or name is not None and name.decode("utf-8", "replace") in self.names):
                lines.append(line)
            at += len(line)
        yield from row(True)


class BundleSource(DataSource):
    """Options: ``path`` (a file or folder that all executors see) and ``splitBytes`` (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "bundle string, at bigint, name string, source string"

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("splitbytes", 64 << 20)))


def read_bundles(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Sections of all bundles below a path, filters pushed to the reader."""
    spark.dataSource.register(BundleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return spark.read.format("bundle").option("splitBytes", split_bytes).load(path)


def bundle_files(sections: DataFrame) -> DataFrame:
    """(scope, path, source) of sections: names and repeats as :func:`files.split_payload` has them.

    Only the base name counts; ``.py`` is added to names without a known
    ending; of equal names the last stays; a bundle without marker is
    ``scan_target.py``, text before the first marker goes.
    """
    base = F.regexp_extract(F.trim("name"), r"([^/]*)$", 1)
    safe = F.when(F.col("at") < 0, "scan_target.py").when(base.rlike(r"\.(py|js|ts|jsx|tsx)$"), base).otherwise(F.concat(base, F.lit(".py")))
    last = sections.select(F.col("bundle").alias("scope"), safe.alias("path"), "at", "source").groupBy("scope", "path", (F.col("at") < 0).alias("_plain")).agg(F.max_by("source", "at").alias("source"))
    marked = last.where("NOT _plain").select("scope").distinct()
    return last.where("NOT _plain").unionByName(last.where("_plain").join(marked, "scope", "left_anti")).drop("_plain")
