"""Sources: directories, payloads, external findings; sinks: tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators.findings import running_prefix
from tracewright.operators.order import ranked
from tracewright.session import drop_path

MARKER = r"(?m)^#\s*={3,}\s*FILE:\s*(.+?)\s*={3,}\s*$"


def scan_directory(spark: SparkSession, path: str, scope: str = "scan") -> DataFrame:
    """files of a directory tree: only known extensions are read, and sorted."""
    globs = "{" + ",".join(f"*{e}" for e in text.EXTENSIONS) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(path)
    source = F.decode("content", "UTF-8")
    return _files(raw.select(F.lit(scope).alias("scope"), F.col("path"), source.alias("source"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256")))


def _files(df: DataFrame) -> DataFrame:
    """``df`` with language, n_lines and ``ord``, the place of the path in its scope.

    Only paths are sorted and ranked; the texts meet their rank in a join.
    """
    order = ranked(df.select("scope", "path"), ["scope"], ["path"]).select("scope", "path", F.col("_rank").cast("bigint").alias("ord"))
    made = df.withColumns({"language": text.language(F.col("path")), "n_lines": F.size(text.line_array(F.col("source")))})
    return made.join(order, ["scope", "path"])


def inline_file(spark: SparkSession, code: str, scope: str = "scan") -> DataFrame:
    return split_payload(spark.createDataFrame([(scope, code)], "scope string, payload string"))


def split_payload(df: DataFrame) -> DataFrame:
    """Payloads (scope, payload) to files by their markers.

    Only the base name of a marker counts; .py is added to names without a
    known ending; of equal names the last stays; text before the first marker
    goes; a payload without marker is ``scan_target.py``.
    """
    names = F.regexp_extract_all("payload", F.lit(MARKER), F.lit(1))
    bodies = F.split("payload", MARKER, -1)
    marked = df.where(F.size(names) > 0).select("scope", F.posexplode(F.arrays_zip(names.alias("name"), F.slice(bodies, 2, F.size(names)).alias("source"))).alias("n", "f"))
    base = F.regexp_extract(F.trim(F.col("f.name")), r"([^/]*)$", 1)
    safe = F.when(base.rlike(r"\.(py|js|ts|jsx|tsx)$"), base).otherwise(F.concat(base, F.lit(".py")))
    last = marked.select("scope", safe.alias("path"), "n", F.col("f.source").alias("source")).groupBy("scope", "path").agg(F.max_by("source", "n").alias("source"))
    plain = df.where(F.size(names) == 0).select("scope", F.lit("scan_target.py").alias("path"), F.col("payload").alias("source"))
    out = last.unionByName(plain).withColumns({"n_bytes": F.octet_length("source").cast("bigint"), "sha256": F.sha2("source", 256)})
    return _files(out)


def select_files(files: DataFrame, max_bytes: int = text.MAX_FILE_BYTES, max_lines: int = text.MAX_FILE_LINES) -> DataFrame:
    """``files`` with the ``reason`` of their exclusion, null for those to parse."""
    reason = F.coalesce(text.exclusion_reason(F.concat(F.lit("/"), F.col("path")), F.col("n_bytes"), max_bytes=max_bytes), F.when(F.col("n_lines") > max_lines, "too_many_lines"))
    return files.withColumn("reason", reason)


def detect_framework(files: DataFrame, first: int = 50, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """scope, framework of the first ``first`` files; no row where there is none."""
    names = [n for n, _ in (text.FRAMEWORKS if patterns is None else patterns)]
    found = files.where(F.col("ord") <= first).withColumn("_n", text.framework_number(F.col("source"), patterns)).groupBy("scope").agg(F.min("_n").alias("_n")).where("_n IS NOT NULL")
    return found.select("scope", F.get(F.array(*[F.lit(n) for n in names]), F.col("_n")).alias("framework"))


# What the bundlers take and leave out.
BUNDLED = [".py", ".js", ".ts", ".jsx", ".tsx"]
LEFT_OUT = ["node_modules", "__pycache__", ".venv", "venv"]
LEFT_OUT_CI = ["node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", ".next", "coverage"]


def bundled(path: Column, extensions: list[str] | None = None, parts: list[str] | None = None, hidden: bool = True) -> Column:
    """Whether a bundler takes the file: a known ending, no part of its path left out or, with ``hidden``, dotted."""
    names = F.split(path, r"[/\\]")
    out = F.exists(names, lambda x: x.isin(*(LEFT_OUT if parts is None else parts)))
    if hidden:
        out = out | F.exists(names, lambda x: F.startswith(x, F.lit(".")))
    return F.substring_index(path, ".", -1).isin(*[e[1:] for e in extensions or BUNDLED]) & F.contains(path, F.lit(".")) & ~out


def chunk_text(path: Column, source: Column) -> Column:
    """A file as its marker and its text."""
    return F.concat(F.lit("# === FILE: "), path, F.lit(" ===\n"), source, F.lit("\n"))


def bundle(files: DataFrame, max_chars: int = 2_000_000) -> DataFrame:
    """Files in path order, as ``chunk``, up to the first that would pass ``max_chars``.

    Paths and sizes are ranked first; only the files that fit carry their text on.
    """
    sized = files.select("scope", "path", F.char_length(chunk_text(F.col("path").cast("string"), F.col("source"))).cast("bigint").alias("_chars"))
    fit = running_prefix(sized, ["scope"], ["path"], "_chars", max_chars).select("scope", "path")
    return files.join(fit, ["scope", "path"], "left_semi").withColumn("chunk", chunk_text(F.col("path").cast("string"), F.col("source")))


def bundle_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    """All files of the languages that continuous integration sends, with their place: by ending, then path."""
    endings = [e for e, name in text.EXTENSIONS.items() if name in languages]
    kept = files.where(bundled(F.col("path"), endings, LEFT_OUT_CI, hidden=False))
    nth = F.array_position(F.array(*[F.lit(e) for e in endings]), text.extension(F.col("path")))
    order = ranked(kept.select("scope", nth.alias("_e"), "path"), ["scope"], ["_e", "path"]).select("scope", "path", F.col("_rank").alias("place"))
    return kept.join(order, ["scope", "path"])


def external_findings(df: DataFrame, column: str = "json", keep: list[str] | None = None) -> DataFrame:
    """JSON documents with ``results`` to rows; a class from the rule's name."""
    schema = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,metadata:string>>>"
    keep = keep or []
    rows = df.select(*keep, F.posexplode(F.from_json(column, schema)["results"]).alias("ord", "r"))
    raw = F.get_json_object("r.extra.metadata", "$.cwe")
    cwe = F.coalesce(F.get_json_object("r.extra.metadata", "$.cwe[0]"), raw)
    return rows.select(*keep, "ord", F.coalesce("r.check_id", F.lit("")).alias("rule_id"), F.coalesce("r.path", F.lit("")).alias("file"), F.coalesce("r.start.line", F.lit(0)).alias("line"), F.coalesce("r.extra.message", F.lit("")).alias("message"), F.lower(F.coalesce("r.extra.severity", F.lit("WARNING"))).alias("severity"), scoring.rule_class(F.coalesce("r.check_id", F.lit(""))).alias("vuln_class"), cwe.alias("cwe"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("scope", "path", F.sha2(F.col("source"), 256).alias("sha256"))


def save_manifest(files: DataFrame, path: str) -> None:
    """The files' hashes, in one folder a scope; scopes that are there are replaced."""
    manifest(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


def load_manifest(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Saved hashes of all scopes or of one, of which only its folder is read."""
    saved = spark.read.schema("path string, sha256 string, scope string").parquet(path)
    return saved if scope is None else saved.where(F.col("scope") == scope)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*(partition or [])).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may differ in columns: those added later are null in older files."""
    return spark.read.option("mergeSchema", True).parquet(path)


def current_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The latest value of every column of an append-only log of updates.

    An update names the columns it sets and leaves the others null; nothing is
    rewritten, and readers see one row a key.
    """
    values = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values], F.max(order).alias(order))


def cached_result(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; where it is absent, it is made and written first."""
    if not object_exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_artifacts(df: DataFrame, path: str, name: str = "scan_id") -> None:
    """Rows as JSON objects, in one folder a scan."""
    df.write.mode("append").partitionBy(name).json(path)


def code_snapshot(files: DataFrame, limit: int = 10_000) -> DataFrame:
    """The beginning of each file that is kept with a scan."""
    return files.select("scope", "path", F.left("source", F.lit(limit)).alias("snapshot"), (F.char_length("source") > limit).alias("cut"))


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the objects below a prefix, listed without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def object_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete_prefix(spark: SparkSession, path: str) -> None:
    """Remove all objects below a prefix."""
    drop_path(spark, path)


def delete_scopes(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the rows of deleted scopes; the caller writes it anew."""
    return table.join(gone.select("scope").distinct(), "scope", "left_anti")
