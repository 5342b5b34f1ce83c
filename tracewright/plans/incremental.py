"""Analysis of what changed, against the stored result of the last one.

Files that share a symbol (a function one defines and the other calls, a module
one is and the other imports, a key one stores and the other reads) may have
edges to each other.  No path leaves the files that such links connect, so a
change can only touch findings of the files that are connected, before or after
it, to a changed, new or deleted file.  Those findings are deleted and derived
anew; the others stay as they are stored.

Only changed and new files are parsed; the rows of all others are stored.  The
closure over links walks file, symbol, file, ... as rows of (file, symbol), a
join and a write a step; a symbol that no file provides links nothing.  Where a
change turns the profile of a scope's framework, all its files are affected.
The detectors read lines, not trees, and look at a scope as a whole (a write of
one file goes with the reads of the others); they run over the changed scopes.

The result equals that of a whole analysis without a budget of pops (a budget
is spent over a scope as a whole, so what it cuts depends on all its files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import graph, parse
from tracewright.operators.findings import changed_files
from tracewright.plans import scan
from tracewright.session import drop_stash, spread, stash
from tracewright.sources.files import detect_framework, manifest, select_files

#: Columns of findings that name no node: nodes are renumbered when files come and go.
FINDING = ["scope", "analyzer", "vuln_class", "severity", "confidence", "source_file", "source_line", "sink_file", "sink_line", "title", "description", "dedup_count"]
TABLES = ["manifest", "parsed", "symbols", "frameworks", "findings"]


def symbols(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, file, symbol, provides) of parsed rows and of the files themselves."""
    nodes = parse.node_table(parsed, files)
    named = lambda df, kind, column, gives: df.select("scope", "file", F.concat_ws(":", F.lit(kind), column).alias("symbol"), F.lit(gives).alias("provides"))
    out = named(parse.func_table(parsed), "func", "name", True)
    out = out.unionByName(named(graph.parsed_calls(nodes), "func", "func", False))
    out = out.unionByName(named(parse.module_table(files).withColumnRenamed("path", "file"), "module", "stem", True))
    out = out.unionByName(named(parse.import_table(parsed), "module", "module_stem", False))
    store = graph.store_key(F.col("code"))
    out = out.unionByName(named(nodes.withColumn("key", store).where("key IS NOT NULL"), "key", "key", True))
    out = out.unionByName(named(nodes.where(store.isNull()).withColumn("key", F.explode(graph.read_keys(F.col("code")))), "key", "key", False))
    return out.where("symbol IS NOT NULL").distinct()


def closure(changed: DataFrame, links: DataFrame) -> DataFrame:
    """All files (scope, file) that links (scope, file, symbol) connect to the ``changed`` ones, those included."""
    links = stash(links, "links")
    reached = stash(changed.select("scope", "file").distinct(), "affected")
    front, walked = reached, links.select("scope", "symbol").where("false")
    while not front.isEmpty():
        met = stash(links.join(front, ["scope", "file"], "left_semi").select("scope", "symbol").distinct().join(walked, ["scope", "symbol"], "left_anti"), "symbols")
        walked = walked.unionByName(met)
        front = stash(links.join(met, ["scope", "symbol"], "left_semi").select("scope", "file").distinct().join(reached, ["scope", "file"], "left_anti"), "front")
        whole = stash(reached.unionByName(front), "affected")
        drop_stash(reached if reached is not front else None)
        reached = whole
    return reached


def _linking(held: DataFrame) -> DataFrame:
    """Symbols that a file provides."""
    return held.select("scope", "file", "symbol").join(held.where("provides").select("scope", "symbol").distinct(), ["scope", "symbol"], "left_semi")


def whole(files: DataFrame, catalogue: DataFrame, **options) -> dict[str, DataFrame]:
    """The tables of :data:`TABLES` for all files; ``findings`` is the result, all are what :func:`update` starts from."""
    kept = select_files(files).where("reason IS NULL").drop("reason")
    parsed = stash(parse.parse_files(spread(kept, "scope", "path")), "parsed")
    frameworks = stash(detect_framework(kept), "frameworks")
    out = scan.analyse(files, catalogue, parsed=parsed, frameworks=frameworks, **({"max_pops": None} | options))
    return {"manifest": manifest(files), "parsed": parsed, "symbols": stash(symbols(parsed, kept), "symbols"), "frameworks": frameworks, "findings": stash(_shown(out["findings"]), "findings")}


def _shown(findings: DataFrame) -> DataFrame:
    """Findings by the places they name; those of detectors have no title."""
    return findings.select(*[F.col(c) for c in FINDING])


def update(files: DataFrame, catalogue: DataFrame, before: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    """The tables for ``files`` from those ``before``, and ``changed`` and ``affected`` files.

    ``before`` may be read from where :func:`store` wrote it.
    """
    kept = select_files(files).where("reason IS NULL").drop("reason")
    now = manifest(files)
    changed = stash(changed_files(before["manifest"], now).select("scope", F.col("path").alias("file"), "reason"), "changed")
    renewed = kept.join(changed.select("scope", F.col("file").alias("path")), ["scope", "path"], "left_semi")
    fresh = parse.parse_files(spread(renewed, "scope", "path"))
    # stored rows of unchanged files, with the place that the files have now
    place = kept.select("scope", F.col("path").alias("file"), F.col("ord").cast("bigint").alias("_ord"))
    stored = before["parsed"].join(changed, ["scope", "file"], "left_anti").join(place, ["scope", "file"]).withColumn("file_ord", F.col("_ord")).drop("_ord")
    parsed = stash(stored.unionByName(fresh.select(*stored.columns)), "parsed")
    # only the symbols of parsed files are made anew
    new = stash(symbols(parsed.join(changed, ["scope", "file"], "left_semi"), renewed), "new-symbols")
    old = before["symbols"]
    held = stash(old.join(changed, ["scope", "file"], "left_anti").unionByName(new), "symbols")
    frameworks = stash(detect_framework(kept), "frameworks")
    turned = frameworks.withColumnRenamed("framework", "_now").join(before["frameworks"], "scope", "full_outer").where(~F.col("_now").eqNullSafe(F.col("framework"))).select("scope")
    begun = changed.select("scope", "file").unionByName(place.join(turned, "scope", "left_semi").select("scope", "file"))
    affected = closure(begun, _linking(old).unionByName(_linking(held)).distinct())
    again = files.join(affected.select("scope", F.col("file").alias("path")), ["scope", "path"], "left_semi")
    found = scan.analyse(again, catalogue, parsed=parsed.join(affected, ["scope", "file"], "left_semi"), frameworks=frameworks, **({"max_pops": None} | options))["findings"].where("analyzer = 'taint'")
    taint = before["findings"].where("analyzer = 'taint'").join(affected.withColumnRenamed("file", "sink_file"), ["scope", "sink_file"], "left_anti").select(*FINDING).unionByName(_shown(found))
    touched = changed.select("scope").distinct()
    lines = scan.detector_findings(kept.join(touched, "scope", "left_semi"))
    blank = {c: F.lit(None).cast(before["findings"].schema[c].dataType) for c in FINDING if c not in lines.columns}
    detectors = before["findings"].where("analyzer <> 'taint'").join(touched, "scope", "left_anti").select(*FINDING).unionByName(lines.withColumns(blank).select(*FINDING))
    return {"manifest": now, "parsed": parsed, "symbols": held, "frameworks": frameworks, "findings": stash(taint.unionByName(detectors), "findings"), "changed": changed, "affected": affected}


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write what the next :func:`update` needs below a path of its own."""
    for name in TABLES:
        tables[name].write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
