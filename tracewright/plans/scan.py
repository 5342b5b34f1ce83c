"""From files to findings: the whole analysis as one composition of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators import detect, graph, hubs, parse, rules, taint
from tracewright.operators.findings import changed_files, collapse_groups
from tracewright.session import spread, stash
from tracewright.sources.files import detect_framework, manifest, select_files

FINDING = ["scope", "analyzer", "vuln_class", "severity", "confidence", "source_file", "source_line", "sink_file", "sink_line"]


def verdicts(paths: DataFrame) -> DataFrame:
    """The default scorer: confidence and exploitability by the sanitizers of each path."""
    scored = paths.withColumn("_v", scoring.sanitizer_verdict(F.transform("sans", lambda s: s["power"])))
    return scored.withColumns({"llm_confidence": F.col("_v.llm_confidence"), "exploitable": F.col("_v.exploitable")}).drop("_v")


def analyse(files: DataFrame, catalogue: DataFrame, framework: str | None = None, fold: bool = True, scorer: Callable[[DataFrame], DataFrame] = verdicts, as_hubs: bool = False, parsed: DataFrame | None = None, frameworks: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Tables nodes, edges, folded, paths, steps, findings, excluded and errors of ``files``.

    Without ``framework`` the profile of each scope is that of the framework its
    first files show.  With ``fold`` chains of nodes that only hand a value on
    are contracted before the search and put back into the paths after it.
    ``scorer`` judges the paths (see :func:`correlate`).
    With ``as_hubs`` edges are never written as pairs of definitions and uses:
    folding and the search walk hubs, and the search has no budget of pops.
    Patterns of the base rules hold nodes back from folding, those of a
    framework's profile don't.
    ``parsed`` (rows of :func:`parse.parse_files`) saves parsing, ``frameworks``
    (scope, framework) detecting them.
    ``options`` go to the fixpoint: threshold, max_len, max_pops, label_scope,
    prune; the search is whole unless max_len or max_pops bounds it.
    """
    judged = select_files(files)
    kept = stash(spread(judged.where("reason IS NULL").drop("reason"), "scope", "path"), "files")  # parsed, searched by lines and looked up
    if parsed is None:
        parsed = stash(parse.parse_files(kept), "parsed")
    bare = parse.node_table(parsed, kept)
    if framework is None:
        bare = bare.join(detect_framework(kept) if frameworks is None else frameworks, "scope", "left")
    nodes = stash(rules.annotate(bare, catalogue, framework), "nodes")
    tables = parse.func_table(parsed), parse.import_table(parsed), parse.module_table(kept)
    patterns = [r["pattern"] for r in catalogue.where("framework IS NULL").select("pattern").distinct().collect()]  # some hundreds
    none = nodes.select("scope", "node_id").where("false")
    if as_hubs:
        held = stash(hubs.project_hubs(nodes, *tables), "hubs")
        edges = hubs.pairs(held).select("scope", "src", "dst", F.lit("data_dep").alias("edge_type"), F.array(F.col("stage").cast("bigint"), "dst").alias("edge_ord"))  # made only if asked for
        thru = hubs.passthrough_nodes(nodes, held, patterns) if fold else none
        folded, rest = hubs.fold_hubs(held, thru)
        options = options | {"max_pops": None, "hubs": rest}
    else:
        edges = stash(graph.project_edges(nodes, *tables), "edges")
        thru = graph.passthrough_nodes(nodes, edges, patterns) if fold else none
        folded = graph.fold_chains(edges, thru)
    folded = stash(folded, "folded")
    anchors = nodes.join(thru, ["scope", "node_id"], "left_anti")
    paths = taint.prededup_paths(taint.dedup_paths(taint.taint_paths(anchors, folded, **options), nodes))
    paths = stash(paths.withColumn("path_id", F.sha2(F.concat_ws("|", "scope", "label", "source_id", "sink_id", "vuln_class"), 256)), "paths")
    return {
        "parsed": parsed, "nodes": nodes, "edges": edges, "folded": folded, "fold_ratio": graph.fold_ratio(nodes, folded), "paths": paths, "steps": steps_of(paths, folded, nodes),
        "findings": correlate(paths, nodes, scorer).unionByName(detector_findings(kept), allowMissingColumns=True), "errors": parse.error_table(parsed), "excluded": excluded_names(judged),
    }


def steps_of(paths: DataFrame, folded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node of every path, folded ones put back, in order, for display."""
    unfolded = graph.unfold_paths(paths, folded, "path_id")
    walked = paths.select("scope", "path_id", F.posexplode("path").alias("i", "node_id")).join(nodes.select("scope", "node_id", F.col("san_power").isNotNull().alias("clean")), ["scope", "node_id"])
    so_far = Window.partitionBy("scope", "path_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of one path, which is one row
    kind = F.when(F.max(F.col("clean") & (F.col("i") > 0)).over(so_far), taint.PARTIAL).otherwise(taint.TAINTED)
    kinds = walked.withColumn("type", kind).groupBy("scope", "path_id", "node_id").agg(F.max_by("type", "i").alias("type"))
    return graph.path_steps(unfolded, nodes, kinds, "path_id")


def excluded_names(judged: DataFrame) -> DataFrame:
    """scope, reason and path of the files that were left out."""
    return judged.where("reason IS NOT NULL").select("scope", "reason", "path")


def correlate(paths: DataFrame, nodes: DataFrame, scorer: Callable[[DataFrame], DataFrame] = verdicts) -> DataFrame:
    """Paths to scored, classified and deduplicated findings.

    ``scorer`` adds ``llm_confidence`` (null where it has no answer, which the
    default's takes the place of) and ``exploitable`` to the paths.
    """
    paths = paths.join(nodes.select("scope", F.col("node_id").alias("sink_id"), F.col("code").alias("sink_code")), ["scope", "sink_id"], "left")
    out = verdicts(paths).withColumnsRenamed({"llm_confidence": "_confidence", "exploitable": "_exploitable"})
    if scorer is verdicts:
        out = out.withColumnsRenamed({"_confidence": "llm_confidence", "_exploitable": "exploitable"})
    else:
        out = scorer(out).withColumns({"llm_confidence": F.coalesce("llm_confidence", "_confidence"), "exploitable": F.coalesce("exploitable", "_exploitable")}).drop("_confidence", "_exploitable")
    t, m, e = F.col("confidence"), F.col("llm_confidence"), F.col("exploitable")
    combined = scoring.fused(t, m)
    out = out.withColumns({
        "taint_confidence": t, "combined": combined, "is_true_positive": scoring.is_true_positive(t, m, e), "is_false_positive": scoring.is_false_positive(t, m, e),
        "severity": scoring.adjusted_severity(F.col("severity"), combined, e), "analyzer": F.lit("taint"),
    })
    out = out.withColumn("confidence", F.bround("combined", 2)).drop("combined")
    best = taint.best_per_key(out, ["scope", "source_file", "source_line", "sink_file", "sink_line", "vuln_class"], "confidence", "ord")
    one = collapse_groups(best, ["scope", "sink_file", "sink_line", "vuln_class"], "confidence", ["ord"])
    named = scoring.classify(one).withColumn("title", F.concat("class_title", F.lit(" in "), text.basename(F.col("source_file"))))
    named = named.withColumn("description", scoring.description(F.col("sink_code"), F.col("dedup_count")))
    return named.withColumn("id", F.sha2(F.concat_ws("|", "scope", "source_file", "source_line", "sink_file", "sink_line", "vuln_class"), 256))


def detector_findings(files: DataFrame) -> DataFrame:
    """Findings of the line detectors, with their fixed severities and confidences."""
    lines = detect.file_lines(files)
    race = detect.race_findings(lines).select("scope", F.lit("race").alias("analyzer"), F.lit("race_condition").alias("vuln_class"), F.lit("medium").alias("severity"), F.lit(0.7).alias("confidence"), F.col("file").alias("source_file"), F.col("check_at").alias("source_line"), F.col("file").alias("sink_file"), F.col("act_at").alias("sink_line"))
    second = detect.second_order_findings(lines).select("scope", F.lit("second_order").alias("analyzer"), "vuln_class", F.lit("high").alias("severity"), F.lit(0.6).alias("confidence"), F.col("write_file").alias("source_file"), F.col("write_line").alias("source_line"), F.col("file").alias("sink_file"), "sink_line")
    auth = detect.auth_findings(lines, files).select("scope", F.lit("auth").alias("analyzer"), F.lit("auth_bypass").alias("vuln_class"), F.lit("high").alias("severity"), F.lit(0.65).alias("confidence"), F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), F.col("file").alias("sink_file"), F.col("line_no").alias("sink_line"))
    return race.unionByName(second).unionByName(auth)


def incremental(files: DataFrame, old_manifest: DataFrame) -> DataFrame:
    """Files that are new or changed since the manifest (scope, path, sha256), of any language."""
    new = changed_files(old_manifest, manifest(files)).where("reason <> 'deleted'")
    return files.join(new.select("scope", "path"), ["scope", "path"], "left_semi")


def gate(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """Annotations for continuous integration: level, file, line, message, blocking."""
    number = scoring.rank(F.col("severity"))
    level = F.when(number >= 3, "error").when(number == 2, "warning").otherwise("notice")
    message = F.format_string("%s (%d%%)", F.col("vuln_class"), (F.col("confidence") * 100).cast("int"))
    return findings.select("scope", level.alias("level"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), message.alias("message"), (number >= scoring.SEVERITIES.index(threshold)).alias("blocking"))
