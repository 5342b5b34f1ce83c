"""Findings: dedup, comparison, matching, ranking, statistics and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators.order import ranked


def collapse_groups(df: DataFrame, keys: list[str], score: str, tie: list[str], threshold: int = 3) -> DataFrame:
    """Groups of ``threshold`` rows or more keep their best row; ``dedup_count`` is the size kept for."""
    order = [F.col(score).desc(), *tie]
    # a group is cut in parts first, so that a hot sink's rows don't meet in one task: few of each part go on, with its count
    part = Window.partitionBy(*keys, "_part")
    dealt = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    few = dealt.withColumns({"_c": F.count(F.lit(1)).over(part), "_r": F.row_number().over(part.orderBy(*order))}).where(F.col("_r") < max(2, threshold))
    group = Window.partitionBy(*keys)
    out = few.withColumns({"_n": F.sum(F.when(F.col("_r") == 1, F.col("_c"))).over(group), "_best": F.row_number().over(group.orderBy(*order))}).where((F.col("_n") < threshold) | (F.col("_best") == 1))
    return out.withColumn("dedup_count", F.when(F.col("_n") < threshold, 1).otherwise(F.col("_n")).cast("long")).drop("_n", "_r", "_c", "_best", "_part")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v")).select(*keys, "_v.*")


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``bucket``: new, resolved or unchanged, in one pass over both sides."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(1)).withColumn("_new", F.lit(0))
    b = new.select(*keys).distinct().withColumn("_old", F.lit(0)).withColumn("_new", F.lit(1))
    both = a.unionByName(b).groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return both.withColumn("bucket", F.when(F.col("_old") == 0, "new").when(F.col("_new") == 0, "resolved").otherwise("unchanged")).drop("_old", "_new")


def differential(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: int = 5, condition: Column | None = None) -> DataFrame:
    """Left rows with their first match within ``tolerance`` places.

    ours: keys, id, line; theirs: keys, other_id, other_line, other_ord.  Result:
    bucket (overlap, ours_only, theirs_only), id, other_id.  Lines are dealt by
    ``line // (tolerance + 1)``; a left row looks in three buckets.
    """
    step = tolerance + 1
    left = ours.withColumn("_b", F.floor(F.col("line") / step)).withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    right = theirs.withColumn("_b", F.floor(F.col("other_line") / step))
    close = F.abs(F.col("line") - F.col("other_line")) <= tolerance
    pairs = left.join(right, [*keys, "_b"]).where(close if condition is None else close & condition)
    matched = pairs.groupBy("id").agg(F.min_by("other_id", "other_ord").alias("other_id"))
    lefts = ours.select("id").join(matched, "id", "left").select(F.when(F.col("other_id").isNull(), "ours_only").otherwise("overlap").alias("bucket"), "id", "other_id")
    rest = theirs.select("other_id").join(matched.select("other_id").distinct(), "other_id", "left_anti")
    return lefts.unionByName(rest.select(F.lit("theirs_only").alias("bucket"), F.lit(None).cast(ours.schema["id"].dataType).alias("id"), "other_id"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """scope, path, reason (new, changed, deleted) of two manifests (scope, path, sha256)."""
    a = old.select("scope", "path", F.col("sha256").alias("_old"))
    both = new.select("scope", "path", "sha256").join(a, ["scope", "path"], "full_outer")
    reason = F.when(F.col("_old").isNull(), "new").when(F.col("sha256").isNull(), "deleted").when(F.col("_old") != F.col("sha256"), "changed")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("scope", "path", "reason")


def mode(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """The most frequent value, the least of equal ones, or a default for an empty table: one row."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(1)
    return top.agg(F.coalesce(F.first(column), F.lit(default)).alias(column), F.coalesce(F.first("n"), F.lit(0)).alias("n"))


def weakness_ids(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The distinct weakness numbers that the texts of a key name, sorted: ``ids``."""
    named = df.select(*keys, F.explode(F.regexp_extract_all(column, F.lit(r"(CWE-\d+)"), F.lit(1))).alias("_id"))
    return named.groupBy(*keys).agg(F.array_sort(F.collect_set("_id")).alias("ids"))


def usage(calls: DataFrame, by: list[str], tokens: str, cached: Column) -> DataFrame:
    """Tokens, calls and answers from the cache."""
    return calls.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.count_if(cached).alias("cache_hits"))


def severity_cube(df: DataFrame, by: str, severity: str = "severity") -> DataFrame:
    """Counts by severity, and by severity within ``by`` (``g`` 0), in one pass."""
    return df.groupingSets([[by, severity], [severity]], by, severity).agg(F.grouping(by).cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, said: str, true: str) -> DataFrame:
    """How often each verdict meets each truth."""
    return df.groupBy(said, true).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, said: Column, true: Column) -> DataFrame:
    """tp, fp, fn, tn of a verdict, in one row."""
    return df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def scan_responses(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with what is told of their findings: counts by severity and the gravest."""
    told = severity_counts(findings, by=["scan_id"]).join(max_severity(findings, ["scan_id"]), "scan_id")
    counts = ["total", "critical", "high", "medium", "low"]
    return scans.join(told, "scan_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def find(findings: DataFrame, scan: str | None = None, severity: str | None = None, vuln_class: str | None = None) -> DataFrame:
    """Findings of a scan, optionally of one severity and class."""
    for name, value in (("scan_id", scan), ("severity", severity), ("vuln_class", vuln_class)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings


def owned(rows: DataFrame, user: str | None, owner: str = "user_id") -> DataFrame:
    """Rows of the caller; rows without an owner are nobody's."""
    return rows.where(F.col(owner) == F.lit(user))


def owned_findings(findings: DataFrame, scans: DataFrame, user: str | None) -> DataFrame:
    """Findings of the caller's scans."""
    return findings.join(owned(scans, user).select("scan_id"), "scan_id", "left_semi")


def scan_page(scans: DataFrame, user: str, number: int, size: int, status: str | None = None, min_severity: str | None = None, order: list[Column] | None = None, filter_first: bool = False) -> DataFrame:
    """A page of the caller's scans, latest first, optionally of one status.

    ``min_severity`` drops scans from the finished page (a page may have fewer
    rows), or before paging with ``filter_first``.
    """
    rows = owned(scans, user)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    grave = F.lit(True) if min_severity not in scoring.SEVERITIES else scoring.rank(F.coalesce("max_severity", F.lit("info"))) >= scoring.SEVERITIES.index(min_severity)
    if filter_first:
        rows = rows.where(grave)
    out = page(rows, order or [F.desc("created_at"), F.col("scan_id")], number, size)
    return out if filter_first else out.where(grave)


def exploit_targets(findings: DataFrame) -> DataFrame:
    """Findings that still lack a script: no chains, no false positives."""
    return findings.where((F.col("vuln_class") != "chain") & ~F.coalesce("is_false_positive", F.lit(False)) & F.col("script").isNull())


def pick(rows: DataFrame, name: str, part: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows, by name, whose name holds the part, whatever its case."""
    return rows.where(F.contains(F.lower(name), F.lit(part.lower()))).orderBy(name).limit(n)


def by_severity(findings: DataFrame, *tie: str) -> DataFrame:
    """Gravest first, unknown severities last."""
    return findings.orderBy(scoring.display_order(F.col("severity")), *tie)


def exploit_steps(paths: DataFrame) -> DataFrame:
    """How an attack goes, one row a step: order, action, target.

    paths: key, nodes array<struct<file, line>>, from source to sink.
    """
    place = lambda n: F.concat_ws(":", n["file"], n["line"].cast("string"))
    step = lambda action, n: F.struct(F.lit(action).alias("action"), place(n).alias("target"))
    nodes = F.col("nodes")
    steps = F.concat(F.array(step("Identify input vector", F.get(nodes, F.lit(0)))), F.transform(F.slice(nodes, 2, F.size(nodes)), lambda n: step("Data flows through", n)), F.array(step("Payload reaches dangerous sink", F.element_at(nodes, -1))))
    return paths.select("key", F.posexplode(steps).alias("_i", "_s")).select("key", (F.col("_i") + 1).alias("step"), "_s.action", "_s.target")


def with_defaults(answers: DataFrame, required: dict[str, str], column: str = "answer") -> DataFrame:
    """Answers (map<string,string>) with the required fields that are ``missing``, and ``filled`` with defaults of their types."""
    usual = {"boolean": "false", "number": "0.5", "string": "", "array": "[]"}
    names = F.array(*[F.lit(n) for n in required])
    defaults = F.create_map(*[F.lit(x) for n, kind in required.items() for x in (n, usual.get(kind, ""))])
    have = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    missing = F.filter(names, lambda n: ~F.map_contains_key(have, n))
    rest = F.map_filter(defaults, lambda k, _: F.array_contains(F.col("missing"), k))
    return answers.withColumn("missing", missing).withColumn("filled", F.map_concat(have, rest))


def merged_stats(old: Column, new: Column) -> Column:
    """Two JSON objects as one; the new one's fields win."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = read(old), read(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def compare_tools(samples: DataFrame) -> DataFrame:
    """Samples (name, vulnerable, ours, theirs: findings of each tool) with the winner."""
    return samples.withColumn("winner", scoring.winner(F.col("vulnerable"), F.col("ours") > 0, F.col("theirs") > 0))


def tool_counts(compared: DataFrame) -> DataFrame:
    """Detections, false alarms and lone detections of both tools, in one row."""
    v, a, b, w = F.col("vulnerable"), F.col("ours") > 0, F.col("theirs") > 0, F.col("winner")
    return compared.agg(F.count_if(v).alias("vulnerable"), F.count_if(~v).alias("safe"), F.count_if(v & a).alias("ours_found"), F.count_if(v & b).alias("theirs_found"), F.count_if(v & (w == "ours")).alias("ours_only"), F.count_if(v & (w == "theirs")).alias("theirs_only"), F.count_if(~v & a).alias("ours_false"), F.count_if(~v & b).alias("theirs_false"))


def severity_counts(df: DataFrame, severity: str = "severity", by: list[str] | None = None) -> DataFrame:
    s = F.col(severity)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")])


def max_severity(df: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """The gravest severity, null if nothing is above info."""
    top = F.max(scoring.rank(F.col(severity)))
    return df.groupBy(*by).agg(F.when(top > 0, scoring.severity_of(top)).alias("max_severity"))


def risk_score(df: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    total = F.least(F.lit(100), F.sum(scoring.risk_weight(F.col(severity)))).cast("int")
    out = df.groupBy(*by).agg(total.alias("risk_score"))
    return out.withColumns({"risk_label": scoring.risk_label(F.col("risk_score")), "risk_color": scoring.risk_color(F.col("risk_score"))})


def top_classes(df: DataFrame, key: str, title: str, order: str, n: int = 20) -> DataFrame:
    """Most frequent keys; ties by first seen, the title last seen."""
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"), F.max_by(title, order).alias("title"))
    return agg.orderBy(F.desc("n"), "first_seen").limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of 1..100 rows in a definite order."""
    size = min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("int")


def running_prefix(df: DataFrame, keys: list[str], order: list[str], weight: str, budget: int, tail: int | None = None) -> DataFrame:
    """Rows whose running total stays in the budget; with ``tail`` the first row
    beyond is cut if more than that many units are left.  ``taken`` units count."""
    out = ranked(df, keys, order, weight).withColumn("_left", F.lit(budget) - (F.col("_sum") - F.col(weight)))
    fits = F.col("_sum") <= budget
    cut = F.lit(False) if tail is None else (~fits & (F.col("_left") > tail))
    return out.where(fits | cut).withColumn("taken", F.least(F.col(weight), F.col("_left"))).drop("_sum", "_left", "_rank")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int = 6) -> DataFrame:
    return ranked(df, keys, order).withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def budget_gate(df: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    return ranked(df, keys, order).withColumnRenamed("_rank", "position").withColumn("passed", F.col("position") <= budget)


def latest(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def attack_flow(paths: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Path rows with node_type by place and the node before."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(position)) - 1
    out = paths.withColumns({"_i": at, "_n": n})
    kind = F.when(F.col("_i") == 0, "source").when(F.col("_i") == F.col("_n") - 1, "sink").otherwise("transform")
    return out.withColumns({"node": F.concat(F.lit("node_"), F.col("_i")), "node_type": kind, "previous": F.when(F.col("_i") > 0, F.concat(F.lit("node_"), F.col("_i") - 1))}).drop("_i", "_n")


def chain_edges(components: DataFrame, keys: list[str], order: list[str], source: str, sink: str) -> DataFrame:
    """From each component's sink to the next component's source."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return components.withColumn("from_sink", F.lag(sink).over(w)).where("from_sink IS NOT NULL").select(*keys, "from_sink", F.col(source).alias("to_source"))


def valid_chains(df: DataFrame, indices: str, size: str, confidence: str) -> DataFrame:
    """Chains of confidence 0.5 or more with two indices in range at least."""
    return df.withColumn(indices, F.filter(F.col(indices), lambda i: (i >= 0) & (i < F.col(size)))).where((F.col(confidence) >= 0.5) & (F.size(indices) >= 2))


def valid_discoveries(df: DataFrame, bounds: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Confidence 0.6 or more, a line inside its file, the best ``n`` of each key.

    bounds: file, n_lines.  A file is looked up by its full name, then by the
    part behind the last slash; lines of a file that is unknown, or has no
    line, pass.
    """
    known = bounds.select(F.col("file").cast("string").alias("file"), "n_lines").groupBy("file").agg(F.max("n_lines").alias("n_lines"))
    file = F.col("file").cast("string")
    out = df.where((F.col("confidence") >= 0.6) & (F.col("line") > 0)).withColumns({"_full": file, "_short": text.basename(file)})
    out = out.join(known.select(F.col("file").alias("_full"), F.col("n_lines").alias("_a")), "_full", "left").join(known.select(F.col("file").alias("_short"), F.col("n_lines").alias("_b")), "_short", "left")
    most = F.coalesce(F.nullif("_a", F.lit(0)), F.nullif("_b", F.lit(0)))
    out = out.where(most.isNull() | (F.col("line") <= most)).drop("_full", "_short", "_a", "_b")
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "ord"))).where(F.col("_r") <= n).drop("_r")


def chain_candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mild findings that aren't false positives, of keys that have two or more."""
    mild = df.where(F.col("severity").isin("info", "low", "medium") & ~F.col("is_false_positive"))
    return mild.join(mild.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*keys), keys, "left_semi")
