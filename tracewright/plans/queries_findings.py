"""Queries of scoring, findings, statistics, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators import findings as fd
from tracewright.operators import taint
from tracewright.plans.registry import query
from tracewright.plans.report import context, markdown_table
from tracewright.session import fresh_path
from tracewright.sources import files as sources
from tracewright.streaming import limits

SEV_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END"
CLASS_SQL = "(['sqli','cmdi','xss','ssrf','race_condition','buffer_overflow'])[(o_custkey % 6 + 1)::INT]"


def orders(t):
    """Orders as findings: priority is severity, customer the scan, status the state."""
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").when(p == "4-NOT SPECIFIED", "low").otherwise("info")
    vuln = F.get(F.array(*[F.lit(c) for c in ("sqli", "cmdi", "xss", "ssrf", "race_condition", "buffer_overflow")]), (F.col("o_custkey") % 6).cast("int"))
    return t.orders.withColumns({"severity": severity, "vuln_class": vuln})


TAX_SQL = "tax(v, cwe, owasp, mitre, title) AS (VALUES " + ", ".join("('" + "', '".join(x or "" for x in r) + "')" for r in scoring.TAXONOMY) + ")"

KEYED_SQL = "SELECT *, l_suppkey AS sink, l_partkey % 50 AS src, round(l_discount * 10) AS score FROM lineitem"


def scored(t):
    """Line items as paths: part is the source, supplier the sink, discount the confidence."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("sink"), (F.col("l_partkey") % 50).alias("src"), F.round(F.col("l_discount") * 10).alias("score"), "l_quantity")


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY src, sink ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM ({KEYED_SQL})) WHERE r = 1""")
def path_dedup(t):
    return taint.best_per_key(scored(t), ["src", "sink"], "score", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber")


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM ({KEYED_SQL})) WHERE r = 1""")
def path_prededup(t):
    return taint.best_per_key(scored(t), ["sink"], "score", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN n < 3 THEN 1 ELSE n END AS dedup_count FROM (SELECT *, count(*) OVER (PARTITION BY src, sink) AS n, row_number() OVER (PARTITION BY src, sink ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM ({KEYED_SQL})) WHERE n < 3 OR r = 1""")
def sink_collapse(t):
    return fd.collapse_groups(scored(t), ["src", "sink"], "score", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "dedup_count")


@query(f"""SELECT o_orderkey, round(((o_custkey % 101) / 100.0::DOUBLE) * CASE {SEV_SQL} WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END, 6) AS rank_score FROM orders""")
def rank_paths(t):
    return taint.rank_paths(orders(t).withColumn("confidence", (F.col("o_custkey") % 101) / F.lit(100.0))).select("o_orderkey", F.round("rank_score", 6).alias("rank_score"))


SCORES_SQL = "SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS t, (doc_id % 97) / 96.0::DOUBLE AS l, quality = 1 AS e FROM labels"


def label_scores(t):
    return t.labels.select("doc_id", ((F.col("doc_id") % 101) / F.lit(100.0)).alias("t"), ((F.col("doc_id") % 97) / F.lit(96.0)).alias("l"), (F.col("quality") == 1).alias("e"))


@query(f"""SELECT doc_id, round(t * 0.4::DOUBLE + l * 0.6::DOUBLE, 6) AS combined, t >= 0.6::DOUBLE AND l >= 0.6::DOUBLE AND e AS tp, t < 0.4::DOUBLE OR (l < 0.3::DOUBLE AND NOT e) AS fp FROM ({SCORES_SQL})""")
def fuse_scores(t):
    a, b, e = F.col("t"), F.col("l"), F.col("e")
    return label_scores(t).select("doc_id", F.round(scoring.fused(a, b), 6).alias("combined"), scoring.is_true_positive(a, b, e).alias("tp"), scoring.is_false_positive(a, b, e).alias("fp"))


@query(f"""WITH s AS ({SCORES_SQL}), b AS (SELECT *, (doc_id % 5)::INT AS base, t * 0.4::DOUBLE + l * 0.6::DOUBLE AS c FROM s), d AS (SELECT *, CASE WHEN e THEN base ELSE greatest(base - 2, 0) END AS k FROM b)
SELECT doc_id, CASE WHEN c < 0.4::DOUBLE THEN 'low' WHEN c < 0.6::DOUBLE THEN (['info','low','medium','high','critical'])[greatest(k - 1, 0) + 1] ELSE (['info','low','medium','high','critical'])[k + 1] END AS severity FROM d""")
def severity_case(t):
    base = scoring.severity_of((F.col("doc_id") % 5).cast("int"))
    return label_scores(t).select("doc_id", scoring.adjusted_severity(base, scoring.fused(F.col("t"), F.col("l")), F.col("e")).alias("severity"))


@query("""WITH s AS (SELECT l_orderkey, list(l_discount * 10) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_max(p) < 0.95::DOUBLE THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END AS llm, list_max(p) < 0.95::DOUBLE AS exploitable FROM s""")
def sanitizer_verdict(t):
    v = t.lineitem.groupBy("l_orderkey").agg(scoring.sanitizer_verdict(F.collect_list(F.col("l_discount") * 10)).alias("v"))
    return v.select("l_orderkey", F.col("v.llm_confidence").alias("llm"), F.col("v.exploitable").alias("exploitable"))


@query(f"""WITH {TAX_SQL} SELECT o_orderkey, coalesce(nullif(cwe, ''), 'CWE-unknown') AS cwe_id, coalesce(nullif(owasp, ''), 'Unknown') AS owasp, coalesce(nullif(mitre, ''), 'Unknown') AS mitre, coalesce(title, upper(c)) || ' in ' || o_custkey AS title
FROM (SELECT *, {CLASS_SQL} AS c FROM orders) LEFT JOIN tax ON v = c""")
def classify(t):
    out = scoring.classify(orders(t))
    return out.select("o_orderkey", "cwe_id", F.col("owasp_category").alias("owasp"), F.col("mitre_technique").alias("mitre"), F.concat("class_title", F.lit(" in "), F.col("o_custkey").cast("string")).alias("title"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low, count(DISTINCT o_custkey) AS scans FROM (SELECT o_custkey, {SEV_SQL} AS s FROM orders)""")
def finding_stats(t):
    o = orders(t)
    return fd.severity_counts(o).crossJoin(F.broadcast(o.agg(F.count_distinct("o_custkey").alias("scans"))))  # one row each


@query(f"""SELECT o_orderstatus, {SEV_SQL} AS severity, grouping(o_orderstatus)::INT AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, severity), (severity))""")
def stats_cube(t):
    return fd.severity_cube(orders(t), "o_orderstatus").select("o_orderstatus", "severity", "g", "n")


@query(f"""WITH w AS (SELECT o_custkey, least(100, sum(CASE {SEV_SQL} WHEN 'critical' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END))::INT AS risk_score FROM orders GROUP BY 1)
SELECT *, CASE WHEN risk_score >= 70 THEN 'Critical Risk' WHEN risk_score >= 40 THEN 'High Risk' WHEN risk_score >= 20 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_label, CASE WHEN risk_score >= 70 THEN '#ff2d55' WHEN risk_score >= 40 THEN '#ff6b35' WHEN risk_score >= 20 THEN '#ffd60a' ELSE '#34c759' END AS risk_color FROM w""")
def risk_score(t):
    return fd.risk_score(orders(t), ["o_custkey"])


@query(f"""SELECT {SEV_SQL} AS severity, count(*) AS n FROM orders GROUP BY 1""")
def severity_histogram(t):
    return context(orders(t).withColumns({"cwe_id": F.lit("c"), "title": F.lit("t"), "owasp_category": F.lit("o"), "sink_file": F.lit("f"), "sink_line": F.lit(1), "id": F.col("o_orderkey")}))["severities"]


@query("""WITH c AS (SELECT 'CWE-' || o_custkey % 40 AS cwe, 'T' || o_orderkey AS title, o_orderkey FROM orders)
SELECT cwe, count(*) AS n, min(o_orderkey) AS first_seen, arg_max(title, o_orderkey) AS title FROM c GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20""")
def cwe_top20(t):
    rows = t.orders.select(F.concat(F.lit("CWE-"), F.col("o_custkey") % 40).alias("cwe"), F.concat(F.lit("T"), "o_orderkey").alias("title"), "o_orderkey")
    return fd.top_classes(rows, "cwe", "title", "o_orderkey").select("cwe", "n", "first_seen", "title")


@query(f"""WITH {TAX_SQL} SELECT owasp, count(*) AS n FROM (SELECT {CLASS_SQL} AS c FROM orders) JOIN tax ON v = c WHERE owasp <> '' GROUP BY 1""")
def owasp_counts(t):
    rows = scoring.classify(orders(t)).withColumns({"title": F.lit("t"), "sink_file": F.lit("f"), "sink_line": F.lit(1), "id": F.col("o_orderkey")})
    return context(rows)["owasp"].where("owasp_category <> 'Unknown'").select(F.col("owasp_category").alias("owasp"), "n")


@query(f"""SELECT o_orderkey FROM orders WHERE {SEV_SQL} = 'critical' ORDER BY o_orderkey LIMIT 3""")
def top_critical(t):
    rows = orders(t).withColumns({"cwe_id": F.lit("c"), "title": F.lit("t"), "owasp_category": F.lit("o"), "sink_file": F.lit("f"), "sink_line": F.col("o_orderkey"), "id": F.col("o_orderkey")})
    return context(rows)["critical"].select(F.col("sink_line").alias("o_orderkey"))


@query(f"""WITH s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER ({SEV_SQL} = 'critical') AS c, count(*) FILTER ({SEV_SQL} = 'high') AS h FROM orders GROUP BY 1)
SELECT o_custkey, n || ' finding' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ' (' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN n - c - h > 0 THEN (n - c - h) || ' medium/low' END) || ')' AS summary FROM s""")
def executive_summary(t):
    from tracewright.plans.report import summary

    return fd.severity_counts(orders(t), by=["o_custkey"]).select("o_custkey", summary(F.col("total"), F.col("critical"), F.col("high")).alias("summary"))


@query(f"""SELECT o_custkey, CASE max(r) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS max_severity FROM (SELECT o_custkey, CASE {SEV_SQL} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS r FROM orders) GROUP BY 1""")
def max_severity(t):
    return fd.max_severity(orders(t), ["o_custkey"])


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def recent_page(t):
    return fd.page(t.orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS score FROM orders ORDER BY score DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 50""")
def finding_page(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")).alias("score"))
    return fd.page(rows, [F.col("score").desc_nulls_first(), F.col("o_orderkey")], 2, 50)


@query("""SELECT o_custkey, greatest(1, ceil(count(*) / 7.0))::INT AS pages FROM orders GROUP BY 1""")
def page_counts(t):
    return t.orders.groupBy("o_custkey").agg(fd.page_count(F.count(F.lit(1)), 7).alias("pages"))


@query(f"""WITH f AS (SELECT {CLASS_SQL} AS c, o_custkey % 200 AS line, year(o_orderdate) AS y FROM orders), a AS (SELECT DISTINCT c, line FROM f WHERE y % 2 = 0), b AS (SELECT DISTINCT c, line FROM f WHERE y % 2 = 1)
SELECT coalesce(a.c, b.c) AS c, coalesce(a.line, b.line) AS line, CASE WHEN a.c IS NULL THEN 'new' WHEN b.c IS NULL THEN 'resolved' ELSE 'unchanged' END AS bucket FROM a FULL JOIN b ON a.c = b.c AND a.line = b.line""")
def compare_scans(t):
    f = orders(t).select(F.col("vuln_class").alias("c"), (F.col("o_custkey") % 200).alias("line"), F.year("o_orderdate").alias("y"))
    return fd.compare(f.where("y % 2 = 0"), f.where("y % 2 = 1"), ["c", "line"])


DIFF_SQL = """WITH a AS (SELECT event_id AS id, user_id, event_type, (epoch_us(ts) // 60000000) AS line FROM events WHERE event_id % 2 = 0),
b AS (SELECT event_id AS other_id, user_id, event_type AS other_type, (epoch_us(ts) // 60000000) + 2 AS other_line FROM events WHERE event_id % 2 = 1),
m AS (SELECT id, min(other_id) AS other_id FROM a JOIN b ON a.user_id = b.user_id AND abs(line - other_line) <= 5 AND (event_type = other_type OR other_type = 'error' OR event_type = 'view') GROUP BY id)
SELECT CASE WHEN m.id IS NULL THEN 'ours_only' ELSE 'overlap' END AS bucket, a.id, m.other_id FROM a LEFT JOIN m ON a.id = m.id
UNION ALL SELECT 'theirs_only', NULL, other_id FROM b WHERE other_id NOT IN (SELECT other_id FROM m)"""


@query(DIFF_SQL)
def differential_5(t):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    e = t.events.withColumn("m", minute)
    ours = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("m").alias("line"))
    theirs = e.where("event_id % 2 = 1").select(F.col("event_id").alias("other_id"), "user_id", F.col("event_type").alias("other_type"), (F.col("m") + 2).alias("other_line"), F.col("event_id").alias("other_ord"))
    vuln = lambda c, none: F.when(F.col(c) == none, "unknown").otherwise(F.col(c))
    return fd.differential(ours, theirs, ["user_id"], 5, scoring.compatible(vuln("other_type", "error"), vuln("event_type", "view")))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(url), '{k}') THEN '{v}'" for k, v in scoring.RULE_KEYWORDS) + " ELSE 'unknown' END AS vuln_class FROM pages")
def rule_class_case(t):
    return t.pages.select("page_id", scoring.rule_class(F.col("url")).alias("vuln_class"))


@query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30 AS passed FROM documents""")
def budget_gate(t):
    return fd.budget_gate(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 30).select("source", "doc_id", F.col("position").cast("bigint").alias("position"), "passed")


@query("""SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 6 AS batch FROM documents) GROUP BY 1, 2""")
def batch6(t):
    return fd.batches(t.documents.select("source", "doc_id"), ["source"], ["doc_id"]).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT conv_id, turn, 'node_' || i AS node, CASE WHEN i = 0 THEN 'source' WHEN i = n - 1 THEN 'sink' ELSE 'transform' END AS node_type, CASE WHEN i > 0 THEN 'node_' || (i - 1) END AS previous, left(text, 50) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def attack_flow(t):
    return fd.attack_flow(t.conversations, ["conv_id"], "turn").select("conv_id", "turn", "node", "node_type", "previous", F.left("text", F.lit(50)).alias("label"))


@query("""SELECT l_orderkey, from_sink, to_source FROM (SELECT l_orderkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS from_sink, l_partkey AS to_source FROM lineitem) WHERE from_sink IS NOT NULL""")
def chain_merge(t):
    return fd.chain_edges(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "l_suppkey")


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_linenumber - 2 >= 0 AND l_linenumber - 2 < 4) AS n, max(l_discount) * 10 AS confidence FROM lineitem GROUP BY 1)
SELECT l_orderkey, n FROM c WHERE confidence >= 0.5::DOUBLE AND n >= 2""")
def valid_chains(t):
    c = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") - 2).alias("idx"), (F.max("l_discount") * 10).alias("confidence")).withColumn("k", F.lit(4))
    return fd.valid_chains(c, "idx", "k", "confidence").select("l_orderkey", F.size("idx").cast("bigint").alias("n"))


@query("""WITH b AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE doc_id % 3 <> 0),
d AS (SELECT event_id AS ord, user_id, (event_id * 7) % (SELECT count(*) FROM documents) AS file, (event_id % 15)::INT AS line, (event_id % 11) / 10.0::DOUBLE AS confidence FROM events)
SELECT user_id, ord FROM (SELECT d.*, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, ord) AS r FROM d LEFT JOIN b USING (file) WHERE confidence >= 0.6::DOUBLE AND line > 0 AND (n_lines IS NULL OR line <= n_lines)) WHERE r <= 5""")
def valid_discoveries(t):
    # every third file is unknown; every other finding names its file with a folder, which only the short name finds
    bounds = t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    number = (F.col("event_id") * 7) % t.documents.count()
    file = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("src/deep/"), number)).otherwise(number.cast("string"))
    d = t.events.select(F.col("event_id").alias("ord"), "user_id", file.alias("file"), (F.col("event_id") % 15).cast("int").alias("line"), ((F.col("event_id") % 11) / F.lit(10.0)).alias("confidence"))
    return fd.valid_discoveries(d, bounds, ["user_id"]).select("user_id", "ord")


@query(f"""SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE {SEV_SQL} IN ('info', 'low', 'medium') AND o_orderstatus <> 'F') WHERE n >= 2""")
def chain_candidates(t):
    return fd.chain_candidates(orders(t).withColumn("is_false_positive", F.col("o_orderstatus") == "F"), ["o_custkey"]).select("o_orderkey")


@query(f"""SELECT o_orderkey, CASE WHEN s IN ('critical', 'high') THEN 'error' WHEN s = 'medium' THEN 'warning' ELSE 'notice' END AS level, c || ' (' || (o_custkey % 100) || '%)' AS message, s IN ('critical', 'high') AS blocking FROM (SELECT *, {SEV_SQL} AS s, {CLASS_SQL} AS c FROM orders)""")
def ci_gate(t):
    from tracewright.plans.scan import gate

    f = orders(t).select(F.col("o_orderkey").alias("scope"), "severity", "vuln_class", ((F.col("o_custkey") % 100 + 0.5) / 100).alias("confidence"), F.lit("f").alias("sink_file"), F.lit(1).alias("sink_line"))
    return gate(f).select(F.col("scope").alias("o_orderkey"), "level", "message", "blocking")


@query("""SELECT user_id AS identity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, greatest(0, 3 - count(*)) AS remaining, count(*) <= 3 AS allowed FROM events GROUP BY 1, 2""")
def rate_limit_daily(t):
    return limits.daily_counts(t.events.select(F.col("user_id").alias("identity"), "ts")).withColumn("day", F.col("day").cast("string"))


PHASES_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'reasoning' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"


def progress_rows(df):
    e = F.col("event_type")
    phase = F.when(e == "signup", "queued").when(e == "view", "parsing").when(e == "click", "reasoning").when(e == "purchase", "complete").otherwise("failed")
    return df.select(F.col("user_id").alias("scan_id"), "ts", phase.alias("phase"), F.col("value").alias("progress"), F.col("event_id").cast("string").alias("message"))


@query(f"""WITH p AS (SELECT user_id, ts, {PHASES_SQL} AS phase, event_id FROM events)
SELECT user_id AS scan_id, arg_max(phase, (ts, list_position(['queued','parsing','taint_analysis','reasoning','complete','failed','timeout'], phase))) AS phase, arg_max(phase, (ts, list_position(['queued','parsing','taint_analysis','reasoning','complete','failed','timeout'], phase))) IN ('complete', 'failed') AS done FROM p GROUP BY 1""")
def status_latest(t):
    return limits.latest_progress(progress_rows(t.events)).select("scan_id", "phase", "done")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def triage_latest(t):
    return fd.latest(t.events, ["user_id", "event_type"], "event_id", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""")
def stream_counts(t):
    """The same count as a Structured Streaming query over the table's folder."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    counted = stream.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return limits.run_to_table(counted, fresh_path(t.spark, "errors"), fresh_path(t.spark, "stream"), keys=["user_id"])


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2""")
def confusion(t):
    return fd.confusion(t.labels, "quality", "toxic")


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels""")
def confusion_counts(t):
    return fd.confusion_counts(t.labels, F.col("quality") == 1, F.col("toxic") == 0)


SAMPLES_SQL = """s AS (SELECT c_custkey AS name, c_acctbal > 0 AS vulnerable, count(o_orderkey) FILTER (o_orderstatus = 'F') AS ours, count(o_orderkey) FILTER (o_orderstatus = 'P') AS theirs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN (ours > 0) = (theirs > 0) THEN CASE WHEN vulnerable AND ours = 0 THEN 'neither' ELSE 'tie' END WHEN vulnerable = (ours > 0) THEN 'ours' ELSE 'theirs' END AS winner FROM s)"""


def samples(t):
    """Customers as a benchmark's samples, two states of orders as what two tools found."""
    found = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("ours"), F.count_if(F.col("o_orderstatus") == "P").alias("theirs"))
    rows = t.customer.join(found, "c_custkey", "left").select(F.col("c_custkey").alias("name"), (F.col("c_acctbal") > 0).alias("vulnerable"), F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))
    return fd.compare_tools(rows)


@query(f"""WITH {SAMPLES_SQL} SELECT name, winner FROM w""")
def tool_winner(t):
    return samples(t).select("name", "winner")


@query(f"""WITH {SAMPLES_SQL} SELECT count(*) FILTER (vulnerable) AS vulnerable, count(*) FILTER (NOT vulnerable) AS safe, count(*) FILTER (vulnerable AND ours > 0) AS ours_found, count(*) FILTER (vulnerable AND theirs > 0) AS theirs_found,
count(*) FILTER (vulnerable AND winner = 'ours') AS ours_only, count(*) FILTER (vulnerable AND winner = 'theirs') AS theirs_only, count(*) FILTER (NOT vulnerable AND ours > 0) AS ours_false, count(*) FILTER (NOT vulnerable AND theirs > 0) AS theirs_false FROM w""")
def tool_counts(t):
    return fd.tool_counts(samples(t))


@query(f"""WITH {SAMPLES_SQL} SELECT name, '| ' || name || ' | ' || CASE WHEN ours > 0 THEN ours || ' found' WHEN vulnerable THEN '0 findings' ELSE '0 (correct)' END || ' | ' || CASE WHEN theirs > 0 THEN theirs || ' found' WHEN vulnerable THEN '0 findings' ELSE '0 (correct)' END
|| ' | ' || CASE winner WHEN 'ours' THEN '**Ours**' WHEN 'theirs' THEN 'Theirs' WHEN 'tie' THEN 'Tie' ELSE 'Neither' END || ' |' AS line FROM w""")
def markdown_lines(t):
    return markdown_table(samples(t))


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(list(('CWE-' || turn % 3) || ''))), ',') AS ids FROM conversations GROUP BY 1""")
def distinct_cwes(t):
    rows = t.conversations.withColumn("said", F.concat(F.lit("see CWE-"), F.col("turn") % 3, F.lit(".")))
    return fd.weakness_ids(rows, ["conv_id"], "said").select("conv_id", F.array_join("ids", ",").alias("ids"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN contains(left(text, 300), ' ') THEN regexp_replace(left(text, 300), ' [^ ]*$', '') ELSE left(text, 300) END || '…' END AS short FROM documents""")
def truncate_text(t):
    return t.documents.select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("""SELECT doc_id, CASE WHEN n_chars < 60 THEN n_chars || 's' ELSE (n_chars // 60) || 'm ' || (n_chars % 60) || 's' END AS took, CASE WHEN n_chars < 1 THEN 'just now' WHEN n_chars < 60 THEN n_chars || 'm ago' WHEN n_chars < 1440 THEN (n_chars // 60) || 'h ago' ELSE (n_chars // 1440) || 'd ago' END AS ago FROM documents""")
def time_texts(t):
    return t.documents.select("doc_id", text.duration(F.col("n_chars")).alias("took"), text.relative_time(F.col("n_chars")).alias("ago"))


@query("""SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def fenced_answers(t):
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return t.events.select("event_id", F.get_json_object(text.fenced_json(answer), "$.k").cast("bigint").alias("k"))


@query("""SELECT event_id AS ord, 'rule-' || event_type AS rule_id, 'src/f' || user_id || '.py' AS file, user_id::INT AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, 'CWE-' || user_id % 9 AS cwe FROM events""")
def external_findings(t):
    result = F.struct(F.concat(F.lit("rule-"), "event_type").alias("check_id"), F.concat(F.lit("src/f"), "user_id", F.lit(".py")).alias("path"), F.struct(F.col("user_id").cast("int").alias("line")).alias("start"), F.struct(F.lit("m").alias("message"), F.when(F.col("event_type") == "error", "ERROR").alias("severity"), F.struct(F.array(F.concat(F.lit("CWE-"), F.col("user_id") % 9)).alias("cwe")).alias("metadata")).alias("extra"))
    docs = t.events.select("event_id", F.to_json(F.struct(F.array(result).alias("results"))).alias("json"))
    parsed = sources.external_findings(docs, keep=["event_id"])
    return parsed.select(F.col("event_id").alias("ord"), "rule_id", "file", "line", "severity", "cwe")


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0""")
def owner_scope(t):
    # a scan is a customer, its owner the market segment; scans of a negative balance have no owner
    scans = t.customer.select(F.col("c_custkey").alias("scan_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("user_id"))
    return fd.owned_findings(t.orders.withColumnRenamed("o_custkey", "scan_id"), scans, "BUILDING").select("o_orderkey")


@query("""SELECT e.event_id, CASE WHEN c.ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND THEN c.event_id END AS cached FROM events e LEFT JOIN (SELECT props, max(event_id) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY props) c ON e.props = c.props""")
def prompt_cache(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    cache = e.where("event_type = 'view'").groupBy("props").agg(F.max("event_id").alias("value"), F.max("ts").alias("stored_at")).select(F.sha2("props", 256).alias("key"), "value", "stored_at")
    now = e.agg(F.max("ts").alias("now"))
    asked = e.select("event_id", F.col("props").alias("prompt")).crossJoin(F.broadcast(now))  # one row
    fresh = limits.read_through(asked, cache.crossJoin(F.broadcast(now)), F.col("now"))
    return fresh.select("event_id", "cached")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'source_type' WHEN page_id % 3 = 0 AND NOT ((starts_with(url, 'https://github.com/') OR starts_with(url, 'https://gitlab.com/') OR starts_with(url, 'https://bitbucket.org/')) AND NOT regexp_matches(url, '[;&|`$<>]|\\.\\.')) THEN 'repository' WHEN page_id % 3 = 1 AND length(html) > 1500 THEN 'size' END AS error,
CASE WHEN page_id % 4 = 3 THEN 'status' WHEN length(html) > 2000 THEN 'notes' END AS triage FROM pages""")
def request_checks(t):
    kind = F.get(F.array(F.lit("github_url"), F.lit("raw_code"), F.lit("directory")), (F.col("page_id") % 3).cast("int"))
    status = F.get(F.array(F.lit("true_positive"), F.lit("false_positive"), F.lit("accepted_risk"), F.lit("open")), (F.col("page_id") % 4).cast("int"))
    source = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.col("html"))
    return t.pages.select("page_id", text.request_error(kind, source, limit=1500).alias("error"), text.triage_error(status, F.col("html")).alias("triage"))


@query("""SELECT count(*) FILTER (n_chars % 3 = 0) AS taint_only, count(*) AS n FROM documents""")
def taint_only_count(t):
    reasoning = F.when(F.col("n_chars") % 3 == 0, "the budget exhausted, taint alone").when(F.col("n_chars") % 3 == 1, "looked at")
    return t.documents.agg(F.count_if(scoring.taint_only(reasoning)).alias("taint_only"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS previous FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def previous_scan(t):
    return fd.latest(t.orders.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey", "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("previous"))


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def delete_cascade(t):
    rows = t.lineitem.withColumn("scope", F.col("l_suppkey"))
    return sources.delete_scopes(rows, t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("scope"))).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def owned_findings(t):
    scans = t.customer.select(F.col("c_custkey").alias("scan_id"), F.col("c_mktsegment").alias("user_id"))
    mine = fd.owned_findings(t.orders.select(F.col("o_custkey").alias("scan_id")), scans, "BUILDING")
    return mine.groupBy(F.col("scan_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey, sum(l_quantity) AS tokens, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS cache_hits FROM lineitem GROUP BY 1""")
def usage_counters(t):
    return fd.usage(t.lineitem, ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "R")


@query("""SELECT user_id, 'rate:' || user_id || ':' || strftime(max(ts), '%Y-%m-%d') AS key FROM events GROUP BY 1""")
def rate_keys(t):
    return t.events.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("d")).select("user_id", text.rate_key(F.col("user_id").cast("string"), F.col("d")).alias("key"))
