"""Queries of sources and sinks, parsing, rules, detectors and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators import detect, graph, parse, rules
from tracewright.operators import findings as fd
from tracewright.plans import scan
from tracewright.plans.registry import query
from tracewright.session import fresh_path, spread, stash
from tracewright.sources import files as sources
from tracewright.streaming import limits

# --- sources and sinks -----------------------------------------------------------------


def document_files(t):
    """Documents as the files of projects, one a source."""
    return t.documents.select(F.col("source").alias("scope"), F.concat(F.lit("src/d"), "doc_id", F.lit(".py")).alias("path"), "doc_id", F.col("text").alias("source"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.size(text.line_array(F.col("text"))).alias("n_lines"))


LINES = r"len(string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'))"


@query(f"""SELECT coalesce(CASE WHEN octet_length(encode(text)) > 6000 THEN 'oversized' WHEN {LINES} > 12 THEN 'too_many_lines' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1""")
def file_selection(t):
    judged = sources.select_files(document_files(t), max_bytes=6000, max_lines=12)
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, 'src/d' || doc_id || '.py' AS path FROM documents WHERE octet_length(encode(text)) > 9000""")
def excluded_files(t):
    judged = sources.select_files(document_files(t), max_bytes=9000, max_lines=10**9)
    return scan.excluded_names(judged).select(F.col("scope").alias("source"), "path")


@query("""SELECT page_id, regexp_matches(lower(url), '/(node_modules|vendor|vendors|static/js|static/css|assets/js|assets/css|dist|build|.venv|venv|env|__pycache__|.git|bower_components|jspm_packages)/') OR regexp_matches(lower(url), '(\\.min\\.js|\\.min\\.css|\\.bundle\\.js|\\.chunk\\.js|-min\\.js|\\.packed\\.js)$') AS third FROM
(SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '/blog/', '/vendor/') WHEN 1 THEN url || '.min.js' ELSE url END AS url FROM pages)""")
def third_party(t):
    url = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("/blog/"), F.lit("/vendor/"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(".min.js"))).otherwise(F.col("url"))
    return t.pages.select("page_id", text.is_third_party(url).alias("third"))


PATHS_SQL = """p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'dist/' ELSE 'app/' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.java' ELSE '.py' END AS path FROM part)"""


def part_paths(t):
    folder = F.when(F.col("p_size") % 5 == 0, "node_modules/").when(F.col("p_size") % 5 == 1, ".hidden/").when(F.col("p_size") % 5 == 2, "dist/").otherwise("app/")
    ending = F.get(F.array(F.lit(".py"), F.lit(".tsx"), F.lit(".java"), F.lit(".py")), (F.col("p_partkey") % 4).cast("int"))
    return t.part.select(F.lit("s").alias("scope"), "p_partkey", F.concat(folder, "p_partkey", ending).alias("path"), F.col("p_name").alias("source"))


@query(f"""WITH {PATHS_SQL} SELECT p_partkey, regexp_matches(path, '\\.(py|tsx)$') AND NOT regexp_matches(path, '^(node_modules|\\.hidden)/') AS taken FROM p""")
def bundled_paths(t):
    return part_paths(t).select("p_partkey", sources.bundled(F.col("path")).alias("taken"))


@query(f"""WITH {PATHS_SQL} SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN ends_with(path, '.py') THEN 1 ELSE 2 END, path) AS place FROM p WHERE regexp_matches(path, '\\.(py|java)$') AND NOT regexp_matches(path, '^(node_modules|dist)/')""")
def bundle_languages(t):
    return sources.bundle_languages(part_paths(t), ["python", "java"]).select("p_partkey", F.col("place").cast("bigint").alias("place"))


@query("""SELECT doc_id, sha256(left(text, 500)) AS sha, length(text) > 500 AS cut FROM documents""")
def code_snapshots(t):
    rows = t.documents.select(F.lit("s").alias("scope"), F.col("doc_id").alias("path"), F.col("text").alias("source"))
    return sources.code_snapshot(rows, 500).select(F.col("path").alias("doc_id"), F.sha2("snapshot", 256).alias("sha"), "cut")


@query("""SELECT n_nationkey AS key, n_name AS name, true AS there, false AS after FROM nation""")
def stored_objects(t):
    """Rows written as JSON objects, listed, read back and deleted."""
    path = fresh_path(t.spark, "objects")
    sources.write_artifacts(t.nation.select(F.col("n_regionkey").alias("scan_id"), "n_nationkey", "n_name"), path)
    found = {r["scan_id"] for r in sources.list_objects(t.spark, path, "*.json").select(F.regexp_extract("path", r"scan_id=(\d+)", 1).cast("int").alias("scan_id")).distinct().collect()}  # five folders
    rows = stash(t.spark.read.schema("n_nationkey long, n_name string, scan_id long").json(path), "read")
    sources.delete_prefix(t.spark, path)
    return rows.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("scan_id").isin(*found).alias("there"), F.lit(sources.object_exists(t.spark, path)).alias("after"))


@query("""SELECT doc_id, sha256(text) AS sha FROM documents WHERE source = (SELECT min(source) FROM documents)""")
def saved_manifest(t):
    path = fresh_path(t.spark, "manifest")
    files = t.documents.select(F.col("source").alias("scope"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"))
    sources.save_manifest(files.withColumn("source", F.lit("old")), path)
    sources.save_manifest(files, path)  # replaces what is there
    first = t.documents.agg(F.min("source").alias("m")).first()["m"]
    return sources.load_manifest(t.spark, path, first).select(F.col("path").cast("bigint").alias("doc_id"), F.col("sha256").alias("sha"))


@query("""SELECT source || '/' || doc_id AS file FROM documents WHERE doc_id % 13 = 0 OR doc_id % 7 = 0""")
def incremental_files(t):
    files = t.documents.select(F.col("source").alias("scope"), F.concat_ws("/", "source", "doc_id").alias("path"), "doc_id", F.col("text").alias("source"))
    old = files.where("doc_id % 13 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit("#"))).otherwise(F.col("source")))
    return scan.incremental(files, sources.manifest(old)).select(F.col("path").alias("file"))


@query("""SELECT n_nationkey AS scan_id, 'complete' AS status, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS score, n_name AS source FROM nation""")
def scan_log(t):
    """Inserts and updates as an append-only log in several files, the later ones with a column more."""
    path, n = fresh_path(t.spark, "scans"), t.nation
    sources.write_table(n.select(F.col("n_nationkey").alias("scan_id"), F.lit(1).alias("at"), F.lit("queued").alias("status"), F.col("n_name").alias("source")), path)
    sources.write_table(n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("scan_id"), F.lit(2).alias("at"), F.col("n_regionkey").alias("score")), path)
    sources.write_table(n.select(F.col("n_nationkey").alias("scan_id"), F.lit(3).alias("at"), F.lit("complete").alias("status")), path)
    return sources.current_state(sources.read_table(t.spark, path), "scan_id", "at").select("scan_id", "status", "score", "source")


@query("""SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1""")
def cached_counts(t):
    """A derived table that is made once; the second call reads it."""
    path = fresh_path(t.spark, "derived")
    make = lambda: t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    sources.cached_result(t.spark, path, make)
    return sources.cached_result(t.spark, path, lambda: make().where("false"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 OR p_size <= 25 AS to_clone FROM part""")
def clone_cache(t):
    """Every third repository was cloned; clones older than their lifetime don't count."""
    now = F.timestamp_seconds(F.lit(10_000))
    asked = t.part.select("p_partkey", F.concat(F.lit("https://github.com/o/"), "p_partkey").alias("url"))
    clones = t.part.where("p_partkey % 3 = 0").select(F.concat(F.lit("https://github.com/o/"), "p_partkey").alias("url"), F.concat(F.lit("/c/"), "p_partkey").alias("folder"), F.timestamp_seconds(F.when(F.col("p_size") > 25, 9_700).otherwise(9_000)).alias("cloned_at"))
    return limits.clone_plan(asked, clones, now).select("p_partkey", "to_clone")


PHASES = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'taint_analysis' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"


@query(f"""WITH p AS (SELECT user_id, event_id, {PHASES} AS phase, lag({PHASES}) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS b FROM events)
SELECT event_id, b IS NULL OR b = phase OR (b = 'queued' AND phase IN ('parsing', 'failed')) OR (b = 'parsing' AND phase IN ('taint_analysis', 'failed')) OR (b = 'taint_analysis' AND phase IN ('complete', 'failed')) AS valid FROM p""")
def state_transitions(t):
    e = F.col("event_type")
    phase = F.when(e == "signup", "queued").when(e == "view", "parsing").when(e == "click", "taint_analysis").when(e == "purchase", "complete").otherwise("failed")
    rows = t.events.select(F.col("user_id").alias("scan_id"), "event_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("ts"), phase.alias("phase"))
    return limits.transitions(rows).select("event_id", "valid")


# --- parsing and graphs ----------------------------------------------------------------


def supplier_files(t):
    """A project for each nation, a file for each of its suppliers; those with a negative balance hand input to a shell."""
    head = F.when(F.col("s_acctbal") < 0, F.lit("q = request.args.get('q')\n")).otherwise(F.lit("q = 'fixed'\n"))
    source = F.concat(head, F.lit("r"), "s_suppkey", F.lit(" = q\nos.system(r"), "s_suppkey", F.lit(")\n"))
    made = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("scope"), F.concat(F.lit("f"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".py")).alias("path"), source.alias("source"), F.lit("x").alias("sha256"), F.octet_length(source).cast("bigint").alias("n_bytes"))
    return sources._files(made)


@query("""WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS scope, 'f' || lpad(s_suppkey::VARCHAR, 9, '0') || '.py' AS file FROM supplier WHERE s_acctbal < 0)
SELECT scope, file, 0 AS source_line, 2 AS sink_line, 'cmdi' AS vuln_class, 'critical' AS severity, 'OS Command Injection in ' || file AS title, 'Attacker-controlled input flows to os.system(r' || k || ')' AS description FROM s""")
def analyse_projects(t):
    """Files to findings: parsing, rules, edges, folding, the search, scoring and titles."""
    found = scan.analyse(supplier_files(t), rules.default_rules(t.spark))["findings"].where("analyzer = 'taint'")
    return found.select("scope", F.col("sink_file").alias("file"), "source_line", "sink_line", "vuln_class", "severity", "title", "description")


@query("""WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS scope, 'f' || lpad(s_suppkey::VARCHAR, 9, '0') || '.py' AS file FROM supplier WHERE s_acctbal < 0)
SELECT scope, file, 0 AS pos, 'q = request.args.get(''q'')' AS label, 0 AS line, 'tainted' AS type, false AS is_folded FROM s UNION ALL SELECT scope, file, 1, '(folded) r' || k || ' = q', 1, 'tainted', true FROM s
UNION ALL SELECT scope, file, 2, 't = r' || k, 2, 'tainted', false FROM s UNION ALL SELECT scope, file, 3, 'os.system(t)', 3, 'tainted', false FROM s""")
def path_steps(t):
    """Paths as they are shown: what folding took out is back, and marked."""
    files = supplier_files(t).withColumn("source", F.regexp_replace("source", r"\nos\.system\((r\d+)\)", "\nt = $1\nos.system(t)"))
    return scan.analyse(files, rules.default_rules(t.spark))["steps"].select("scope", "file", "pos", "label", "line", "type", "is_folded")


@query("""WITH k AS (SELECT s_suppkey AS k, 'f' || lpad(s_suppkey::VARCHAR, 9, '0') || '.py' AS file, s_acctbal < 0 AS bad FROM supplier)
SELECT file, 'assignment' AS node_type, 0 AS line, CASE WHEN bad THEN 'q = request.args.get(''q'')' ELSE 'q = ''fixed''' END AS code, 'q' AS defs, CASE WHEN bad THEN 'request' ELSE '' END AS uses, CASE WHEN bad THEN 'request.args.get' ELSE '' END AS calls FROM k
UNION ALL SELECT file, 'call', 0, 'request.args.get(''q'')', '', 'request', 'request.args.get' FROM k WHERE bad
UNION ALL SELECT file, 'assignment', 1, 'r' || k || ' = q', 'r' || k, 'q', '' FROM k
UNION ALL SELECT file, 'statement', 2, 'os.system(r' || k || ')', '', 'os,r' || k, 'os.system' FROM k
UNION ALL SELECT file, 'call', 2, 'os.system(r' || k || ')', '', 'os,r' || k, 'os.system' FROM k""")
def parsed_nodes(t):
    files = supplier_files(t)
    nodes = parse.node_table(stash(parse.parse_files(spread(files, "scope", "path")), "parsed"), files)
    return nodes.select("file", "node_type", "line", "code", F.array_join("defs", ",").alias("defs"), F.array_join(F.array_sort("uses"), ",").alias("uses"), F.array_join("calls", ",").alias("calls"))


@query("""SELECT l_orderkey, l_linenumber - 1 AS src, l_linenumber AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'data_dep' ELSE 'control_dep' END AS edge_type FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber > 1""")
def control_collapse(t):
    """Every line's parent is the line before; even lines have a data edge from it as well, which wins."""
    nodes = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_id")).distinct()
    control = graph.control_edges(nodes, ["l_orderkey"]).withColumns({"edge_type": F.lit("control_dep"), "var": F.lit(None).cast("string")})
    data = control.where("dst % 2 = 0").withColumns({"edge_type": F.lit("data_dep"), "var": F.lit("v")})
    return graph.collapse_edges(control.unionByName(data), ["l_orderkey"]).select("l_orderkey", "src", "dst", "edge_type")


@query("""SELECT p_partkey, 0 AS call_no, 'f' || p_size AS func, 'a' || p_partkey || ',' || 'b' AS args FROM part UNION ALL SELECT p_partkey, 1, 'g', '' FROM part WHERE p_size % 2 = 0""")
def parsed_calls(t):
    code = F.concat(F.lit("x = f"), "p_size", F.lit("(not a"), "p_partkey", F.lit(", len.b)"), F.when(F.col("p_size") % 2 == 0, " + g()").otherwise(" if y else print(z)"))
    nodes = t.part.select(F.lit("s").alias("scope"), F.col("p_partkey").alias("node_id"), F.lit("f").alias("file"), F.lit("assignment").alias("node_type"), F.col("p_partkey").alias("ord"), code.alias("code"))
    return graph.parsed_calls(nodes).select(F.col("node_id").alias("p_partkey"), "call_no", "func", F.array_join("args", ",").alias("args"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'lib' || c_nationkey || '.py' ELSE 'first' || c_nationkey % 5 || '.py' END AS callee_file FROM customer""")
def resolved_callees(t):
    """Customers call their nation's function: even ones import it, for odd ones the first file that defines it counts."""
    n = t.nation.select(F.col("n_nationkey").alias("k"))
    calls = t.customer.select(F.lit("s").alias("scope"), "c_custkey", F.concat(F.lit("c"), F.col("c_nationkey"), F.lit(".py")).alias("file"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("f"), "c_nationkey")).otherwise(F.concat(F.lit("g"), F.col("c_nationkey") % 5)).alias("func"))
    imports = n.where("k % 2 = 0").select(F.lit("s").alias("scope"), F.concat(F.lit("c"), "k", F.lit(".py")).alias("file"), F.concat(F.lit("f"), "k").alias("local_name"), F.concat(F.lit("lib"), "k").alias("module_stem"), F.col("k").alias("ord"))
    modules = n.select(F.lit("s").alias("scope"), F.concat(F.lit("lib"), "k").alias("stem"), F.concat(F.lit("lib"), "k", F.lit(".py")).alias("path"), F.col("k").alias("ord"))
    first = t.region.select(F.lit("s").alias("scope"), F.concat(F.lit("g"), "r_regionkey").alias("name"), F.concat(F.lit("first"), "r_regionkey", F.lit(".py")).alias("file"), F.col("r_regionkey").alias("ord"))
    defs = first.unionByName(first.withColumns({"file": F.lit("later.py"), "ord": F.col("ord") + 100}))
    return graph.resolve_callees(calls, defs, imports, modules).select("c_custkey", "callee_file")


@query("""SELECT c_custkey AS src, s_suppkey + 1000000 AS dst, '<arg:f' || c_nationkey || ':p>' AS var FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 3 > 0""")
def argument_edges(t):
    """Customers call their nation's function with a variable; suppliers use its parameter, some above its first line."""
    file = lambda c: F.concat(F.lit("n"), F.col(c), F.lit(".py"))
    none = F.array().cast("array<string>")
    var = F.concat(F.lit("v"), "c_custkey")
    calls = t.customer.select(F.lit("s").alias("scope"), F.lit("main.py").alias("file"), F.col("c_custkey").alias("node_id"), F.lit("call").alias("node_type"), file("c_nationkey").alias("callee_file"), F.concat(F.lit("f"), "c_nationkey").alias("func"), F.array(var).alias("args"))
    nodes = t.customer.select(F.lit("s").alias("scope"), F.lit("main.py").alias("file"), F.col("c_custkey").alias("node_id"), F.lit(1).alias("line"), F.array(var).alias("defs"), none.alias("uses"))
    nodes = nodes.unionByName(t.supplier.select(F.lit("s").alias("scope"), file("s_nationkey").alias("file"), (F.col("s_suppkey") + 1_000_000).alias("node_id"), (F.col("s_suppkey") % 3).cast("int").alias("line"), none.alias("defs"), F.array(F.lit("p")).alias("uses")))
    defs = t.nation.select(F.lit("s").alias("scope"), file("n_nationkey").alias("file"), F.concat(F.lit("f"), "n_nationkey").alias("name"), F.array(F.lit("p")).alias("params"), F.lit(0).alias("start_line"), F.col("n_nationkey").alias("ord"))
    return graph.argument_edges(nodes, calls, defs).select("src", "dst", "var")


# --- rules -----------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN contains(text, 'nse') THEN 'nse' WHEN contains(text, 'icen') THEN 'icen' WHEN contains(text, 'the') THEN 'the' END AS pattern FROM documents WHERE contains(text, 'nse') OR contains(text, 'icen') OR contains(text, 'the')""")
def rule_substring(t):
    """Sanitizers match inside of words as well."""
    table = t.spark.createDataFrame([("sanitizer", "*", None, i, p, p, None, None, None) for i, p in enumerate(["nse", "icen", "the"])], rules.RULE_SCHEMA)
    out = rules.first_match(t.documents.select("doc_id", "text"), table, "text", None, "sanitizer", boundary=False)
    return out.where("rule IS NOT NULL").select("doc_id", F.col("rule.pattern").alias("pattern"))


RULE_ROWS = [
    ("source", "python", None, 0, "STANDARD", "py_standard", None, None, None), ("source", "javascript", None, 1, "STANDARD", "js_standard", None, None, None), ("source", "c", None, 2, "ECONOMY", "c_economy", None, None, None),
    ("sink", "python", None, 3, "BRASS", "py_brass", "high", None, None), ("sink", "javascript", None, 4, "TIN", "js_tin", "low", None, None), ("sanitizer", "python", None, 5, "PLATED", None, None, 0.9, ["sqli"]),
    ("source", "python", "flask", 6, "PROMO", "flask_promo", None, None, None), ("source", "python", "django", 7, "PROMO", "django_promo", None, None, None), ("sink", "python", "flask", 8, "COPPER", "flask_copper", "critical", None, None),
]


def annotated_parts(t):
    """Part types as code in several languages; every third project has the profile of a framework."""
    language = F.get(F.array(*[F.lit(x) for x in ("python", "typescript", "cpp", "cobol")]), (F.col("p_partkey") % 4).cast("int"))
    framework = F.get(F.array(F.lit("flask"), F.lit("django"), F.lit(None).cast("string"), F.lit("unheard")), (F.col("p_size") % 4).cast("int"))
    kind = F.when(F.col("p_size") % 7 == 0, "condition").otherwise("call")
    nodes = t.part.select("p_partkey", F.col("p_type").alias("code"), language.alias("language"), framework.alias("framework"), kind.alias("node_type"))
    return rules.annotate(nodes, t.spark.createDataFrame(RULE_ROWS, rules.RULE_SCHEMA))


@query("""WITH p AS (SELECT p_partkey, p_type AS c, p_size % 7 <> 0 AS m, CASE p_partkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'c' ELSE 'all' END AS l, CASE p_size % 4 WHEN 0 THEN 'flask' WHEN 1 THEN 'django' ELSE '' END AS fw FROM part)
SELECT p_partkey,
CASE WHEN m THEN CASE WHEN l IN ('py', 'all') AND contains(c, 'STANDARD') THEN 'py_standard' WHEN l = 'js' AND contains(c, 'STANDARD') THEN 'js_standard' WHEN l IN ('c', 'all') AND contains(c, 'ECONOMY') THEN 'c_economy' WHEN fw = 'flask' AND contains(c, 'PROMO') THEN 'flask_promo' WHEN fw = 'django' AND contains(c, 'PROMO') THEN 'django_promo' END END AS source_type,
CASE WHEN m THEN CASE WHEN l IN ('py', 'all') AND contains(c, 'BRASS') THEN 'py_brass' WHEN l IN ('js', 'all') AND regexp_matches(c, '\\bTIN') THEN 'js_tin' WHEN fw = 'flask' AND contains(c, 'COPPER') THEN 'flask_copper' END END AS sink_class,
CASE WHEN l IN ('py', 'all') AND contains(c, 'PLATED') THEN 0.9::DOUBLE END AS san_power FROM p""")
def annotated_nodes(t):
    return annotated_parts(t).select("p_partkey", "source_type", "sink_class", "san_power")


# --- detectors -------------------------------------------------------------------------

CODE = {
    "view": "row = cur.fetchone()", "click": "if request.headers.get('X-Role') == 'admin':", "signup": "cur.execute('INSERT INTO users VALUES (?)', (request.form.get('n'),))",
    "purchase": "cur.execute(f\"SELECT {row}\")", "error": "if token == given:",
}
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '" + v.replace("'", "''") + "'" for k, v in CODE.items()) + " ELSE 'pass' END"


def event_lines(t):
    """Events as the lines of one file a user; two files a project."""
    from tracewright.plans.queries_files import user_lines

    code = F.lit("pass")
    for kind, line in CODE.items():
        code = F.when(F.col("event_type") == kind, line).otherwise(code)
    return user_lines(t).select((F.col("user_id") % 40).cast("string").alias("scope"), F.col("user_id").cast("string").alias("file"), F.col("user_id").alias("file_ord"), F.col("n").alias("line_no"), code.alias("text"))


EVENT_LINES = f"WITH e AS (SELECT user_id, user_id % 40 AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, {CODE_SQL} AS code FROM events)"


@query(EVENT_LINES + """, w AS (SELECT scope, min((user_id, n)) AS w FROM e WHERE event_type = 'signup' GROUP BY 1)
SELECT a.user_id, a.n AS read_line, b.n AS sink_line, w.w[1] AS write_user, w.w[2] AS write_line FROM e a JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n + 1 AND a.n + 20 JOIN w ON w.scope = a.scope WHERE a.event_type = 'view' AND b.event_type = 'purchase'""".replace("w.w[1]", "struct_extract(w.w, 1)").replace("w.w[2]", "struct_extract(w.w, 2)"))
def second_order_lines(t):
    """Values read from a database and used within 20 lines, in projects that write input to it."""
    out = detect.second_order_findings(event_lines(t))
    return out.select(F.col("file").cast("bigint").alias("user_id"), "read_line", "sink_line", F.col("write_file").cast("bigint").alias("write_user"), "write_line")


@query(EVENT_LINES + """, s AS (SELECT user_id, bool_or(event_type = 'signup') AS safe FROM e GROUP BY 1)
SELECT e.user_id, n AS line_no, CASE event_type WHEN 'error' THEN 'timing_attack' ELSE 'client_controlled_role' END AS vuln_type FROM e JOIN s USING (user_id) WHERE event_type = 'click' OR (event_type = 'error' AND NOT safe)""")
def auth_lines(t):
    """Unsafe comparisons, but for files that compare safely somewhere, and roles that the client names."""
    lines = event_lines(t)
    facts = t.events.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max(F.col("event_type") == "signup").alias("safe"))
    files = facts.select((F.col("path").cast("bigint") % 40).cast("string").alias("scope"), "path", F.when(F.col("safe"), "hmac.compare_digest(a, b)").otherwise("pass").alias("source"))
    out = detect.auth_findings(lines, files)
    return out.select(F.col("file").cast("bigint").alias("user_id"), "line_no", "vuln_type")


@query("""SELECT p_partkey, p_size % 4 IN (0, 1) AS guarded, p_size % 5 IN (0, 1, 2) AS auth FROM part""")
def guard_checks(t):
    """Guards of whole files, and lines that ask who is there."""
    file = F.get(F.array(F.lit("app = FastAPI(dependencies=[Depends(verify_token)])"), F.lit("@app.before_request\ndef f():\n    abort(401)"), F.lit("app = FastAPI()"), F.lit("@app.before_request\ndef f(): pass")), (F.col("p_size") % 4).cast("int"))
    line = F.get(F.array(F.lit("@Login_Required"), F.lit("u = Depends(get_principal)"), F.lit("if session['x']:"), F.lit("x = Depends(get_db)"), F.lit("return 1")), (F.col("p_size") % 5).cast("int"))
    return t.part.select("p_partkey", detect.file_guarded(file).alias("guarded"), detect.has_auth(line).alias("auth"))


@query("""SELECT 'f' || p_partkey AS file, CASE WHEN p_size % 2 = 0 THEN 'race' ELSE 'auth' END AS analyzer, CASE WHEN p_size % 2 = 0 THEN 'race_condition' ELSE 'auth_bypass' END AS vuln_class, CASE WHEN p_size % 2 = 0 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN p_size % 2 = 0 THEN 0.7::DOUBLE ELSE 0.65::DOUBLE END AS confidence, 1::BIGINT AS source_line, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS sink_line FROM part""")
def detector_findings(t):
    source = F.when(F.col("p_size") % 2 == 0, "if os.path.exists(p):\n    x = 1\n    os.remove(p)\n").otherwise("@app.get('/u')\ndef u():\n    db.execute(x)\n")
    files = t.part.select((F.col("p_partkey") % 9).cast("string").alias("scope"), F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_partkey").alias("ord"), source.alias("source"))
    out = scan.detector_findings(files)
    return out.select(F.col("sink_file").alias("file"), "analyzer", "vuln_class", "severity", "confidence", F.col("source_line").cast("bigint").alias("source_line"), F.col("sink_line").cast("bigint").alias("sink_line"))


# --- findings and texts ----------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey = 8""")
def finding_filter(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("scan_id"), F.col("o_orderstatus").alias("severity"), F.lit("x").alias("vuln_class"))
    return fd.find(rows, "7", "F").unionByName(fd.find(rows, "8", vuln_class="x")).select("o_orderkey")


def customer_scans(t):
    grave = F.get(F.array(F.lit("critical"), F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None).cast("string")), (F.col("c_custkey") % 5).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("scan_id"), F.col("c_mktsegment").alias("user_id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("complete").alias("status"), F.col("c_acctbal").alias("created_at"), grave.alias("max_severity"))


@query("""SELECT scan_id FROM (SELECT c_custkey AS scan_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10) WHERE scan_id % 5 IN (0, 1)""")
def scan_pages(t):
    """The second page of an owner's finished scans, of which the grave ones are shown."""
    return fd.scan_page(customer_scans(t), "BUILDING", 2, 10, "complete", "high").select("scan_id")


@query("""SELECT c_custkey AS scan_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_custkey % 5 IN (0, 1) ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10""")
def grave_scan_pages(t):
    return fd.scan_page(customer_scans(t), "BUILDING", 2, 10, "complete", "high", filter_first=True).select("scan_id")


@query("""SELECT c_custkey AS scan_id, count(o_orderkey) AS total, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS critical, CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' END AS max_severity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def scan_responses(t):
    from tracewright.plans.queries_findings import orders

    scans = t.customer.select(F.col("c_custkey").alias("scan_id"))
    return fd.scan_responses(scans, orders(t).withColumnRenamed("o_custkey", "scan_id")).select("scan_id", "total", "critical", "max_severity")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 <> 0 AND o_custkey % 3 <> 0""")
def exploit_targets(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "chain").otherwise("sqli").alias("vuln_class"), (F.col("o_custkey") % 4 == 0).alias("is_false_positive"), F.when(F.col("o_custkey") % 3 == 0, "print(1)").alias("script"))
    return fd.exploit_targets(rows).select("o_orderkey")


@query("""SELECT p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_name LIMIT 100""")
def repo_picker(t):
    return fd.pick(t.part.select("p_name"), "p_name", "AN")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 99 END, o_orderkey) AS place FROM orders""")
def severity_order(t):
    from tracewright.operators.order import ranked
    from tracewright.plans.queries_findings import orders

    rows = orders(t).withColumn("severity", F.when(F.col("severity") == "info", "odd").otherwise(F.col("severity")))
    shown = fd.by_severity(rows, "o_orderkey").select("o_orderkey", F.lit("s").alias("scope"), scoring.display_order(F.col("severity")).alias("nth"))
    return ranked(shown, ["scope"], ["nth", "o_orderkey"]).select("o_orderkey", F.col("_rank").cast("bigint").alias("place"))


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS llm FROM orders""")
def budget_verdicts(t):
    gated = fd.budget_gate(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)
    return gated.select("o_orderkey", scoring.budget_verdict(F.col("position"), 4, F.lit(0.25), F.lit(0.5)).alias("llm"))


@query("""SELECT o_orderkey, 'Attacker-controlled input flows to ' || o_clerk || CASE WHEN o_custkey % 4 > 1 THEN ' (' || (o_custkey % 4 - 1) || ' similar finding' || CASE WHEN o_custkey % 4 > 2 THEN 's' ELSE '' END || ' at same sink deduplicated)' ELSE '' END AS description FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS o_clerk FROM orders)""")
def finding_descriptions(t):
    return t.orders.select("o_orderkey", scoring.description(F.col("o_orderpriority"), F.col("o_custkey") % 4).alias("description"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS shown FROM events""")
def scan_dates(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", text.scan_date(F.when(F.col("event_id") % 2 == 0, ts), ts).alias("shown"))


@query("""SELECT page_id, regexp_extract(url, '(?i)(/[a-z/_\\-{}]+)', 1) AS endpoint, 'k' || page_id AS a, CASE WHEN page_id % 2 = 0 THEN 'id' ELSE 'input' END AS b FROM pages""")
def endpoint_parameters(t):
    code = F.concat(F.lit("x = request.args.get('k"), "page_id", F.lit("')"))
    kind = F.when(F.col("page_id") % 2 == 0, "sqli").otherwise("other")
    return t.pages.select("page_id", text.endpoint(F.col("url"), F.lit("a/b_c.py")).alias("endpoint"), text.parameter(code, kind).alias("a"), text.parameter(F.lit("run()"), kind).alias("b"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'o' || p_size END AS owner, CASE WHEN p_size % 2 = 0 THEN 'r' || p_partkey END AS name FROM part""")
def repository_names(t):
    url = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://github.com/o"), "p_size", F.lit("/r"), "p_partkey", F.lit(".git"))).otherwise(F.lit("https://github.com/"))
    return t.part.select("p_partkey", text.owner_and_name(url).alias("u")).select("p_partkey", "u.owner", "u.name")


@query("""SELECT p_partkey, '--- a/f' || chr(10) || '+++ b/f' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-' || p_name || chr(10) || '+' || p_type || chr(10) || ' end' || chr(10) AS diff FROM part""")
def unified_diffs(t):
    a, b = F.concat("p_name", F.lit("\nend\n")), F.concat("p_type", F.lit("\nend\n"))
    return t.part.select("p_partkey", text.unified_diff(a, b, F.lit("f")).alias("diff"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'title' END AS missing, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS title, '0.5' AS confidence FROM part""")
def answer_defaults(t):
    answer = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("title"), F.col("p_name"), F.lit("confidence"), F.lit("0.5"))).otherwise(F.create_map(F.lit("confidence"), F.lit("0.5")))
    out = fd.with_defaults(t.part.select("p_partkey", answer.alias("answer")), {"title": "string", "confidence": "number"})
    return out.select("p_partkey", F.array_join("missing", ",").alias("missing"), F.col("filled")["title"].alias("title"), F.col("filled")["confidence"].alias("confidence"))


@query("""SELECT p_partkey, 'new' AS a, p_size::VARCHAR AS b, p_brand AS c FROM part""")
def merged_stats(t):
    old = F.to_json(F.struct(F.lit("old").alias("a"), F.col("p_size").cast("string").alias("b")))
    new = F.to_json(F.struct(F.lit("new").alias("a"), F.col("p_brand").alias("c")))
    out = t.part.select("p_partkey", fd.merged_stats(old, new).alias("j"))
    return out.select("p_partkey", *[F.get_json_object("j", f"$.{k}").alias(k) for k in "abc"])


@query("""WITH n AS (SELECT conv_id AS key, turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT key, i::INT AS step, CASE WHEN i = 1 THEN 'Identify input vector' ELSE 'Data flows through' END AS action, 'f:' || turn AS target FROM n UNION ALL SELECT key, (i + 1)::INT, 'Payload reaches dangerous sink', 'f:' || turn FROM n WHERE i = n""")
def exploit_steps(t):
    nodes = t.conversations.groupBy(F.col("conv_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("line"), F.lit("f").alias("file")))).alias("nodes"))
    return fd.exploit_steps(nodes).select("key", "step", "action", "target")
