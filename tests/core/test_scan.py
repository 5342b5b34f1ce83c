"""The analysis end to end on small projects."""

import pytest

from tracewright.operators import detect, rules
from tracewright.plans import scan
from tracewright.sources.files import inline_file, split_payload

PROJECT = """# === FILE: limits.py ===
from flask import request
who = request.headers.get("X-Client")
state.client = who
# === FILE: find.py ===
from logger import record
term = request.args.get("q")
clean = term.replace("'", "")
peer = state.client
record(peer)
# === FILE: logger.py ===
import sqlite3
def record(entry):
    stmt = "INSERT INTO log VALUES ('" + entry + "')"
    cursor.execute(stmt)
"""


def findings(spark, code, **kw):
    files = split_payload(spark.createDataFrame([("s", code)], "scope string, payload string"))
    out = scan.analyse(files, rules.default_rules(spark), **kw)
    return out, [r.asDict() for r in out["findings"].collect()]


def test_taint_crosses_three_files(spark):
    out, rows = findings(spark, PROJECT)
    hit = [r for r in rows if r["vuln_class"] == "sqli"]
    assert len(hit) == 1
    assert (hit[0]["source_file"], hit[0]["sink_file"], hit[0]["cwe_id"]) == ("limits.py", "logger.py", "CWE-89")
    assert hit[0]["taint_confidence"] == 1.0 and hit[0]["confidence"] == 0.97 and hit[0]["severity"] == "critical"
    assert out["errors"].count() == 0


@pytest.mark.parametrize(
    ("code", "classes"),
    [
        ("q = request.args.get('q')\nos.system(q)\n", {"cmdi"}),
        ("q = request.args.get('q')\nn = shlex.quote(q)\nos.system(n)\n", set()),
        ("q = 'fixed'\nos.system(q)\n", set()),
        ("q = request.args.get('q')\nh = html.escape(q)\ncursor.execute(h)\n", set()),
    ],
)
def test_single_file(spark, code, classes):
    _, rows = findings(spark, code)
    assert {r["vuln_class"] for r in rows} == classes


def test_class_aware_pruning_reports_escape_before_sql(spark):
    code = "q = request.args.get('q')\nh = html.escape(q)\ncursor.execute(h)\n"
    _, rows = findings(spark, code, prune="class_aware")
    assert {r["vuln_class"] for r in rows} == {"sqli"}


def test_return_value_edge(spark):
    code = "# === FILE: utils.py ===\ndef read():\n    v = request.args.get('c')\n    return v\n# === FILE: handler.py ===\nfrom utils import read\nc = read()\nos.system(c)\n"
    _, rows = findings(spark, code)
    assert [(r["source_file"], r["sink_file"], r["vuln_class"]) for r in rows] == [("utils.py", "handler.py", "cmdi")]


def test_broken_file_is_isolated(spark):
    out, rows = findings(spark, "# === FILE: a.py ===\ndef (\n# === FILE: b.py ===\nq = request.args.get('q')\nos.system(q)\n")
    assert [r["file"] for r in out["errors"].collect()] == ["a.py"]
    assert {r["vuln_class"] for r in rows} == {"cmdi"}


def test_other_languages(spark):
    code = "# === FILE: app.js ===\nconst id = req.query.id;\nconst sql = 'select ' + id;\ndb.query(sql);\n"
    _, rows = findings(spark, code)
    assert {r["vuln_class"] for r in rows} == {"sqli"}


def test_detectors(spark):
    code = "\n".join(["if os.path.exists(p):", "    x = 1", "    os.remove(p)", "@app.get('/u')", "def u():", "    db.execute('x')", "@app.get('/v')", "@login_required", "def v():", "    db.execute('x')", "if token == given:", "    pass"])
    files = inline_file(spark, code)
    lines = detect.file_lines(files)
    assert [(r.check_at, r.act_at) for r in detect.race_findings(lines).collect()] == [(1, 3)]
    assert {(r.vuln_type, r.line_no) for r in detect.auth_findings(lines, files).collect()} == {("missing_auth", 4), ("timing_attack", 11)}


def test_second_order(spark):
    code = "\n".join(["name = request.form.get('n')", "db.execute('INSERT INTO users VALUES (?)', (name,))", "row = db.execute('x').fetchone()", "db.execute(f\"SELECT {row}\")"])
    rows = detect.second_order_findings(detect.file_lines(inline_file(spark, code))).collect()
    assert [(r.write_line, r.read_line, r.sink_line, r.vuln_class, r.db_table) for r in rows] == [(2, 3, 4, "sqli", "users")]
    assert detect.second_order_findings(detect.file_lines(inline_file(spark, "x = db.fetchone()\n"))).count() == 0


def test_gate_and_incremental(spark):
    files = split_payload(spark.createDataFrame([("s", PROJECT)], "scope string, payload string"))
    old = files.where("path <> 'find.py'").select("scope", "path", "sha256")
    assert [r.path for r in scan.incremental(files, old).collect()] == ["find.py"]
    out, _ = findings(spark, PROJECT)
    assert [r.blocking for r in scan.gate(out["findings"]).collect()] == [True]


def test_folding_changes_no_finding(spark):
    """Chains of plain assignments are contracted for the search and put back for display."""
    code = "# === FILE: a.py ===\nq = request.args.get('q')\na = q\nb = a\nc = b\nos.system(c)\nd = q\ncursor.execute(d)\n# === FILE: b.py ===\nv = input()\nw = v\neval(w)\n"
    tables = {}
    for fold in (True, False):
        out, rows = findings(spark, code, fold=fold)
        tables[fold] = {(r["source_file"], r["source_line"], r["sink_file"], r["sink_line"], r["vuln_class"], r["severity"], r["confidence"]) for r in rows}
        steps = sorted({(r.pos, r.label, r.type) for r in out["steps"].where("file = 'a.py'").collect() if "c" in r.label or r.is_folded})
        if fold:
            assert any(label.startswith("(folded) a = q") for _, label, _ in steps) and out["fold_ratio"].first().ratio < 1
    assert tables[True] == tables[False] and len(tables[True]) >= 3


def test_framework_is_detected(spark):
    rows = "# === FILE: a.py ===\nimport flask\nx = session['k']\nrender_template_string(x)\n"
    with_profile, _ = findings(spark, rows)
    assert with_profile["nodes"].select("framework").distinct().first().framework == "flask"


def test_statements_over_several_lines(spark):
    code = "# === FILE: app.js ===\nfunction go(req) {\n  const {id} = req.query;\n  const sql = build(\n    id,\n    1\n  );\n  db.query(\n    sql\n  );\n}\n"
    out, rows = findings(spark, code)
    assert {(r["vuln_class"], r["sink_line"]) for r in rows} == {("sqli", 7)}
    assert out["nodes"].where("parent_id IS NOT NULL").count() == 3


def test_another_scorer(spark):
    """A scorer's answers count; where it has none the default's does."""
    from pyspark.sql import functions as F

    none = lambda paths: paths.withColumns({"llm_confidence": F.lit(None).cast("double"), "exploitable": F.lit(None).cast("boolean")})
    doubt = lambda paths: paths.withColumns({"llm_confidence": F.lit(0.2), "exploitable": F.lit(False)})
    code = "q = request.args.get('q')\nos.system(q)\n"
    got = [[(r["severity"], r["is_false_positive"]) for r in findings(spark, code, scorer=s)[1]] for s in (scan.verdicts, none, doubt)]
    assert got[0] == got[1] == [("critical", False)] and got[2] == [("low", True)]


def test_return_pairs_are_made_once(spark):
    """Calls named twice make one edge, and no pair is grouped once it is made."""
    from tracewright.operators import graph

    nodes = spark.createDataFrame([("s", "a", 1, "return", 5), ("s", "a", 1, "return", 5), ("s", "a", 2, "return", 5)], "scope string, file string, node_id bigint, node_type string, line int")
    calls = spark.createDataFrame([("s", "main", 9, "assignment", "f", "a")] * 2, "scope string, file string, node_id bigint, node_type string, func string, callee_file string")
    defs = spark.createDataFrame([("s", "a", "f", 1, 0)], "scope string, file string, name string, start_line int, ord bigint")
    out = graph.return_edges(nodes, calls, defs)
    assert sorted(map(tuple, out.collect())) == [("s", 1, 9, "<return:f>"), ("s", 2, 9, "<return:f>")]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_small_files_are_parsed_by_several_tasks(spark):
    """Files whose bytes are few are dealt out all the same, and none is lost."""
    from pyspark.sql import functions as F

    from tracewright.sources.files import _files

    made = spark.createDataFrame([("p", f"f{i:03}.py", f"q = input()\neval(q + '{i}')\n") for i in range(200)], "scope string, path string, source string").coalesce(1)
    files = _files(made.withColumns({"sha256": F.lit("x"), "n_bytes": F.octet_length("source").cast("bigint")}))
    out = scan.analyse(files, rules.default_rules(spark))
    assert out["parsed"].select("file").distinct().count() == 200
    assert len(out["parsed"].inputFiles()) > 1 and len(out["nodes"].inputFiles()) > 1
