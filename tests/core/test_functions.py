"""Sources, text helpers, folding and streams on small inputs."""

from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators import findings as fd
from tracewright.operators import graph, rules
from tracewright.plans import report
from tracewright.sources import files
from tracewright.streaming import limits


def test_payload_rules(spark):
    payload = "ignored\n# === FILE: a/b.js ===\nx\n# ==== FILE: n ====\ny\n# === FILE: n.py ===\nz\n"
    got = {r.path: r.source for r in files.split_payload(spark.createDataFrame([("s", payload)], "scope string, payload string")).collect()}
    assert set(got) == {"b.js", "n.py"} and got["n.py"].strip() == "z"
    assert [r.path for r in files.inline_file(spark, "x = 1").collect()] == ["scan_target.py"]


def test_directory_and_selection(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, body in {"a.py": "x=1\n", "vendor/b.py": "y=1\n", "c.min.js": "z", "d.txt": "no"}.items():
        (tmp_path / name).write_text(body)
    got = {r.path.rsplit("/", 1)[-1]: (r.language, r.reason) for r in files.select_files(files.scan_directory(spark, str(tmp_path))).collect()}
    assert got == {"a.py": ("python", None), "b.py": ("python", "vendor"), "c.min.js": ("javascript", "minified")}


def test_word_boundary_and_framework_rules(spark):
    cat = rules.default_rules(spark)
    rows = spark.createDataFrame([("get_user_input()", "python"), ("x = input()", "python"), ("send_file(p)", "go"), ("anything req.body", "cobol")], "code string, language string")
    kinds = {r.code: r.rule.tag if r.rule else None for r in rules.first_match(rows, cat, "code", "language", "source").collect()}
    assert kinds == {"get_user_input()": None, "x = input()": "user_input", "send_file(p)": None, "anything req.body": "http_body"}
    cat = rules.default_rules(spark, more=True)  # sending files is among the rules that are asked for
    flask = rules.first_matches(rows, cat, "code", "language", {"sink": True}, F.lit("flask")).withColumnRenamed("_sink", "rule")
    assert {r.code for r in flask.where("rule IS NOT NULL").collect()} == {"send_file(p)"}


def test_catalogue_is_full(spark):
    base = [r for r in rules.CATALOGUE[:357] if r[2] is None]
    counts = {k: sum(r[0] == k for r in base) for k in ("source", "sink", "sanitizer")}
    assert counts == {"source": 68, "sink": 158, "sanitizer": 85}
    profiles = {fw: tuple(sum(r[0] == k and r[2] == fw for r in rules.CATALOGUE[:357]) for k in counts) for fw in ("flask", "django", "fastapi", "express")}
    assert profiles == {"flask": (8, 3, 1), "django": (7, 4, 5), "fastapi": (6, 1, 1), "express": (6, 3, 1)}
    cat = rules.default_rules(spark)
    rows = spark.createDataFrame([("minidom.parse(x)", "python"), ("conn.search_s(base)", "javascript"), ("res.redirect(u)", "typescript")], "code string, language string")
    got = {r.code: r.rule.tag for r in rules.first_match(rows, cat, "code", "language", "sink").collect()}
    assert got == {"minidom.parse(x)": "xxe", "conn.search_s(base)": "ldap_injection", "res.redirect(u)": "open_redirect"}


def test_store_and_read_keys(spark):
    rows = spark.createDataFrame([("a.b = c.d",), ('x["k"] = 1',), ("y = x['k'] + m.n",), ("if a.b == 2:",)], "code string")
    got = {r.code: (r.s, r.r) for r in rows.select("code", graph.store_key(F.col("code")).alias("s"), graph.read_keys(F.col("code")).alias("r")).collect()}
    assert got["a.b = c.d"][0] == "a.b" and got['x["k"] = 1'][0] == 'x["k"]'
    assert got["y = x['k'] + m.n"][1] == ["m.n", 'x["k"]'] and got["if a.b == 2:"][1] == ["a.b"]


def test_fold_and_unfold(spark):
    edges = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 4), ("s", 4, 5), ("s", 1, 6)], "scope string, src bigint, dst bigint")
    thru = spark.createDataFrame([("s", 2), ("s", 3)], "scope string, node_id bigint")
    folded = graph.fold_chains(edges, thru)
    assert {(r.src, r.dst, tuple(r.folded)) for r in folded.collect()} == {(1, 4, (2, 3)), (4, 5, ()), (1, 6, ())}
    paths = spark.createDataFrame([("s", "p", [1, 4, 5])], "scope string, key string, path array<bigint>")
    assert [r.node_id for r in graph.unfold_paths(paths, folded, "key").orderBy("pos").collect()] == [1, 2, 3, 4, 5]


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.truncate(F.lit("one two three"), 9).alias("t"), text.fenced_json(F.lit("x\n```json\n{\"a\": 1}\n```")).alias("j"),
        text.owner_and_name(F.lit("https://github.com/o/n.git")).alias("o"), text.recovered_script(F.lit('{"script": """print(1)"""}')).alias("s"),
        text.unified_diff(F.lit("a\n"), F.lit("b\n"), F.lit("f.py")).alias("d"),
    ).first()
    assert (row.t, row.j, row.o.owner, row.o.name, row.s) == ("one two…", '{"a": 1}', "o", "n", "print(1)")
    assert row.d == "--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-a\n+b\n"


def test_differential_first_match(spark):
    ours = spark.createDataFrame([(1, "f", 10), (2, "f", 30)], "id bigint, file string, line bigint")
    theirs = spark.createDataFrame([(7, "f", 15, 1), (8, "f", 6, 0), (9, "g", 10, 2)], "other_id bigint, file string, other_line bigint, other_ord bigint")
    got = {(r.bucket, r.id, r.other_id) for r in fd.differential(ours, theirs, ["file"]).collect()}
    assert got == {("overlap", 1, 8), ("ours_only", 2, None), ("theirs_only", None, 7), ("theirs_only", None, 9)}


def test_running_prefix_tail(spark):
    rows = spark.createDataFrame([("k", 1, 600), ("k", 2, 700), ("k", 3, 100)], "k string, o int, w int")
    assert [(r.o, r.taken) for r in fd.running_prefix(rows, ["k"], ["o"], "w", 1200, 500).orderBy("o").collect()] == [(1, 600), (2, 600)]


def test_report(spark):
    rows = scoring.classify(spark.createDataFrame([("a", "sqli", "critical", "f.py", 3)], "id string, vuln_class string, severity string, sink_file string, sink_line int")).withColumn("title", F.col("class_title"))
    page = report.render(report.context(rows))
    assert "1 finding (1 critical)" in page and "CWE-89" in page and "Medium Risk" not in page


def test_stream_of_daily_limits(spark, tmp_path):
    rows = spark.sql("SELECT 'u' AS identity, timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,id) AS ts FROM range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = limits.run_to_table(limits.daily_counts(stream, lateness="1 day"), str(tmp_path / "out"), str(tmp_path / "check"), keys=["identity", "day"])
    assert [(r.used, r.remaining, r.allowed) for r in counted.collect()] == [(5, 0, False)]


def test_fan_out(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    got = []
    limits.fan_out(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda batch, n: got.extend(r.id for r in batch.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(got) == [0, 1, 2, 3]
