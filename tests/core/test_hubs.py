"""Edges as hubs equal edges as pairs, and bits equal states."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph, hubs, taint

FACTS = "scope string, node_id bigint, ord bigint, file string, line int, source_type string, sink_class string, sink_severity string, san_power double, san_for array<string>"


def random_project(spark, seed, n=26):
    rnd = random.Random(seed)
    names = [f"v{i}" for i in range(4)]
    pick = lambda k: rnd.sample(names, rnd.choice([0, 0, 1, 1, k]))
    rows, facts = [], []
    for i in range(n):
        san = (rnd.choice([0.15, 0.5, 0.85]), [rnd.choice(["sqli", "xss"])]) if rnd.random() < 0.35 else (None, None)
        sink = rnd.choice(["sqli", "xss"]) if rnd.random() < 0.2 else None
        rows.append(("s", f"f{i % 3}", i, pick(2), pick(2)))
        facts.append(("s", i, i, f"f{i % 3}", rnd.randrange(5), "in" if rnd.random() < 0.25 else None, sink, sink and "high", *san))
    return spark.createDataFrame(rows, "scope string, file string, node_id bigint, defs array<string>, uses array<string>"), spark.createDataFrame(facts, FACTS)


@pytest.mark.parametrize("seed", range(3))
def test_paths_over_hubs(spark, seed):
    named, facts = random_project(spark, seed)
    held = hubs.def_use_hubs(named, ["scope"])
    both = hubs.pairs(held)
    edges = graph.def_use_edges(named, ["scope"])
    assert set(map(tuple, both.select("src", "dst").collect())) == set(map(tuple, edges.select("src", "dst").collect()))
    ordered = edges.select("scope", "src", "dst", F.array(F.lit(0).cast("bigint"), "dst").alias("edge_ord")).cache()
    columns = ["source_id", "sink_id", "label", "path_len", "path"]
    for prune in ("reference", "class_aware"):
        got, want = (taint.taint_paths(facts, e, max_pops=None, prune=prune, hubs=h, threshold=0.2) for e, h in ((None, held), (ordered, None)))
        rows = [Counter((*[str(r[c]) for c in columns], round(r.danger, 9)) for r in df.collect()) for df in (got, want)]
        assert rows[0] == rows[1] and rows[0]


def test_degrees_meet_a_hub_once(spark):
    """A node's two sides at a hub are one row of one join, whatever hubs lead nowhere; rows that repeat count once."""
    named, _ = random_project(spark, 5)
    loose = hubs.def_use_hubs(named, ["scope"], every=True)
    degree = {r.node_id: (min(2, r.n_in), min(2, r.n_out)) for r in graph.degrees(graph.def_use_edges(named, ["scope"])).collect()}
    for held in (loose, loose.unionByName(loose)):
        out = hubs.single_degrees(held)
        assert {r.node_id: (r.n_in, r.n_out) for r in out.collect() if r.n_in or r.n_out} == degree
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("seed", range(2))
def test_bits_are_states(spark, seed):
    """Also with more labels than a row has bits."""
    named, facts = random_project(spark, 10 + seed, 40)
    rnd = random.Random(seed)
    many = facts.withColumn("line", F.col("node_id").cast("int")).unionByName(spark.createDataFrame([("s", 100 + i, 100 + i, "f", 1000 + i, "in", None, None, None, None) for i in range(150)], FACTS))
    more = spark.createDataFrame([("s", 100 + i, rnd.randrange(40), i) for i in range(150)], "scope string, src bigint, dst bigint, edge_ord bigint")
    held = hubs.def_use_hubs(named, ["scope"])
    pairs = graph.def_use_edges(named, ["scope"]).select("scope", "src", "dst", F.col("dst").alias("edge_ord")).unionByName(more)
    want = taint.taint_paths(many, pairs, max_pops=None, max_len=300, prune="class_aware", threshold=0.0, keep_paths=False)
    want = Counter((r.label, r.sink_id) for r in want.collect())
    for e, h in ((more, held), (pairs, None)):
        found = taint.reachable(many, e, h).collect()
        assert len({tuple(r) for r in found}) == len(found)
        assert Counter((r.label, r.sink_id) for r in found) == want


@pytest.mark.parametrize("seed", range(2))
def test_twins_are_searched_once(spark, seed):
    """Most nodes are like others; some have edges of their own or stand at a name on both sides, one source has no line."""
    rnd = random.Random(seed)
    rows, facts = [], []
    for i in rnd.sample(range(90), 90):
        kind = rnd.choice(["source", "sink", "clean", "step", "nowhere"])
        defs, uses = {"source": ([f"a{i % 2}"], []), "sink": ([], ["b0"] + ["b1"] * (i % 2)), "nowhere": ([], ["b1"])}.get(kind, ([f"b{i % 2}"], [f"a{i % 2}"]))
        rows.append(("s", i, defs, uses + defs * (i % 11 == 0)))
        facts.append(("s", i, 100 - i, "f", None if i == 45 and kind == "source" else i % 2, "in" if kind == "source" else None, "xss" if kind == "sink" else None, "high" if kind == "sink" else None, 0.4 if kind == "clean" else None, ["xss"] if kind == "clean" else None))
    named = spark.createDataFrame(rows, "scope string, node_id bigint, defs array<string>, uses array<string>")
    nodes = spark.createDataFrame(facts, FACTS).cache()
    held = hubs.def_use_hubs(named, ["scope"]).cache()
    own = spark.createDataFrame([("s", rnd.randrange(45), 45 + rnd.randrange(45)) for _ in range(5)], "scope string, src bigint, dst bigint").distinct()
    pairs = hubs.pairs(held).select("scope", "src", "dst", F.array(F.col("stage").cast("bigint"), "dst").alias("edge_ord"))
    more = own.join(pairs, ["scope", "src", "dst"], "left_anti").select("scope", "src", "dst", F.array(F.lit(-1).cast("bigint"), "dst").alias("edge_ord")).cache()
    for edges, every in ((None, pairs), (more, pairs.unionByName(more))):
        want = taint.taint_paths(nodes.where("line IS NOT NULL"), every, max_pops=None)
        got = taint.taint_paths(nodes.where("line IS NOT NULL"), edges, max_pops=None, hubs=held)
        shown = [Counter((r.label, r.source_id, r.sink_id, r.path_len, tuple(r.path), tuple(r.ord.pos), round(r.danger, 9)) for r in df.collect()) for df in (got, want)]
        assert shown[0] == shown[1] and shown[0]
        bits = Counter((r.label, r.sink_id) for r in taint.reachable(nodes, edges, held).collect())
        full = taint.taint_paths(nodes.where("line IS NOT NULL"), every, max_pops=None, prune="class_aware", threshold=0.0, keep_paths=False)
        assert bits == Counter((r.label, r.sink_id) for r in full.collect())
    labelled = nodes.withColumn("label", F.when(F.col("source_type").isNotNull(), F.col("line").cast("string")))
    few, standing = hubs.twins(labelled, held)
    assert few.count() < 40 and standing.count() == nodes.where("sink_class IS NOT NULL").count()


def test_project_hubs(spark):
    """All four kinds, and degrees, on a project of several files."""
    from tracewright.operators import parse
    from tracewright.operators.rules import default_rules
    from tracewright.plans.scan import analyse
    from tracewright.sources.files import split_payload

    files = {
        "a.py": "import lib\nfrom lib import load\ndef f(x):\n    y = x\n    return y\napp.state.user = f(1)\nq = load(app.name)\nr = load(q)\nt = lib.load(q, r)\n",
        "lib.py": "def load(name, other=None):\n    a = name\n    b = a\n    return b\nu = app.state.user\napp.name = u\n",
        "c.py": "app.state.user = 3\nz = app.state.user\nw = app.name\ncfg['k'] = w\n",
        "d.py": "from a import f\nv = cfg['k']\ng = f(v)\nh = f(g)\nprint(app.state.user)\n",
    }
    payload = "".join(f"# === FILE: {name} ===\n{text}" for name, text in files.items())
    project = split_payload(spark.createDataFrame([("s", payload)], "scope string, payload string"))
    out = analyse(project, default_rules(spark))
    nodes, parsed = out["nodes"], out["parsed"]
    held = hubs.project_hubs(nodes, parse.func_table(parsed), parse.import_table(parsed), parse.module_table(project)).cache()
    got = {(r.src, r.dst) for r in hubs.pairs(held).collect()}
    want = {(r.src, r.dst) for r in out["edges"].collect()}
    assert got == want and {r.stage for r in held.select("stage").distinct().collect()} == {0, 1, 2, 3}
    degree = {r.node_id: (min(2, r.n_in), min(2, r.n_out)) for r in graph.degrees(out["edges"]).collect()}
    single = {r.node_id: (r.n_in, r.n_out) for r in hubs.single_degrees(held).collect()}
    assert {k: v for k, v in single.items() if v != (0, 0)} == degree


@pytest.mark.parametrize("seed", range(2))
def test_folding_over_hubs(spark, seed):
    """Paths over folded hubs, put back together, are those over folded pairs."""
    named, facts = random_project(spark, 20 + seed, 40)
    held = hubs.def_use_hubs(named, ["scope"]).cache()
    ordered = hubs.pairs(held).select("scope", "src", "dst", F.array(F.col("stage").cast("bigint"), "dst").alias("edge_ord")).cache()
    plain = facts.where("source_type IS NULL AND sink_class IS NULL AND san_power IS NULL").select("scope", "node_id", F.lit("assignment").alias("node_type"), F.lit("x").alias("code"))
    thru = [graph.passthrough_nodes(plain, ordered, []), hubs.passthrough_nodes(plain, held, [])]
    assert {r.node_id for r in thru[0].collect()} == {r.node_id for r in thru[1].collect()}
    anchors = facts.join(thru[0], ["scope", "node_id"], "left_anti")
    shown = []
    for folded, rest in ((graph.fold_chains(ordered, thru[0]), None), hubs.fold_hubs(held, thru[1])):
        paths = taint.taint_paths(anchors, folded, max_pops=None, hubs=rest, threshold=0.2).withColumn("key", F.concat_ws("|", "source_id", "sink_id", "label", "path_len", F.concat_ws(",", "path")))
        shown.append(Counter((r.key, r.pos, r.node_id, r.is_folded) for r in graph.unfold_paths(paths, folded, "key").collect()))
    assert shown[0] == shown[1]


def test_analysis_over_hubs(spark):
    from test_scan import PROJECT, findings

    columns = ["vuln_class", "source_file", "source_line", "sink_file", "sink_line", "confidence"]
    one, two = ([tuple(r[c] for c in columns) for r in findings(spark, PROJECT, **kw)[1]] for kw in ({"max_pops": None}, {"as_hubs": True}))
    assert sorted(one) == sorted(two) and one


def test_own_rules_change_no_verdict(spark):
    """A statement that only mentions a placeholder is no sanitizer unless the further rules are asked for."""
    from tracewright.operators.rules import default_rules
    from tracewright.plans.scan import analyse
    from tracewright.sources.files import inline_file

    code = 'q = request.args.get("q")\ns = "SELECT %s", q\ncursor.execute(s)\n'
    found = [[(r.vuln_class, r.source_line, r.sink_line) for r in analyse(inline_file(spark, code), default_rules(spark, more))["findings"].where("analyzer = 'taint'").collect()] for more in (False, True)]
    assert found == [[("sqli", 0, 2)], []]
