"""Edges that are pairs: every pair once, and none shuffled."""

import random

import pytest

from tracewright.operators import graph


def above_exchange(df):
    """What stands in the plan before its first exchange, so behind the last one."""
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


@pytest.mark.parametrize("seed", range(2))
def test_linked_pairs(spark, seed, monkeypatch):
    """Several names may link a pair: the least stays; lists are cut within a class."""
    monkeypatch.setattr(graph, "LISTS", (2, 3))
    rnd = random.Random(seed)
    ins = {("s", f"h{h}", f"v{h % 3}", rnd.randrange(20)) for h in range(5) for _ in range(12)}
    outs = {("s", f"h{h}", 15 + rnd.randrange(20)) for h in range(1, 6) for _ in range(12)}
    out = graph.linked_pairs(spark.createDataFrame(list(ins), "scope string, hub string, var string, src bigint"), spark.createDataFrame(list(outs), "scope string, hub string, dst bigint"))
    want = {}
    for _, h, v, a in ins:
        for _, g, b in outs:
            if h == g:
                want[a, b] = min(v, want.get((a, b), v))
    assert sorted((r.src, r.dst, r["var"]) for r in out.collect()) == sorted((*k, v) for k, v in want.items())
    assert above_exchange(out).count("Generate") == 2 and "Aggregate" not in above_exchange(out)


def test_argument_edges_of_several_parameters(spark):
    """Two parameters of one function, one of them given by two definitions, one by the call; a repeated parameter name."""
    nodes = spark.createDataFrame([("s", "a", 1, 1, ["x"], []), ("s", "a", 2, 2, ["x", "y"], []), ("s", "a", 3, 3, [], ["x"]), ("s", "b", 10, 0, [], ["p"]), ("s", "b", 11, 1, [], ["p", "q", "q"]), ("s", "b", 12, 2, [], ["q"])], "scope string, file string, node_id bigint, line int, defs array<string>, uses array<string>")
    calls = spark.createDataFrame([("s", "a", 3, "call", "b", "f", ["x", "y", "z"]), ("s", "a", 4, "return", "b", "f", ["", "x"]), ("s", "a", 5, "condition", "b", "f", ["x"])], "scope string, file string, node_id bigint, node_type string, callee_file string, func string, args array<string>")
    defs = spark.createDataFrame([("s", "b", "f", ["p", "q", "p"], 0, 1)], "scope string, file string, name string, params array<string>, start_line int, ord bigint")
    out = graph.argument_edges(nodes, calls, defs)
    got = {(r.src, r.dst): r["var"] for r in out.collect()}
    assert got == {(1, 11): "<arg:f:p>", (2, 11): "<arg:f:p>", (3, 11): "<arg:f:p>", (4, 11): "<arg:f:p>", (2, 12): "<arg:f:q>", (1, 12): "<arg:f:q>"}
    assert "Generate" in above_exchange(out) and "Aggregate" not in above_exchange(out)


@pytest.mark.parametrize("seed", range(2))
def test_shared_state_in_lists(spark, seed, monkeypatch):
    """Stores meet lists of reads at equal keys; other files' pairs come once, those that are there already don't."""
    monkeypatch.setattr(graph, "LISTS", (3, 3))
    rnd = random.Random(seed)
    stores = [(i, f"f{rnd.randrange(4)}", rnd.randrange(3)) for i in range(12)]
    reads = [(100 + i, f"f{rnd.randrange(4)}", rnd.sample(range(4), rnd.choice([1, 1, 2]))) for i in range(30)]
    rows = [("s", i, f, f"app.k{k} = 1") for i, f, k in stores] + [("s", i, f, "x = " + " + ".join(f"app.k{k}" for k in ks)) for i, f, ks in reads]
    nodes = spark.createDataFrame(rows, "scope string, node_id bigint, file string, code string")
    want = {(a, b, f"<shared:app.k{k}>") for a, f, k in stores for b, g, ks in reads if k in ks and f != g}
    known = sorted((a, b) for a, b, _ in want if (a + b) % 3 == 0)
    there = spark.createDataFrame([("s", *p) for p in known + known[:5] + [(0, 0), (999, 998)]], "scope string, src bigint, dst bigint")
    for existing, left in ((None, want), (there, {w for w in want if (w[0] + w[1]) % 3})):
        out = graph.shared_state_edges(nodes, existing)
        assert sorted((r.src, r.dst, r["var"]) for r in out.collect()) == sorted(left) and left
        above, *below = out._jdf.queryExecution().executedPlan().toString().split("Generate inline")
        assert below and "Exchange" not in above and "Aggregate" not in above


def test_degrees_read_their_edges_once(spark, tmp_path):
    from tracewright.operators import graph
    from tracewright.session import spread

    spark.range(3000).selectExpr("'s' AS scope", "id % 7 AS src", "10 + id AS dst").coalesce(1).write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    out = graph.degrees(spread(edges, "src", "dst", part_bytes=1000).distinct())
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert spread(edges, "src", part_bytes=1000).rdd.getNumPartitions() > 4
    got = {r.node_id: (r.n_in, r.n_out) for r in out.collect()}
    assert len(got) == 3007 and got[10] == (1, 0) and got[0] == (0, 429)


def test_pairs_are_handed_on_a_list_at_a_time(spark):
    """The loops over both lists are not one, which held a quarter of a million pairs before the first went on; no part is lost."""
    from tracewright.operators.graph import every_pair

    side = lambda node, n: spark.range(n).selectExpr("'s' AS scope", f"id AS {node}")
    out = every_pair(side("src", 300), side("dst", 1100), ["scope"])
    rows = out.collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows}) == 330_000
    last, first, _ = above_exchange(out).split("Generate")[:3]
    assert "Coalesce" in first and "Coalesce" not in last
    assert out.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
