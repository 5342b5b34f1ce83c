"""Queries of edges as hubs and of reachability by bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import hubs, taint
from tracewright.plans.registry import query


@query("""WITH n AS (SELECT l_orderkey AS f, l_linenumber AS id, l_suppkey % 5 AS d, l_partkey % 5 AS u FROM lineitem),
m AS (SELECT DISTINCT f, 'v' || d AS var, id, 'in' AS side FROM n UNION ALL SELECT DISTINCT f, 'v' || u, id, 'out' FROM n),
h AS (SELECT f, var FROM m GROUP BY 1, 2 HAVING count(DISTINCT side) = 2)
SELECT f AS l_orderkey, var, id AS node_id, side FROM m JOIN h USING (f, var)""")
def def_use_hubs(t):
    """Definitions and uses of a name in an order's lines, a row each."""
    name = lambda c: F.array(F.concat(F.lit("v"), (F.col(c) % 5).cast("string")))
    nodes = t.lineitem.select(F.lit("s").alias("scope"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("node_id"), name("l_suppkey").alias("defs"), name("l_partkey").alias("uses"))
    held = hubs.def_use_hubs(nodes, ["scope", "file"])
    parts = F.split("hub", hubs.SEPARATOR)
    return held.select(F.get(parts, F.lit(1)).cast("bigint").alias("l_orderkey"), F.get(parts, F.lit(2)).alias("var"), "node_id", "side")


def _market(t):
    """Customers define their nation's name, its suppliers use it and define one of 97 names, which orders use.

    As pairs: customers times suppliers of a nation, and suppliers times orders
    of a name.  Suppliers in debt are sanitizers, pending orders are sinks.
    """
    none = F.array().cast("array<string>")
    nation = lambda c: F.array(F.concat(F.lit("n"), F.col(c)))
    name = lambda c: F.array(F.concat(F.lit("s"), F.col(c) % 97))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def table(df, node, line, defs, uses, source=text, sink=text, power=number):
        return df.select(F.lit("s").alias("scope"), node.alias("node_id"), node.alias("ord"), F.lit("f").alias("file"), line.cast("int").alias("line"), defs.alias("defs"), uses.alias("uses"), source.alias("source_type"), sink.alias("sink_class"), F.when(sink.isNotNull(), "high").alias("sink_severity"), power.alias("san_power"), F.when(power.isNotNull(), F.array(F.lit("trade"))).alias("san_for"))

    base = lambda k: F.lit(k << 40)
    out = table(t.customer, F.col("c_custkey") + base(1), F.col("c_nationkey"), nation("c_nationkey"), none, source=F.lit("customer"))
    out = out.unionByName(table(t.supplier, F.col("s_suppkey") + base(2), F.lit(0), name("s_suppkey"), nation("s_nationkey"), power=F.when(F.col("s_acctbal") < 0, 0.4)))
    out = out.unionByName(table(t.orders, F.col("o_orderkey") + base(3), F.lit(0), none, name("o_custkey"), sink=F.when(F.col("o_orderstatus") == "P", F.lit("trade"))))
    return out


MARKET = """WITH s AS (SELECT DISTINCT 'src:' || c_nationkey AS label, s_suppkey % 97 AS k, s_acctbal < 0 AS clean FROM customer JOIN supplier ON c_nationkey = s_nationkey),
r AS (SELECT DISTINCT label, o_orderkey, clean FROM s JOIN orders ON k = o_custkey % 97 WHERE o_orderstatus = 'P')"""


@query(MARKET + """ SELECT label, o_orderkey, CASE WHEN clean THEN 'partially_sanitized' ELSE 'tainted' END AS type FROM r""")
def hub_reach(t):
    """Which nations' customers reach which pending orders, walking names."""
    nodes = _market(t)
    found = taint.reachable(nodes, hubs=hubs.def_use_hubs(nodes, ["scope"]))
    return found.select("label", (F.col("sink_id") - (3 << 40)).alias("o_orderkey"), "type")


@query(MARKET + """ SELECT label, o_orderkey, 3 AS path_len, round(CASE WHEN clean THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 4) AS danger FROM r""")
def hub_paths(t):
    """The same with the danger and length of the first path of each label and type."""
    nodes = _market(t)
    found = taint.taint_paths(nodes, None, max_pops=None, keep_paths=False, hubs=hubs.def_use_hubs(nodes, ["scope"]))
    return found.select("label", (F.col("sink_id") - (3 << 40)).alias("o_orderkey"), "path_len", F.round("danger", 4).alias("danger"))


@query("""WITH n AS (SELECT l_orderkey AS f, l_linenumber AS id, l_suppkey % 5 AS d, l_partkey % 5 AS u FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
e AS (SELECT DISTINCT a.f, a.id AS src, b.id AS dst FROM n a JOIN n b ON a.f = b.f AND a.d = b.u AND a.id <> b.id),
i AS (SELECT f, dst AS id, count(*) AS k FROM e GROUP BY 1, 2), o AS (SELECT f, src AS id, count(*) AS k FROM e GROUP BY 1, 2)
SELECT coalesce(i.f, o.f) AS l_orderkey, coalesce(i.id, o.id) AS node_id, least(2, coalesce(i.k, 0)) AS n_in, least(2, coalesce(o.k, 0)) AS n_out FROM i FULL JOIN o ON i.f = o.f AND i.id = o.id""")
def hub_degrees(t):
    """Edges in and out of every line, 2 for more, without their pairs."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("d"), F.min("l_partkey").alias("u"))
    name = lambda c: F.array(F.concat(F.lit("v"), (F.col(c) % 5).cast("string")))
    nodes = lines.select(F.col("l_orderkey").cast("string").alias("scope"), F.col("l_linenumber").alias("node_id"), name("d").alias("defs"), name("u").alias("uses"))
    out = hubs.single_degrees(hubs.def_use_hubs(nodes, ["scope"], every=True)).where("n_in > 0 OR n_out > 0")
    return out.select(F.col("scope").cast("bigint").alias("l_orderkey"), "node_id", "n_in", "n_out")


def _trades(t, changed: bool):
    """A project a nation: a file for each supplier that calls one of the nation's five libraries; in the changed one every
    seventh supplier's file is another, some are gone, and a nation's libraries are rewritten."""
    from tracewright.sources.files import _files

    debt = (F.col("s_acctbal") < 0) if not changed else (F.col("s_acctbal") < 0) != (F.col("s_suppkey") % 7 == 0)
    library = F.col("s_suppkey") % 5
    head = F.when(debt, F.lit("q = request.args.get('q')\n")).otherwise(F.lit("q = 'fixed'\n"))
    source = F.concat(F.lit("from lib"), library, F.lit(" import go"), library, F.lit("\n"), head, F.lit("go"), library, F.lit("(q)\n"))
    own = t.supplier.where("s_suppkey % 11 <> 0" if changed else "true").select(F.concat(F.lit("n"), "s_nationkey").alias("scope"), F.concat(F.lit("f"), "s_suppkey", F.lit(".py")).alias("path"), source.alias("source"))
    body = F.when((F.col("n_nationkey") % 9 == 4) & F.lit(changed), F.lit("(x):\n    print(x)\n")).otherwise(F.lit("(x):\n    os.system(x)\n"))
    libraries = t.nation.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.concat(F.lit("n"), "n_nationkey").alias("scope"), F.concat(F.lit("lib"), "k", F.lit(".py")).alias("path"), F.concat(F.lit("def go"), "k", body).alias("source"))
    made = own.unionByName(libraries)
    return _files(made.withColumns({"sha256": F.sha2("source", 256), "n_bytes": F.octet_length("source").cast("bigint")}))


@query("""WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS scope, (s_acctbal < 0) <> (s_suppkey % 7 = 0) AS bad FROM supplier WHERE s_suppkey % 11 <> 0 AND s_nationkey % 9 <> 4)
SELECT scope, 'f' || min(k::VARCHAR) || '.py' AS source_file, 1 AS source_line, 'lib' || k % 5 || '.py' AS sink_file, 1 AS sink_line, 'cmdi' AS vuln_class FROM s WHERE bad GROUP BY scope, k % 5""")
def incremental_findings(t):
    """An update of the stored analysis: one finding for each library that a supplier's input reaches, from the first of them."""
    from tracewright.operators.rules import default_rules
    from tracewright.plans import incremental
    from tracewright.session import fresh_path

    path, rules = fresh_path(t.spark, "analysis"), default_rules(t.spark)
    incremental.store(incremental.whole(_trades(t, False), rules), path)
    out = incremental.update(_trades(t, True), rules, incremental.load(t.spark, path))
    found = out["findings"].where("analyzer = 'taint'")
    return found.select("scope", "source_file", F.col("source_line").cast("int").alias("source_line"), "sink_file", F.col("sink_line").cast("int").alias("sink_line"), "vuln_class")


@query("""WITH f AS (SELECT 'n' || s_nationkey AS scope, 'f' || s_suppkey || '.py' AS file, s_suppkey % 5 AS k FROM supplier), l AS (SELECT 'n' || n_nationkey AS scope, k FROM nation, (SELECT unnest(range(5)) AS k))
SELECT scope, file, 'import' AS kind, 'go' || k AS name, 'lib' || k AS what FROM f UNION ALL SELECT scope, 'lib' || k || '.py', 'function', 'go' || k, 'x' FROM l
UNION ALL SELECT scope, file, 'module', left(file, length(file) - 3), file FROM f UNION ALL SELECT scope, 'lib' || k || '.py', 'module', 'lib' || k, 'lib' || k || '.py' FROM l""")
def parsed_symbols(t):
    """Functions with their parameters, imports with their modules, and the modules that files are."""
    from tracewright.operators import parse
    from tracewright.session import spread, stash

    files = _trades(t, False)
    parsed = stash(parse.parse_files(spread(files, "scope", "path")), "parsed")
    row = lambda df, kind, name, what: df.select("scope", "file", F.lit(kind).alias("kind"), F.col(name).alias("name"), what.alias("what"))
    out = row(parse.func_table(parsed), "function", "name", F.array_join("params", ","))
    out = out.unionByName(row(parse.import_table(parsed), "import", "local_name", F.col("module_stem")))
    return out.unionByName(row(parse.module_table(files).withColumn("file", F.col("path")), "module", "stem", F.col("path")))


@query("""WITH p AS (SELECT doc_id AS ord, substr(text, 1 + (doc_id % 40)::INT, 7) AS pattern FROM documents)
SELECT d.doc_id, min(p.ord) AS ord FROM documents d JOIN p ON p.pattern <> '' AND contains(d.text, p.pattern) GROUP BY 1""")
def rule_index(t):
    """As many rules as there are documents, a few characters of each: the first that matches every document."""
    from tracewright.operators.rule_index import first_match_indexed

    rules = t.documents.select(F.col("doc_id").alias("ord"), F.substring("text", 1 + F.col("doc_id") % 40, 7).alias("pattern"), F.lit("t").alias("tag"))
    found = first_match_indexed(t.documents, rules, ["doc_id"], "text", boundary=False)
    return found.select("doc_id", F.col("rule.ord").alias("ord"))
