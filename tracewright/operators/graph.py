"""Program-dependence graphs as node and edge tables.

Tables carry ``scope`` (one analysed project), so one plan serves many
projects.  Node ids are 64-bit; ``ord`` and ``edge_ord`` keep insertion order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import strip
from tracewright.operators.rules import any_pattern

# Names that are no calls or arguments.
KEYWORDS = [
    "True", "False", "None", "and", "or", "not", "in", "is", "if", "else", "for", "while", "return", "import", "from", "def", "class", "try", "except", "finally", "with", "as", "pass",
    "break", "continue", "lambda", "yield", "assert", "del", "global", "nonlocal", "raise", "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "type",
    "isinstance", "hasattr", "getattr", "setattr", "open", "super",
]
CALL = r"\b([A-Za-z_]\w*)\s*\(([^)]*)\)"
ATTRIBUTE_STORE = r"^((?:\w+\.)+\w+)\s*(?<![=!<>])=(?!=)"
ITEM_STORE = r"""^(\w+)\[(["'])([^"']+)\2\]\s*(?<![=!<>])=(?!=)"""
ATTRIBUTE_READ = r"\b((?:\w+\.){1,}\w+)\b"
ITEM_READ = r"""\b(\w+)\[(["'])([^"']+)\2\]"""


def def_use_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edge from every definition of a name to every use under the same keys.

    A pair of nodes has one edge; ``var`` is the least name that links it.
    Names are pre-joined by (keys, name), which AQE splits where skewed.
    """
    defs = nodes.select(*keys, F.col("node_id").alias("src"), F.explode(F.array_distinct("defs")).alias("var"))
    uses = nodes.select(*keys, F.col("node_id").alias("dst"), F.explode(F.array_distinct("uses")).alias("var"))
    return defs.join(uses, [*keys, "var"]).where("src <> dst").groupBy(*keys, "src", "dst").agg(F.min("var").alias("var"))


def collapse_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge per (src, dst): data dependence wins over control."""
    order = Window.partitionBy(*keys, "src", "dst").orderBy(F.when(F.col("edge_type") == "data_dep", 0).otherwise(1), F.col("var").desc_nulls_last())
    return edges.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def control_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """From the nearest classified ancestor to each node."""
    return nodes.where("parent_id IS NOT NULL").select(*keys, F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))


#: Nodes a list of :func:`every_pair`, before and behind an edge.
LISTS = 256, 1024


def every_pair(ins: DataFrame, outs: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, src, dst): each node of ``ins`` with each of ``outs`` under the same keys, which aren't null.

    Nodes meet in lists, so a quarter of a million pairs are one row while they
    are shuffled, and a key's pairs are spread over all tasks; pairs are only
    written out behind the last exchange, a list of ``outs`` at a time: in one
    generated loop all pairs of a row would be held before the first is handed
    on.  Rows of a side must be distinct.
    """
    from tracewright.operators.order import ranked

    def lists(side: DataFrame, node: str, size: int) -> DataFrame:
        placed = ranked(side.select(*keys, node), keys, [node]).withColumn(f"_at_{node}", F.floor((F.col("_rank") - 1) / size))
        return placed.groupBy(*keys, f"_at_{node}").agg(F.collect_list(node).alias(node))

    met = lists(ins, src, LISTS[0]).join(lists(outs, dst, LISTS[1]), keys)
    tasks = 4 * int(ins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = met.repartition(tasks, *keys, f"_at_{src}", f"_at_{dst}").drop(f"_at_{src}", f"_at_{dst}")
    # as many parts as there are: it only ends the loop over one list before that over the other
    return spread.withColumn(src, F.explode(src)).coalesce(tasks).withColumn(dst, F.explode(dst))


def linked_pairs(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """(scope, src, dst, var) of nodes that meet at a name: ``ins`` is (scope, hub, var, src), ``outs`` (scope, hub, dst).

    A pair that several names link has one row, with the least ``var``.  Nodes
    at the same names are one class; names are compared by classes, so that
    pairs of nodes need no grouping.  Names of a node are those of one statement.
    """
    from tracewright.session import stash

    def classes(side: DataFrame, node: str, kind: str) -> tuple[DataFrame, DataFrame]:
        held = side.groupBy("scope", node).agg(F.array_sort(F.collect_set("hub")).alias("_hubs"))
        held = stash(held.withColumn(kind, F.sha2(F.to_json("_hubs"), 256)), "classes")
        one = held.groupBy("scope", kind).agg(F.first("_hubs").alias("_hubs"))
        return held.select("scope", kind, node), one.select("scope", kind, F.explode("_hubs").alias("hub"))

    sources, at_in = classes(ins.select("scope", "hub", "src"), "src", "_in")
    uses, at_out = classes(outs, "dst", "_out")
    named = ins.groupBy("scope", "hub").agg(F.min("var").alias("var"))
    links = stash(at_in.join(at_out, ["scope", "hub"]).join(named, ["scope", "hub"]).groupBy("scope", "_in", "_out").agg(F.min("var").alias("var")), "links")
    # a class on the left stands under each class that it meets
    under = sources.join(links.select("scope", "_in", "_out", "var"), ["scope", "_in"])
    over = uses.join(links.select("scope", "_in", "_out", "var"), ["scope", "_out"])
    return every_pair(under, over, ["scope", "_in", "_out", "var"]).select("scope", "src", "dst", "var")


def store_key(code: Column) -> Column:
    """``a.b.c`` of ``a.b.c = ...``, ``x["k"]`` of ``x["k"] = ...``, else null."""
    c = strip(code)
    item = F.when(F.regexp_like(c, F.lit(ITEM_STORE)), F.concat(F.regexp_extract(c, ITEM_STORE, 1), F.lit('["'), F.regexp_extract(c, ITEM_STORE, 3), F.lit('"]')))
    attribute = F.when(F.regexp_like(c, F.lit(ATTRIBUTE_STORE)), F.regexp_extract(c, ATTRIBUTE_STORE, 1))
    return F.coalesce(item, attribute)


def read_keys(code: Column) -> Column:
    """Dotted names and items read by a statement; only the right side of a plain assignment."""
    c = strip(code)
    at = F.instr(c, F.lit("="))
    before, after = F.substr(c, at - 1, F.lit(1)), F.substr(c, at + 1, F.lit(1))
    assigns = (at > 1) & ~before.isin("!", "<", ">") & (after != "=")
    left = F.when(assigns, F.substr(c, F.lit(1), at - 1))
    scanned = F.when(assigns, F.substr(c, at + 1)).otherwise(c)
    items = F.transform(F.regexp_extract_all(scanned, F.lit(ITEM_READ), F.lit(0)), lambda x: F.regexp_replace(x, "'", '"'))
    keys = F.concat(F.regexp_extract_all(scanned, F.lit(ATTRIBUTE_READ), F.lit(1)), items)
    skipped = assigns & (F.contains(left, F.lit(".")) | F.contains(left, F.lit("[")))
    return F.when(skipped, F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def shared_state_edges(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges from stores to reads of a key in other files of the scope, each with its least key.

    Reads at the same keys are one class, whose nodes stand in lists of some
    hundred; a store meets the lists of the classes that its key leads to, and
    pairs are written out behind the last exchange.  Of ``existing`` edges those
    of a store and a list are gathered, which a list bounds, and left out.
    Node ids are unique in a scope, ``existing`` may repeat rows.
    """
    from tracewright.operators.order import ranked
    from tracewright.session import stash

    rows = nodes.select("scope", "node_id", "file", store_key(F.col("code")).alias("store"), "code")
    rows = stash(rows.withColumn("_keys", F.when(F.col("store").isNull(), F.array_sort(read_keys(F.col("code"))))).drop("code"), "keys")  # patterns are matched once
    stores = rows.where("store IS NOT NULL").select("scope", F.col("node_id").alias("src"), F.col("file").alias("_f"), F.col("store").alias("key")).distinct()
    reads = rows.where("store IS NULL").select("scope", F.col("node_id").alias("dst"), F.col("file").alias("_g"), "_keys").where(F.size("_keys") > 0)
    reads = reads.distinct().withColumn("_class", F.sha2(F.to_json("_keys"), 256))
    placed = stash(ranked(reads, ["scope", "_class"], ["dst", "_g"]).withColumn("_at", F.floor((F.col("_rank") - 1) / LISTS[0])).drop("_rank"), "placed")
    lists = placed.groupBy("scope", "_class", "_at").agg(F.first("_keys").alias("_keys"), F.collect_list(F.struct("dst", "_g")).alias("_reads"))
    # a store has one key and a class it once, so a store meets a list once
    met = stores.join(lists.select("scope", F.explode("_keys").alias("key"), "_class", "_at"), ["scope", "key"])
    gone = F.array().cast("array<bigint>")
    if existing is not None:
        known = existing.select("scope", "src", "dst").join(placed.select("scope", "dst", "_class", "_at"), ["scope", "dst"])
        known = known.groupBy("scope", "src", "_class", "_at").agg(F.collect_set("dst").alias("_known"))
        met = met.join(known, ["scope", "src", "_class", "_at"], "left")
        gone = F.coalesce(F.col("_known"), gone)
    new = met.withColumn("_gone", gone).select("scope", "src", "_f", "key", "_class", "_at", "_gone").join(lists.select("scope", "_class", "_at", "_reads"), ["scope", "_class", "_at"])
    pairs = new.select("scope", "src", "_f", "key", "_gone", F.inline("_reads")).where("_f <> _g AND src <> dst AND NOT array_contains(_gone, dst)")
    return pairs.select("scope", "src", "dst", F.concat(F.lit("<shared:"), "key", F.lit(">")).alias("var"))


def last_identifier(expression: Column) -> Column:
    """The last name in the expression that isn't a keyword, or an empty string."""
    names = F.regexp_extract_all(expression, F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1))
    good = F.filter(names, lambda x: ~x.isin(*KEYWORDS))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))


def parsed_calls(nodes: DataFrame) -> DataFrame:
    """One row per call in a node's code: its keys, ``func``, ``args``."""
    calls = F.filter(F.arrays_zip(F.regexp_extract_all("code", F.lit(CALL), F.lit(1)).alias("func"), F.regexp_extract_all("code", F.lit(CALL), F.lit(2)).alias("raw")), lambda c: ~c["func"].isin(*KEYWORDS))
    rows = nodes.select("scope", "node_id", "file", "node_type", "ord", F.posexplode(calls).alias("call_no", "_c"))
    raw = strip(F.col("_c.raw"))
    args = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(raw, ","), lambda a: last_identifier(strip(a))))
    return rows.select("scope", "node_id", "file", "node_type", "ord", "call_no", F.col("_c.func").alias("func"), args.alias("args"))


def resolve_callees(calls: DataFrame, func_defs: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``calls`` with ``callee_file``: by import, else the first other file that
    defines the name; calls that resolve to nothing are dropped."""
    by_import = imports.groupBy("scope", "file", "local_name").agg(F.max_by("module_stem", "ord").alias("stem")).join(modules.groupBy("scope", "stem").agg(F.max_by("path", "ord").alias("via")), ["scope", "stem"]).select("scope", "file", F.col("local_name").alias("func"), "via")
    by_name = func_defs.groupBy("scope", F.col("name").alias("func")).agg(F.min_by("file", "ord").alias("named"))
    out = calls.join(by_import, ["scope", "file", "func"], "left").join(by_name, ["scope", "func"], "left")
    callee = F.coalesce("via", F.when(F.col("named") != F.col("file"), F.col("named")))
    return out.withColumn("callee_file", callee).where("callee_file IS NOT NULL").drop("via", "named")


def positional_zip(calls: DataFrame, functions: DataFrame, keys: list[str], args: str = "args", params: str = "params") -> DataFrame:
    """Arguments beside the parameters at their places: ``pos``, ``arg``, ``param``; the longer side's rest goes."""
    given = calls.withColumn("_a", F.col(args)).select("*", F.posexplode("_a").alias("pos", "arg")).drop("_a", args)
    wanted = functions.select(*keys, *[c for c in functions.columns if c not in (*keys, params)], F.posexplode(params).alias("pos", "param"))
    return given.join(wanted, [*keys, "pos"])


def argument_edges(nodes: DataFrame, resolved: DataFrame, func_defs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """From definitions of an argument (or the call) to uses of its parameter
    after the function's first line; no pair is shuffled unless some are there already."""
    sig = func_defs.groupBy("scope", "file", "name").agg(F.max_by(F.struct("params", "start_line"), "ord").alias("s"))
    params = sig.select("scope", F.col("file").alias("callee_file"), F.col("name").alias("func"), "s.params", "s.start_line")
    callers = resolved.where(F.col("node_type").isin("call", "statement", "expression", "assignment", "return")).select("scope", "file", "node_id", "callee_file", "func", "args")
    zipped = positional_zip(callers, params, ["scope", "callee_file", "func"])
    hub, var = F.to_json(F.array("callee_file", "func", "param")), F.concat(F.lit("<arg:"), "func", F.lit(":"), "param", F.lit(">"))
    # the calls of a file that hand the same name to the same parameter share the name's definitions
    handed = zipped.withColumns({"hub": hub, "var": var})
    defs = nodes.select("scope", "file", F.col("node_id").alias("src"), F.explode(F.array_distinct("defs")).alias("arg"))
    by_def = handed.select("scope", "file", "arg", "hub", "var").distinct().join(defs, ["scope", "file", "arg"])
    by_call = handed.withColumnRenamed("node_id", "src").join(defs.select("scope", "file", "arg").distinct(), ["scope", "file", "arg"], "left_anti")
    ins = by_def.select("scope", "hub", "var", "src").unionByName(by_call.select("scope", "hub", "var", "src")).distinct()
    uses = nodes.select("scope", F.col("file").alias("callee_file"), F.col("node_id").alias("dst"), "line", F.explode(F.array_distinct("uses")).alias("param"))
    wanted = params.select("scope", "callee_file", "func", "start_line", F.explode(F.array_distinct("params")).alias("param"))
    outs = uses.join(wanted, ["scope", "callee_file", "param"]).where("line > start_line").select("scope", hub.alias("hub"), "dst").distinct()
    out = linked_pairs(ins, outs)
    return out if existing is None else out.join(existing.select("scope", "src", "dst"), ["scope", "src", "dst"], "left_anti")


def enclosing_function(rows: DataFrame, func_defs: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """As-of lookup: the last function of the keys that begins at or before a line.

    One sort of the union of both sides; no row is paired with all functions.
    """
    left = rows.select(*keys, F.col(line).alias("_line"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("bigint").alias("_ord"), F.struct(*rows.columns).alias("_row"))
    right = func_defs.select(*keys, F.col("start_line").alias("_line"), F.lit(0).alias("_kind"), F.col("name").alias("_name"), F.col("ord").cast("bigint").alias("_ord"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_line", "_kind", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("enclosing", F.last("_name", ignorenulls=True).over(order))
    return both.where("_kind = 1").select("_row.*", "enclosing")


def return_edges(nodes: DataFrame, resolved: DataFrame, func_defs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """From return statements of a function to assignments that call it.

    A return stands in one function, so pairs of distinct returns and distinct
    calls are distinct: both sides are made so, and no pair is shuffled.
    """
    returns = enclosing_function(nodes.where("node_type = 'return'").select("scope", "file", "node_id", "line"), func_defs, ["scope", "file"])
    returns = returns.where("enclosing IS NOT NULL").select("scope", F.col("file").alias("callee_file"), F.col("enclosing").alias("func"), F.col("node_id").alias("src")).distinct()
    sites = resolved.where("node_type = 'assignment'").select("scope", "callee_file", "func", F.col("node_id").alias("dst")).distinct()
    out = every_pair(returns, sites, ["scope", "callee_file", "func"]).select("scope", "src", "dst", F.concat(F.lit("<return:"), "func", F.lit(">")).alias("var"))
    return out if existing is None else out.join(existing.select("scope", "src", "dst"), ["scope", "src", "dst"], "left_anti")


def project_edges(nodes: DataFrame, func_defs: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """All data edges of a project: def-use, shared state, arguments, returns."""
    inside = def_use_edges(nodes, ["scope", "file"]).select("scope", "src", "dst", "var", F.lit(0).alias("_stage"))
    resolved = resolve_callees(parsed_calls(nodes), func_defs, imports, modules)
    parts = [shared_state_edges(nodes, inside), argument_edges(nodes, resolved, func_defs), return_edges(nodes, resolved, func_defs)]
    every = inside
    for i, part in enumerate(parts, 1):
        every = every.unionByName(part.select("scope", "src", "dst", "var", F.lit(i).alias("_stage")))
    # the first kind that makes an edge keeps it
    one = every.groupBy("scope", "src", "dst").agg(F.min(F.struct("_stage", "var")).alias("_m"))
    return one.select("scope", "src", "dst", F.col("_m.var").alias("var"), F.lit("data_dep").alias("edge_type"), F.array(F.col("_m._stage").cast("bigint"), F.col("dst")).alias("edge_ord"))


def degrees(edges: DataFrame) -> DataFrame:
    """(scope, node_id, n_in, n_out) of data edges."""
    end = lambda c, i, o: F.struct(F.col(c).alias("node_id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select("scope", F.inline(F.array(end("src", 0, 1), end("dst", 1, 0))))  # one pass over the edges
    return ends.groupBy("scope", "node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def passthrough_nodes(nodes: DataFrame, edges: DataFrame, patterns: list[str]) -> DataFrame:
    """Nodes that only hand a value on: one data edge in, one out, a type that
    may be folded and no pattern of any rule in the code.  ``edges`` may be a
    table of degrees (scope, node_id, n_in, n_out)."""
    kept = nodes.where(~F.col("node_type").isin("call", "condition", "function_def", "return", "parameter"))
    if patterns:
        kept = kept.where(~F.col("code").rlike(any_pattern(patterns, boundary=False)))
    counted = edges if "n_in" in edges.columns else degrees(edges)
    return kept.join(counted.where("n_in = 1 AND n_out = 1"), ["scope", "node_id"], "left_semi")


def fold_chains(edges: DataFrame, passthrough: DataFrame) -> DataFrame:
    """Contract A -> B -> C -> D with B, C passthrough to A -> D with folded [B, C].

    Every passthrough node has one edge in and one out.  Pointers to the chain's
    first node double in reach each round, so the rounds grow with the logarithm
    of the longest chain; a row holds a pointer and a rank, and nodes are listed
    once, at the end.  Circles of passthrough nodes alone vanish.  Of several
    edges between two nodes the first by ``edge_ord`` (of the edge that leaves
    A; where edges have no order, the least list) stays, with that order.
    """
    from tracewright.session import drop_stash, stash

    if "edge_ord" not in edges.columns:
        edges = edges.withColumn("edge_ord", F.lit(0))
    thru = passthrough.select("scope", F.col("node_id").alias("src"))
    plain = edges.select("scope", "src", "dst", "edge_ord")
    out_of = plain.join(thru, ["scope", "src"], "left_semi")
    into = plain.select("scope", F.col("dst").alias("node"), F.col("src").alias("before"), "edge_ord").join(thru.withColumnRenamed("src", "node"), ["scope", "node"], "left_semi")
    inner = into.join(thru.select("scope", F.col("src").alias("before"), F.lit(True).alias("_inner")), ["scope", "before"], "left")
    is_inner = F.col("_inner").isNotNull()
    # a chain's first node points to itself, the others to the node before
    state = stash(inner.select("scope", "node", F.when(is_inner, F.col("before")).otherwise(F.col("node")).alias("to"), is_inner.cast("bigint").alias("rank"), (~is_inner).alias("done")), "fold")
    heads = inner.where(~is_inner).select("scope", F.col("node").alias("to"), F.col("before").alias("src"), "edge_ord")
    open_nodes = state.where("NOT done").count()
    while open_nodes:
        target = state.select("scope", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("rank").alias("_rank"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(target, ["scope", "to"]).select("scope", "node", F.col("_to").alias("to"), (F.col("rank") + F.col("_rank")).alias("rank"), F.col("_done").alias("done"))
        after = stash(state.where("done").unionByName(moved), "fold")
        drop_stash(state)
        state, before = after, open_nodes
        open_nodes = state.where("NOT done").count()
        if open_nodes == before:
            break  # circles only
    chained = state.where("done").join(out_of.select("scope", F.col("src").alias("node"), "dst"), ["scope", "node"])
    chains = chained.groupBy("scope", "to").agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("_l"), F.max_by("dst", "rank").alias("dst"))  # a chain is one row of the result
    folded = chains.join(heads, ["scope", "to"]).select("scope", "src", "dst", "edge_ord", F.col("_l.node").alias("folded"))
    direct = plain.join(thru, ["scope", "src"], "left_anti").join(thru.withColumnRenamed("src", "dst"), ["scope", "dst"], "left_anti").withColumn("folded", F.array().cast("array<bigint>"))
    return direct.unionByName(folded).where("src <> dst").groupBy("scope", "src", "dst").agg(F.min(F.struct("edge_ord", "folded")).alias("_m")).select("scope", "src", "dst", "_m.edge_ord", "_m.folded")


def fold_ratio(nodes: DataFrame, folded: DataFrame) -> DataFrame:
    """Nodes before and after folding of each scope, and their ratio (1 where nothing is there)."""
    inside = folded.groupBy("scope").agg(F.sum(F.size("folded")).alias("_gone"))
    out = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n_before")).join(inside, "scope", "left").withColumn("n_after", F.col("n_before") - F.coalesce("_gone", F.lit(0)))
    return out.select("scope", "n_before", "n_after", F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).otherwise(1.0).alias("ratio"))


def unfold_paths(paths: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """Paths (``key``, ``path`` of node ids) with the folded nodes put back.

    One row per node: key, pos, node_id, is_folded.
    """
    pairs = paths.select("scope", key, F.posexplode("path").alias("at", "node_id"), F.col("path").alias("_p")).withColumn("_next", F.get("_p", F.col("at") + 1)).drop("_p")
    joined = pairs.join(folded.select("scope", F.col("src").alias("node_id"), F.col("dst").alias("_next"), "folded"), ["scope", "node_id", "_next"], "left")
    nodes = F.concat(F.array(F.struct(F.col("node_id").alias("n"), F.lit(False).alias("f"))), F.coalesce(F.transform("folded", lambda x: F.struct(x.alias("n"), F.lit(True).alias("f"))), F.array().cast("array<struct<n:bigint,f:boolean>>")))
    rows = joined.select("scope", key, "at", F.posexplode(nodes).alias("sub", "_n"))
    order = Window.partitionBy("scope", key).orderBy("at", "sub")
    return rows.select("scope", key, (F.row_number().over(order) - 1).alias("pos"), F.col("_n.n").alias("node_id"), F.col("_n.f").alias("is_folded"))


def path_steps(unfolded: DataFrame, nodes: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """Steps of unfolded paths for display: label, file, line and taint type.

    ``kinds`` (scope, key, node_id, type) has the type of the nodes that the
    search met; a folded node has the type of the last one before it and a
    label that begins with ``(folded)``.
    """
    facts = nodes.select("scope", "node_id", "label", "file", "line")
    rows = unfolded.join(facts, ["scope", "node_id"], "left").join(kinds, ["scope", key, "node_id"], "left")
    before = Window.partitionBy("scope", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = F.when(F.col("is_folded"), F.concat(F.lit("(folded) "), F.col("label"))).otherwise(F.col("label"))
    shown = F.last(F.when(~F.col("is_folded"), F.col("type")), ignorenulls=True).over(before)
    return rows.select("scope", key, "pos", "node_id", label.alias("label"), "file", "line", shown.alias("type"), "is_folded")
