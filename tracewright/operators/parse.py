"""Source files to syntax nodes, functions, imports and errors.

Python is parsed with the standard library's ``ast``; other languages by a
lexer of logical lines (a line goes on while a bracket is open) that recognises
assignments, calls, conditions, returns, imports and function headers, and
takes the parent of a node from the braces or, without them, the indent (an
approximation, stated in the README).  One file is one row of the input, so a
batch of files is parsed by ``mapInArrow`` wherever its rows lie; a file that
fails gives one row of kind ``error`` and no other file is touched.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.operators.intervals import names_below

_LONG, _INT, _TEXT, _TEXTS = T.LongType(), T.IntegerType(), T.StringType(), T.ArrayType(T.StringType())
#: Columns of the rows of each kind; a row has nulls for those of other kinds.
KINDS = {
    "node": {"node_ord": _LONG, "parent_ord": _LONG, "node_type": _TEXT, "label": _TEXT, "line": _INT, "col": _INT, "code": _TEXT, "defs": _TEXTS, "uses": _TEXTS, "calls": _TEXTS},
    "func": {"name": _TEXT, "params": _TEXTS, "start_line": _INT},
    "import": {"local_name": _TEXT, "module_stem": _TEXT},
    "error": {"message": _TEXT},
}
HEAD = {"scope": _TEXT, "file": _TEXT, "file_ord": _LONG, "kind": _TEXT}
ROW = T.StructType([T.StructField(n, t) for columns in (HEAD, *KINDS.values()) for n, t in columns.items()])

#: Node ids leave room for so many rows a file; a file with more is an error.
NODES = 1 << 24

_TYPES = {
    ast.Assign: "assignment", ast.AugAssign: "assignment", ast.AnnAssign: "assignment", ast.Return: "return", ast.If: "condition", ast.While: "condition",
    ast.For: "statement", ast.AsyncFor: "statement", ast.Expr: "statement", ast.Delete: "statement", ast.Assert: "statement", ast.Raise: "statement", ast.With: "statement",
    ast.Call: "call", ast.arg: "parameter", ast.Import: "import", ast.ImportFrom: "import", ast.FunctionDef: "function_def", ast.AsyncFunctionDef: "function_def", ast.ClassDef: "statement",
}


def _names(tree: ast.AST) -> list[str]:
    return list(dict.fromkeys(n.id for n in ast.walk(tree) if isinstance(n, ast.Name)))


def _calls(tree: ast.AST) -> list[str]:
    return list(dict.fromkeys(ast.unparse(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)))


def _targets(node: ast.AST) -> list[str]:
    """Plain names a node defines; attributes and subscripts define none."""
    if isinstance(node, ast.Assign):
        targets = node.targets
    elif isinstance(node, (ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor)):
        targets = [node.target]
    else:
        return []
    flat = [e for t in targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]
    return [t.id for t in flat if isinstance(t, ast.Name)]


def _uses(node: ast.AST) -> list[str]:
    if isinstance(node, (ast.Assign, ast.AnnAssign)):
        return _names(node.value) if node.value is not None else []
    if isinstance(node, (ast.Call, ast.Return, ast.Expr, ast.Delete, ast.Assert, ast.Raise)):
        return _names(node)
    return []


def parse_python(source: str) -> Iterator[tuple[str, dict]]:
    tree = ast.parse(source)
    lines = re.split("\r\n|\r|\n", source)  # the lines that ast counts
    number = 0

    def code_of(node: ast.AST) -> str:
        if isinstance(node, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return lines[node.lineno - 1].strip()
        return ast.get_source_segment(source, node) or ""

    def visit(node: ast.AST, parent: int | None) -> Iterator[tuple[str, dict]]:
        nonlocal number
        kind = _TYPES.get(type(node))
        if kind:
            number += 1
            parent_of_children = number
            code = code_of(node)
            yield "node", {"node_ord": number, "parent_ord": parent, "node_type": kind, "label": code[:80], "line": node.lineno - 1, "col": node.col_offset, "code": code, "defs": _targets(node), "uses": _uses(node), "calls": _calls(node) if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.If, ast.While, ast.For, ast.With)) else []}
        else:
            parent_of_children = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if x.arg != "self"]
            yield "func", {"name": node.name, "params": params, "start_line": node.lineno - 1}
        if isinstance(node, ast.Import):
            for x in node.names:
                yield "import", {"local_name": x.asname or x.name.split(".")[-1], "module_stem": x.name.split(".")[-1]}
        if isinstance(node, ast.ImportFrom):
            for x in node.names:
                yield "import", {"local_name": x.asname or x.name, "module_stem": (node.module or "").split(".")[-1]}
        for child in ast.iter_child_nodes(node):
            yield from visit(child, parent_of_children)

    yield from visit(tree, None)


_IDENT = re.compile(r"[$]?[A-Za-z_]\w*")
_ASSIGN = re.compile(r"^(?:(?:const|let|var|final|auto|local|export|mut|static)\s+)*(?:[\w<>\[\]*&:]+\s+)?[*&]?([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*(?::\s*[\w<>\[\] ]+)?\s*(?::=|(?<![=!<>+\-*/])=(?!=))\s*(.+)$")
_FUNC = re.compile(r"^(?:[\w<>\[\]*&:]+\s+)*?(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)")
_CALL = re.compile(r"([A-Za-z_][\w.:]*)\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "def", "else", "elif", "new", "const", "let", "var"}


_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`")
_COMMENT = ("//", "#include", "/*", "*", "# ")


def logical_lines(source: str) -> Iterator[tuple[int, str, int]]:
    """(first line, code, brace depth before it); round and square brackets join lines."""
    depth, waiting, first, open_brackets = 0, "", 0, 0
    for i, raw in enumerate(source.splitlines()):
        if not waiting and (not raw.strip() or raw.strip().startswith(_COMMENT)):
            continue
        bare = _STRING.sub("", raw)
        bare = bare.split("//")[0]
        if not waiting:
            first, open_brackets = i, 0
        open_brackets += sum(bare.count(c) for c in "([") - sum(bare.count(c) for c in ")]")
        waiting = f"{waiting} {raw.strip()}" if waiting else raw.rstrip()
        if open_brackets > 0 and not bare.rstrip().endswith("{"):
            continue
        yield first, waiting, depth - (1 if bare.strip().startswith("}") else 0)
        depth = max(0, depth + bare.count("{") - bare.count("}"))
        waiting = ""
    if waiting:
        yield first, waiting, depth


def _bound_names(left: str) -> list[str]:
    """Plain names that an assignment's left side or a destructuring pattern binds."""
    inner = left.strip().strip("{}[]()")
    return [n for part in inner.split(",") for n in re.findall(r"^\s*(?:\.\.\.)?(?:[A-Za-z_]\w*\s*:\s*)?([A-Za-z_]\w*)\s*(?:=.*)?$", part)]


_PATTERN = re.compile(r"^(?:export\s+)?(?:const|let|var|mut)\s+([{\[(][^=]*[}\])])\s*(?::\s*[\w<>\[\] ]+)?=(?!=)\s*(.+)$")


def parse_lines(source: str) -> Iterator[tuple[str, dict]]:
    """The lexer for languages without a parser at hand: one node a logical line."""
    number = 0
    parents: list[tuple[int, int]] = []  # depth and node of the headers around
    for i, raw, depth in logical_lines(source):
        code = raw.strip().rstrip(";")
        if not code or code in "{}()[];":
            continue
        while parents and parents[-1][0] >= depth:
            parents.pop()
        names = [n.lstrip("$") for n in _IDENT.findall(_STRING.sub(lambda m: m[0] if "$" in m[0] else "", code))]
        names = list(dict.fromkeys(n for n in names if n not in _WORDS))
        calls = list(dict.fromkeys(c for c in _CALL.findall(code) if c not in _WORDS))
        header, assigned, pattern = _FUNC.match(code), _ASSIGN.match(code), _PATTERN.match(code)
        defs: list[str] = []
        uses = names
        if header:
            kind, uses = "function_def", []
            params = [p for p in ((_IDENT.findall(x.split("=")[0].split(":")[0]) or [""])[-1] for x in header[2].split(",")) if p and p != "self"]
            yield "func", {"name": header[1], "params": params, "start_line": i}
        elif re.match(r"(import|from|require|use|package|#include)\b", code):
            kind, uses = "import", []
        elif re.match(r"return\b", code):
            kind = "return"
        elif re.match(r"(\}?\s*else\s+)?(if|while|switch|elif|case)\b", code):
            kind, uses = "condition", []
        elif pattern or assigned:
            kind = "assignment"
            right = (pattern or assigned)[2]
            defs = _bound_names(pattern[1]) if pattern else [d.strip() for d in assigned[1].split(",")]
            used = {n.lstrip("$") for n in _IDENT.findall(right)}
            uses = [n for n in names if n in used]
        else:
            kind = "call" if calls else "statement"
        number += 1
        yield "node", {"node_ord": number, "parent_ord": parents[-1][1] if parents else None, "node_type": kind, "label": code[:80], "line": i, "col": len(raw) - len(raw.lstrip()), "code": code, "defs": defs, "uses": uses, "calls": calls}
        if code.endswith("{"):
            parents.append((depth, number))


#: Parsers by language; languages without one go to the lexer of logical lines.
PARSERS: dict[str, Callable[[str], Iterable[tuple[str, dict]]]] = {"python": parse_python}


def register_parser(language: str, parser: Callable[[str], Iterable[tuple[str, dict]]]) -> None:
    """A parser for a language, used by every later :func:`parse_files`.

    It takes a file's text and gives (kind, columns) as in :data:`KINDS`;
    nodes are numbered from 1 in pre-order.  A ``ValueError`` or
    ``SyntaxError`` makes the file one row of kind ``error``.
    """
    PARSERS[language] = parser


def parse_file(language: str, source: str, parsers: dict | None = None) -> Iterable[tuple[str, dict]]:
    return (PARSERS if parsers is None else parsers).get(language, parse_lines)(source)


def parse_files(files: DataFrame) -> DataFrame:
    """files (scope, path, language, source, ord) to rows of the four kinds."""
    schema, parsers = to_arrow_schema(ROW), dict(PARSERS)  # what is registered goes with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for r in b.to_pylist():
                head = {"scope": r["scope"], "file": r["path"], "file_ord": r["ord"]}
                try:
                    found = [{**head, "kind": kind, **body} for kind, body in parse_file(r["language"], r["source"] or "", parsers)]
                    if len(found) >= NODES:
                        raise ValueError(f"{len(found)} rows")
                    rows += found
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({**head, "kind": "error", "message": str(e)[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("scope", "path", "language", "source", F.col("ord").cast("bigint").alias("ord")).mapInArrow(run, ROW)


def python_places(source: str) -> Iterator[dict]:
    """Spans of nodes and places of names, in one walk.

    Names and calls are numbered as they are met.  A node's ``use`` span holds
    the names it reads, its ``call`` span the calls in it, as :func:`_uses` and
    :func:`parse_python` list them; nodes that read or call nothing have none.
    """
    tree = ast.parse(source)
    number, place = 0, 0

    def visit(node: ast.AST) -> Iterator[dict]:
        nonlocal number, place
        mine, begin, read = None, place + 1, None
        if type(node) in _TYPES:
            number += 1
            mine = number
        if isinstance(node, ast.Name):
            place += 1
            yield {"of": "use", "place": place, "name": node.id}
        if isinstance(node, ast.Call):
            place += 1
            yield {"of": "call", "place": place, "name": ast.unparse(node.func)}
        for child in ast.iter_child_nodes(node):
            before = place + 1
            yield from visit(child)
            if child is getattr(node, "value", None):
                read = (before, place)
        spans = {}
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            spans["use"] = read
        elif isinstance(node, (ast.Call, ast.Return, ast.Expr, ast.Delete, ast.Assert, ast.Raise)):
            spans["use"] = (begin, place)
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.If, ast.While, ast.For, ast.With)):
            spans["call"] = (begin, place)
        if mine:
            yield from ({"of": of, "node_ord": mine, "first": s[0], "last": s[1]} for of, s in spans.items() if s and s[1] >= s[0])

    yield from visit(tree)


PLACE = T.StructType([T.StructField(n, t) for n, t in [("scope", _TEXT), ("file", _TEXT), ("file_ord", _LONG), ("of", _TEXT), ("node_ord", _LONG), ("first", _LONG), ("last", _LONG), ("place", _LONG), ("name", _TEXT)]])


def parse_places(files: DataFrame) -> DataFrame:
    """Python files (scope, path, language, source, ord) to spans of their nodes and places of names.

    Rows are linear in the text, however deep its trees; files of other
    languages and those that can't be parsed have none.
    """
    schema = to_arrow_schema(PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for r in b.to_pylist():
                try:
                    rows += [{"scope": r["scope"], "file": r["path"], "file_ord": r["ord"], **body} for body in python_places(r["source"] or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where("language = 'python'").select("scope", "path", "source", F.col("ord").cast("bigint").alias("ord")).mapInArrow(run, PLACE)


def names_of_nodes(places: DataFrame) -> DataFrame:
    """(scope, file, of, node_ord, name, at, n) of rows of :func:`parse_places`: what each node uses and calls."""
    spans = places.where("node_ord IS NOT NULL").select("scope", "file", "of", "node_ord", "first", "last")
    points = places.where("place IS NOT NULL").select("scope", "file", "of", "place", "name")
    return names_below(spans, points, ["scope", "file", "of"], ["node_ord"])


def _table(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col("kind") == kind).select("scope", "file", "file_ord", *KINDS[kind])


def node_table(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """pdg_nodes with ids that are unique in a scope: file order, then node order."""
    base = F.col("file_ord") * F.lit(NODES)
    out = _table(parsed, "node").withColumns({"node_id": base + F.col("node_ord"), "parent_id": base + F.col("parent_ord"), "ord": base + F.col("node_ord")}).drop("node_ord", "parent_ord")
    return out.join(files.select("scope", F.col("path").alias("file"), "language"), ["scope", "file"])


def func_table(parsed: DataFrame) -> DataFrame:
    out = _table(parsed, "func")
    return out.withColumn("ord", F.col("file_ord") * F.lit(NODES) + F.col("start_line")).drop("file_ord")


def import_table(parsed: DataFrame) -> DataFrame:
    out = _table(parsed, "import")
    return out.withColumn("ord", F.col("file_ord")).drop("file_ord")


def error_table(parsed: DataFrame) -> DataFrame:
    return _table(parsed, "error").drop("file_ord")


def module_table(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)
    return files.select("scope", stem.alias("stem"), "path", "ord")
