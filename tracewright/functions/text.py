"""Text, path, URL and time helpers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions of languages, excluded paths and names, hosts, framework patterns.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rb": "ruby", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rs": "rust", ".sh": "bash", ".bash": "bash",
}
EXCLUDED_PATHS = [
    "/node_modules/", "/vendor/", "/vendors/", "/static/js/", "/static/css/", "/assets/js/", "/assets/css/", "/dist/", "/build/", "/.venv/", "/venv/", "/env/",
    "/__pycache__/", "/.git/", "/bower_components/", "/jspm_packages/",
]
EXCLUDED_NAMES = [".min.js", ".min.css", ".bundle.js", ".chunk.js", "-min.js", ".packed.js"]
MAX_FILE_BYTES, MAX_FILE_LINES = 200_000, 10_000
HOSTS = ["https://github.com/", "https://gitlab.com/", "https://bitbucket.org/"]
FRAMEWORKS = [
    ("flask", r"from flask\b|import flask\b|flask\.Flask\b"),
    ("django", r"from django\b|import django\b|django\.conf\b"),
    ("fastapi", r"from fastapi\b|import fastapi\b|FastAPI\(\)"),
    ("express", r"""require\(['"]express['"]\)|from ['"]express['"]"""),
    ("nextjs", r"""from ['"]next/|import.*from ['"]next['"]"""),
]


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


#: Every line end that Python's ``splitlines`` knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def line_array(source: Column) -> Column:
    """The lines of a text; a trailing line end adds none."""
    lines = F.split(source, LINE_END, -1)
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    """By extension; python where it is unknown."""
    ext, out = extension(path), F.lit("python")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def exclusion_reason(path: Column, n_bytes: Column, paths: list[str] | None = None, names: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """vendor, minified, oversized or null, the first that holds."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    vendor = F.lit(False)
    for p in EXCLUDED_PATHS if paths is None else paths:
        vendor = vendor | F.contains(low, F.lit(p.lower()))
    minified = F.lit(False)
    for n in EXCLUDED_NAMES if names is None else names:
        minified = minified | F.endswith(low, F.lit(n.lower()))
    return F.when(vendor, "vendor").when(minified, "minified").when(n_bytes > max_bytes, "oversized")


def is_third_party(path: Column) -> Column:
    return exclusion_reason(path, F.lit(0)).isNotNull()


def repository_allowed(url: Column) -> Column:
    ok = F.lit(False)
    for h in HOSTS:
        ok = ok | F.startswith(url, F.lit(h))
    return ok & ~url.rlike(r"[;&|`$<>]|\.\.")


def request_error(source_type: Column, source: Column, limit: int = 10 * 1024 * 1024) -> Column:
    """Why a scan request is refused, or null: type, repository or size."""
    bad_type = ~F.coalesce(source_type.isin("github_url", "raw_code"), F.lit(False))
    return F.when(bad_type, "source_type").when((source_type == "github_url") & ~repository_allowed(source), "repository").when((source_type == "raw_code") & (F.char_length(source) > limit), "size")


def triage_error(status: Column, notes: Column) -> Column:
    """Why a triage request is refused, or null: its status or the length of its notes."""
    return F.when(~F.coalesce(status.isin("true_positive", "false_positive", "accepted_risk"), F.lit(False)), "status").when(F.char_length(notes) > 2000, "notes")


def framework_number(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Number of the first framework whose pattern occurs, or null."""
    out = F.lit(None).cast("int")
    for i, (_, p) in reversed(list(enumerate(FRAMEWORKS if patterns is None else patterns))):
        out = F.when(text.rlike(p), i).otherwise(out)
    return out


def truncate(text: Column, length: int = 300) -> Column:
    """Cut to ``length``, back to the last space if there is one, and mark it."""
    cut = F.left(text, F.lit(length))
    back = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r"(?s)^(.*) [^ ]*$", "$1")).otherwise(cut)
    return F.coalesce(F.when(F.char_length(text) <= length, text).otherwise(F.concat(back, F.lit("…"))), F.lit(""))


def duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))


def scan_date(completed: Column, created: Column) -> Column:
    """When a scan ended, or began; empty for neither."""
    return F.coalesce(F.date_format(F.coalesce(completed, created), "yyyy-MM-dd HH:mm 'UTC'"), F.lit(""))


def endpoint(vector: Column, sink_file: Column) -> Column:
    """The first path in the attack's description, else one made of the file's name."""
    path = r"(?i)(/[a-z/_\-{}]+)"
    name = F.replace(F.replace(F.substring_index(sink_file, "/", -1), F.lit(".py"), F.lit("")), F.lit("_"), F.lit("-"))
    return F.when(vector.rlike(path), F.regexp_extract(vector, path, 1)).otherwise(F.concat(F.lit("/"), name))


# Names of parameters where the code has none.
PARAMETERS = {"sqli": "id", "xss": "q", "cmdi": "cmd", "path_traversal": "file", "ssrf": "url", "ssti": "name", "deserialize": "data"}


def parameter(code: Column, vuln_class: Column) -> Column:
    """The parameter that the code reads: ``.get("x")``, then ``["x"]``, then a usual one for the class."""
    call, item = r"""\.get\(["'](\w+)["']""", r"""\[["'](\w+)["']\]"""
    usual = F.lit("input")
    for name, value in PARAMETERS.items():
        usual = F.when(vuln_class == name, value).otherwise(usual)
    return F.when(code.rlike(call), F.regexp_extract(code, call, 1)).when(code.rlike(item), F.regexp_extract(code, item, 1)).otherwise(usual)


def relative_time(minutes: Column) -> Column:
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def fenced_json(text: Column) -> Column:
    """The JSON of an answer, with or without a code fence."""
    t = strip(text)
    marked = F.when(F.contains(t, F.lit("```json")), F.get(F.split(F.get(F.split(t, "```json"), F.lit(1)), "```"), F.lit(0))).when(F.contains(t, F.lit("```")), F.get(F.split(t, "```"), F.lit(1)))
    return strip(F.coalesce(marked, t))


def recovered_script(text: Column) -> Column:
    """Text of a triple-quoted script inside a broken JSON answer, or null."""
    p = r'(?s)"script"\s*:\s*"""(.*?)"""'
    return F.when(text.rlike(p), F.regexp_extract(text, p, 1))


def owner_and_name(url: Column) -> Column:
    """struct<owner, name> of a repository URL, null where it has none."""
    p = r"^https?://[^/]+/([^/]+)/([^/]+?)(?:\.git)?/?$"
    return F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).alias("owner"), F.regexp_extract(url, p, 2).alias("name")))


def rate_key(identity: Column, day: Column) -> Column:
    return F.concat_ws(":", F.lit("rate"), identity, day.cast("string"))


@F.pandas_udf(StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Unified diff of (original, patched, path)."""
    import difflib

    for a, b, path in batches:
        yield pd.Series(["".join(difflib.unified_diff((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True), fromfile=f"a/{p}", tofile=f"b/{p}")) for x, y, p in zip(a, b, path, strict=True)])
