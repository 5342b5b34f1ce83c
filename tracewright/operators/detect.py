"""Detectors over lines: window frames, interval joins and segments.

``lines`` has (scope, file, line_no, text), line_no from 1.  Every detector is
built of an operator on flags, which works on any ordered table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import line_array, strip

KEYS = ["scope", "file"]

# Patterns and markers of the detectors.
CHECKS = [r"os\.path\.exists\s*\(", r"os\.path\.isfile\s*\(", r"os\.path\.isdir\s*\(", r"if\s+.*\bbalance\b.*>=", r"if\s+.*\bcount\b.*>=", r"if\s+.*\.exists\(\)"]
ACTS = [r"os\.remove\s*\(", r"os\.unlink\s*\(", r"open\s*\(", r"os\.rename\s*\(", r"shutil\.(move|copy|rmtree)\s*\(", r"\.balance\s*-=", r"\.count\s*-="]
WRITES = [r"""(?i)execute\s*\(["']INSERT\s+INTO\s+(\w+)""", r"""(?i)execute\s*\(["']UPDATE\s+(\w+)""", r"(?i)\.create\s*\(", r"(?i)\.add\s*\(", r"(?i)session\.add\s*\("]
HTTP_SOURCES = ["request.args.get", "request.form.get", "request.json", "request.data", "req.query", "req.body", "req.params"]
READS = [r"\.fetchone\(\)", r"\.fetchall\(\)", r"\.fetchmany\(", r"\.first\(\)", r"\.all\(\)", r"objects\.(get|filter|all)\(", r"""execute\s*\(["']SELECT"""]
STORED_SINKS = [
    ("render_template_string(", "ssti", "CWE-1336"), ('f"<', "xss", "CWE-79"), ("f'<", "xss", "CWE-79"), (' + "<', "xss", "CWE-79"), ('execute(f"', "sqli", "CWE-89"),
    ("execute(f'", "sqli", "CWE-89"), ('execute("SELECT', "sqli", "CWE-89"), ("execute('SELECT", "sqli", "CWE-89"), ("subprocess.run(", "cmdi", "CWE-78"), ("os.system(", "cmdi", "CWE-78"),
]
AUTH_MARKERS = [
    "login_required", "require_login", "requires_login", "jwt_required", "token_required", "auth_required", "requires_auth", "require_auth", "authenticated",
    "admin_required", "requires_admin", "require_admin", "roles_required", "role_required", "require_role", "requires_role", "permission_required",
    "permissions_required", "require_permission", "requires_permission", "require_scope", "requires_scope", "require_api_key", "api_key_required", "protected",
    "current_user", "get_current_user", "current_identity", "verify_jwt_in_request", "verify_jwt", "verify_token", "check_auth", "check_permission", "authorize(",
    "authenticate(", "session[", "session.get(", "g.user", "request.user", "request.state.user",
]
AUTH_DEPENDENCY = r"""(?i)(?:Depends|Security)\s*\(\s*['"]?[\w.]*?(current[_-]?user|authenticate|authoriz|\bauth|verify|require|login|jwt|token|api[_-]?key|permission|\brole|scope|oauth|bearer|principal|guard)"""
ROUTE = r"(?i)@\w+\.(?:route|get|post|put|patch|delete|head|options)\s*\("
SENSITIVE = [r"\w+\.execute\s*\(", r"(?s:SELECT\b.*\bFROM\b)", r"SELECT\s+\*", r"\bFROM\s+(?:users|admin|accounts|credentials)\b", r"(?:password|secret|api[_-]?key|private_key)\s*[=\[(.:]"]
FILE_GUARD = r"(?is)(?:FastAPI|APIRouter)\s*\([^)]*dependencies\s*=\s*\[[^\]]*(?:Depends|Security)\s*\([^)]*(?:auth|current[_-]?user|verify|require|login|jwt|token|permission|role|scope|security|oauth)"
REQUEST_HOOK = r"(?i)before_request"
REQUEST_HOOK_AUTH = r"(?i)abort\s*\(\s*40[13]\b|unauthorized|current_user|g\.user|verify_(?:jwt|token)|authenticate|login|session"
TIMING = r"(?i)(token|key|secret|password)\s*==\s*"
SAFE_COMPARE = [r"hmac\.compare_digest", r"secrets\.compare_digest"]
CLIENT_ROLE = r"(?i)(request\.(headers|cookies|args|form).*(?:role|admin|is_admin|permission))"


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs, whatever the case."""
    return text.rlike("(?i)" + "|".join(patterns))


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line; every line end counts, a trailing one adds no line."""
    rows = files.select("scope", F.col("path").alias("file"), F.col("ord").alias("file_ord"), F.posexplode(line_array(F.col("source"))).alias("i", "text"))
    return rows.select("scope", "file", "file_ord", (F.col("i") + 1).alias("line_no"), "text")


def check_then_act(rows: DataFrame, keys: list[str], order: str, check: Column, act: Column, window: int = 5, payload: list[str] | None = None) -> DataFrame:
    """Checks with the first act among the next ``window`` rows."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, window)
    value = F.struct(F.col(order).alias("act_at"), *[F.col(c).alias(f"act_{c}") for c in payload or []])
    out = rows.withColumn("_act", F.min(F.when(act, value)).over(ahead)).where(check & F.col("_act").isNotNull())
    return out.select(*keys, F.col(order).alias("check_at"), *[F.col(c).alias(f"check_{c}") for c in payload or []], "_act.*")


def preceded_by(rows: DataFrame, keys: list[str], order: str, flag: Column, before: int = 8) -> DataFrame:
    """``rows`` with ``preceded``: the flag holds in this row or the ``before`` rows ahead of it."""
    behind = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, 0)
    return rows.withColumn("preceded", F.max(F.coalesce(flag, F.lit(False))).over(behind))


def followed_within(left: DataFrame, right: DataFrame, keys: list[str], order: str, distance: int) -> DataFrame:
    """Interval join: right rows at 1..distance places after a left row.

    Both sides are dealt by (keys, place // distance); a left row goes to its
    own and the next bucket, so no file is paired with itself throughout.
    """
    bucket = F.floor(F.col(order) / distance)
    lefts = left.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).withColumnRenamed(order, "_left_at")
    rights = right.withColumn("_b", bucket).withColumnRenamed(order, "_right_at")
    return lefts.join(rights, [*keys, "_b"]).where((F.col("_right_at") > F.col("_left_at")) & (F.col("_right_at") <= F.col("_left_at") + distance)).drop("_b")


def unguarded_segments(rows: DataFrame, keys: list[str], order: str, start: Column, guard: Column, sensitive: Column, limit: int = 25) -> DataFrame:
    """Starts whose segment (to the next start, ``limit`` rows at most) has a
    sensitive row and no guard before the segment's end."""
    w = Window.partitionBy(*keys).orderBy(order)
    flags = rows.withColumns({"_start": start, "_guard": guard, "_sensitive": sensitive}).withColumn("_seg", F.sum(F.col("_start").cast("int")).over(w)).where("_seg > 0")
    ranked = flags.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(order))).where(F.col("_n") <= limit)
    seg = ranked.groupBy(*keys, "_seg").agg(F.min(order).alias(order), F.max("_guard").alias("_g"), F.max("_sensitive").alias("_s"))
    return seg.where("_s AND NOT _g").select(*keys, order)


def race_findings(lines: DataFrame) -> DataFrame:
    return check_then_act(lines, KEYS, "line_no", any_of(F.col("text"), CHECKS), any_of(F.col("text"), ACTS), 5, ["text"])


def write_kind(text: Column) -> Column:
    """Number of the first write pattern that matches, or null."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(WRITES))):
        out = F.when(text.rlike(p), i).otherwise(out)
    return out


def tainted_writes(lines: DataFrame) -> DataFrame:
    has_source = F.col("text").rlike("|".join(p.replace(".", r"\.") for p in HTTP_SOURCES))
    rows = preceded_by(lines, KEYS, "line_no", has_source).withColumn("_k", write_kind(F.col("text"))).where("preceded AND _k IS NOT NULL")
    table = F.when(F.col("_k") == 0, F.regexp_extract("text", WRITES[0], 1)).when(F.col("_k") == 1, F.regexp_extract("text", WRITES[1], 1))
    return rows.select("scope", "file", "file_ord", "line_no", strip(F.col("text")).alias("code"), table.alias("table_name"))


def stored_sink(text: Column) -> Column:
    out = F.lit(None).cast("struct<vuln_class:string,cwe_id:string>")
    for pattern, vuln, cwe in reversed(STORED_SINKS):
        out = F.when(F.contains(text, F.lit(pattern)), F.struct(F.lit(vuln).alias("vuln_class"), F.lit(cwe).alias("cwe_id"))).otherwise(out)
    return out


def first_write(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of each key in file and line order, as ``w``: one row a key."""
    return writes.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in writes.columns if c not in (*keys, *order)])).alias("w"))


def with_first_write(rows: DataFrame, writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row beside the first write of its key; rows of keys without one go.

    The side of one row a key is joined by key and left to the optimiser.
    """
    return rows.join(first_write(writes, keys, order), keys)


def second_order_findings(lines: DataFrame) -> DataFrame:
    """Reads with sinks in the next 20 lines, given a tainted write anywhere in the scope."""
    reads = lines.where(any_of(F.col("text"), READS)).select("scope", "file", "line_no", strip(F.col("text")).alias("read_code"))
    sinks = lines.withColumn("_s", stored_sink(F.col("text"))).where("_s IS NOT NULL").select("scope", "file", "line_no", strip(F.col("text")).alias("sink_code"), "_s.*")
    near = followed_within(reads, sinks, KEYS, "line_no", 20)
    out = with_first_write(near, tainted_writes(lines), ["scope"], ["file_ord", "line_no"])
    return out.select("scope", F.col("w.file").alias("write_file"), F.col("w.line_no").alias("write_line"), "file", F.col("_left_at").alias("read_line"), F.col("_right_at").alias("sink_line"), "read_code", "sink_code", "vuln_class", "cwe_id", F.col("w.table_name").alias("db_table"))


def has_auth(text: Column) -> Column:
    import re

    markers = "|".join(re.escape(m) for m in AUTH_MARKERS)
    return F.lower(text).rlike(markers) | text.rlike(AUTH_DEPENDENCY)


def unless_safe(rows: DataFrame, facts: DataFrame, keys: list[str], hit: Column, safe: str) -> DataFrame:
    """Rows that hit, but for those of a key that is safe as a whole."""
    return rows.where(hit).join(facts.where(F.col(safe)).select(*keys).distinct(), keys, "left_anti")


def file_guarded(source: Column) -> Column:
    """Whether a router's dependencies or a request hook guard the whole file."""
    return source.rlike(FILE_GUARD) | (source.rlike(REQUEST_HOOK) & source.rlike(REQUEST_HOOK_AUTH))


def timing_unsafe(text: Column) -> Column:
    return text.rlike(TIMING)


def client_role(text: Column) -> Column:
    return text.rlike(CLIENT_ROLE)


def auth_findings(lines: DataFrame, files: DataFrame) -> DataFrame:
    text = F.col("text")
    facts = files.select("scope", F.col("path").alias("file"), file_guarded(F.col("source")).alias("guarded"), any_of(F.col("source"), SAFE_COMPARE).alias("safe"))
    timing = unless_safe(lines, facts, KEYS, timing_unsafe(text), "safe").select("scope", "file", "line_no", F.lit("timing_attack").alias("vuln_type"))
    role = lines.where(client_role(text)).select("scope", "file", "line_no", F.lit("client_controlled_role").alias("vuln_type"))
    routes = unguarded_segments(unless_safe(lines, facts, KEYS, F.lit(True), "guarded"), KEYS, "line_no", text.rlike(ROUTE), has_auth(text), any_of(text, SENSITIVE))
    return timing.unionByName(role).unionByName(routes.select("scope", "file", "line_no", F.lit("missing_auth").alias("vuln_type")))
