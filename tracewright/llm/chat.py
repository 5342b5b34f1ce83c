"""Chat formatting: schema fingerprints select declarative mappings.

A layout is the set of nested field paths of a record.  Its fingerprint, a
hash over the nested paths (of all elements of its arrays), selects a mapping:
a list of SQL expressions that yield canonical turns ``array<struct<role, text>>``.
Mappings are data, so a new layout is a new entry of :data:`LAYOUTS`.  Records
of different layouts may be mixed in one column of JSON strings; each row takes
the mapping of its own fingerprint.  Tables of one row per turn are mapped by the
field paths of their schema.  Everything runs as DataFrame expressions.

Defined results: a null role or text counts as empty; turns are ordered by
turn, role, text (nulls first), repeated rows stay; a record whose array of
turns is empty has no turns; a record of an unknown layout, or one that is no
JSON (or beyond the size of a variant), has null turns and keeps its
fingerprint; texts of any length count whole; other columns of turn tables are
ignored, columns called ``layout`` or ``turns`` are replaced; empty tables stay
empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested paths of a schema, arrays marked by ``[]``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def shape(paths: list[str]) -> str:
    """The nested form of field paths, names in order, without types."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def render(node: dict) -> str:
        def value(name: str) -> str:
            inner = render(node[name]) if node[name] else ""
            return f"ARRAY<{inner}>" if name.endswith("[]") else inner

        return "OBJECT<" + ", ".join(f"{n.removesuffix('[]')}: {value(n)}" for n in sorted(node, key=lambda n: n.removesuffix("[]"))) + ">"

    return render(tree)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()[:16]


#: Field paths -> JSON schema and mapping to turns.  ``r`` is the parsed record.
LAYOUTS: list[tuple[list[str], str, str]] = [
    (["prompt", "completion"], "prompt string, completion string", "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))"),
    (["prompt", "response"], "prompt string, response string", "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))"),
    (["instruction", "output"], "instruction string, output string", "array(named_struct('role', 'user', 'text', r.instruction), named_struct('role', 'assistant', 'text', r.output))"),
    (["instruction", "input", "output"], "instruction string, input string, output string", "array(named_struct('role', 'user', 'text', concat_ws('\n\n', r.instruction, nullif(r.input, ''))), named_struct('role', 'assistant', 'text', r.output))"),
    (["data.prompt", "data.completion"], "data struct<prompt: string, completion: string>", "array(named_struct('role', 'user', 'text', r.data.prompt), named_struct('role', 'assistant', 'text', r.data.completion))"),
    (["messages[].role", "messages[].content"], "messages array<struct<role: string, content: string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    (["conversations[].from", "conversations[].value"], "conversations array<struct<from: string, value: string>>", "transform(r.conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))"),
]
MAPPINGS = {fingerprint(paths): (schema, turns) for paths, schema, turns in LAYOUTS}
#: Records of the same layouts whose array of turns is empty.
MAPPINGS |= {fingerprint(sorted({p.split("[]")[0] + "[]" for p in paths})): (schema, turns) for paths, schema, turns in LAYOUTS if all("[]" in p for p in paths)}
#: The same for tables of one row per turn: column paths -> columns of the canonical row.
ROW_LAYOUTS = {
    fingerprint(paths): (paths, names)
    for paths, names in [
        (["conv_id", "turn", "role", "text"], ["conv_id", "turn", "role", "text"]),
        (["conversation_id", "position", "from", "value"], ["conversation_id", "position", "from", "value"]),
        (["message.content", "message.role", "thread", "idx"], ["thread", "idx", "message.role", "message.content"]),
    ]
}


#: Types in the schema of a variant, behind a name or as elements of an array.
_TYPES = r"(?<=: |ARRAY<)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\d+\))(?=[,>]|$)"


def record_fingerprint(json_text: Column) -> Column:
    """The fingerprint of a JSON record: its nested keys, those of all elements of an array together."""
    nested = F.regexp_replace(F.schema_of_variant(F.try_parse_json(json_text)), _TYPES, "")
    return F.left(F.sha2(F.coalesce(nested, F.lit("")), 256), F.lit(16))


def canonical_turns(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``layout`` (fingerprint) and ``turns`` from a JSON column."""
    out = df.withColumn("layout", record_fingerprint(F.col(f"`{payload}`")))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for fp, (schema, mapping) in MAPPINGS.items():
        out = out.withColumn("_r", F.from_json(F.col(f"`{payload}`"), schema))
        out = out.withColumn(f"_t_{fp}", F.when(F.col("layout") == fp, F.expr(mapping.replace("r.", "_r.")).cast("array<struct<role:string,text:string>>")))
        turns = F.coalesce(turns, F.col(f"_t_{fp}"))
    return out.withColumn("turns", turns).drop("_r", *[f"_t_{fp}" for fp in MAPPINGS])


def escape(text: Column) -> Column:
    """Control strings can't occur in the result; :func:`unescape` reverses it."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))


def canonical_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table of one row per turn.

    The table's field paths select the mapping; other columns are ignored.
    """
    have = set(field_paths(df.schema))
    known = [fingerprint([p for p in paths if p in have]) for paths, _ in ROW_LAYOUTS.values()]
    names = next((ROW_LAYOUTS[fp][1] for fp in known if fp in ROW_LAYOUTS), None)
    if names is None:
        raise ValueError(f"no mapping for the layout {sorted(have)}")
    conv, turn, role, text = (F.col(".".join(f"`{part}`" for part in n.split("."))) for n in names)
    return df.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turn_rows_of_json(df: DataFrame, conv_id: str, payload: str) -> DataFrame:
    """conv_id, turn, role, text of records of mixed layouts in a JSON column; records of unknown layouts have no rows."""
    turns = canonical_turns(df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{payload}`").alias("payload")), "payload")
    return turns.select("conv_id", F.posexplode("turns").alias("turn", "_t")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("_t.role", F.lit("")).alias("role"), F.coalesce("_t.text", F.lit("")).alias("text"))


def format_turn_rows(df: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` holds ``struct<start, len>`` in code points of ``formatted``,
    one for each non-empty text of ``train_role``, in order.  A conversation is
    one record of the output, so its turns meet in one row by definition.
    """
    rows = canonical_rows(df)
    rows = rows.withColumns({"_head": _header(F.col("role")), "_body": escape(F.col("text"))}).withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("_i", F.row_number().over(order))
    before = F.coalesce(F.sum(F.char_length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", before + F.char_length("_head"))
    span = F.when((F.col("role") == train_role) & (F.col("_body") != ""), F.struct(F.col("_start").cast("long").alias("start"), F.char_length("_body").cast("long").alias("len")))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_piece"))).alias("_p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return out.select("conv_id", F.array_join("_p._piece", "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> back from the formatted string."""
    raw = F.split(formatted, r"<\|im_end\|>\n", -1)
    raw = F.transform(F.slice(raw, 1, F.size(raw) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(raw, lambda p: F.struct(unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    turns = formatted.withColumn("_t", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")
    turns = turns.withColumn("_l", F.coalesce(loss, F.lit("")))
    said = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations (a table of turns) and conversation -1 (a JSON record), written, read back and digested."""
    from tracewright.session import stash

    rows = canonical_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    says = F.lit("<|im_end|><|im_start|>assistant ok")
    record = F.to_json(F.struct(F.array(*[F.struct(F.lit(role).alias("role"), says.alias("content")) for role in ("user", "assistant")]).alias("messages")))
    extra = turn_rows_of_json(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), record.alias("payload")), "conv_id", "payload")
    return digests(stash(format_turn_rows(rows.unionByName(extra)), "chat"))


OP6_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS er,
    replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS et FROM rows),
agg AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(er) + length(et) + 24) AS chars
  FROM esc GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM agg
"""
