"""A Merkle manifest: every row's digest, its group's and the whole table's root, and proofs.

Leaves of a group lie in ascending order.  While a group has several nodes,
every two consecutive ones become the digest of both (a last one alone becomes
the digest of itself); what remains is the group's root.  The groups' roots, in
the groups' order, make the root of all in the same way.

Leaves are numbered by a range sort and the totals of its ranges, so that a
group of any size lies in many ranges, and cut into aligned blocks of
``2**height`` leaves.  A block is one task's group, and what it holds in memory
is bounded by its size.  Its root comes from one pass of tree hashing with a
stack.  Roots of blocks are the leaves of the next level, in blocks again,
until one is left; a table of n leaves takes log(n) / height levels.

Proofs come from Merkle tree traversal: in each block the authentication path
of its first leaf is known, and each next leaf's is made from it.  For every
height one tree-hashing stack prepares the sibling that is needed next; each
leaf advances the stacks by a bounded number of steps, lowest first, so about
three nodes a height are held, not the block's tree.  The path of the block's
root in the levels above, shared by all its leaves, is appended.

A proof's step holds what lies left and right of the node in its run (one of
them, or nothing), so folding a leaf is ``sha2(left || node || right)`` step by
step, which Spark's own functions do (:func:`folded`).

Defined results: nulls in a leaf's columns count as ``-``; a null group comes
first; a null in the order comes first; rows of equal order follow by their
leaf, and equal leaves are alike; texts of any length count whole; other
columns are ignored; an empty table has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stash

HEIGHT = 11
STEP = "struct<left:string,right:string>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns, each ``-`` or its bytes' count, a colon and the bytes."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# --- inside a block ----------------------------------------------------------------------


def join(left: str | None, right: str | None) -> str | None:
    """The parent of two nodes, of which the right one, or both, may be missing."""
    if left is None:
        return None
    return sha256((left + (right or "")).encode()).hexdigest()


class Treehash:
    """One node at ``height`` over the leaves from ``at`` on, made step by step."""

    def __init__(self, height: int, at: int, node: str | None = None, done: bool = False):
        self.height, self.at, self.node, self.done = height, at, node, done
        self.stack: list[tuple[int, str | None]] = []

    def low(self) -> int:
        """The height that the next step works at: the lowest node on the stack."""
        return min((h for h, _ in self.stack), default=self.height)

    def step(self, leaves: list[str]) -> None:
        """Take a leaf, or join the two topmost nodes of equal height."""
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            height, right = self.stack.pop()
            _, left = self.stack.pop()
            self.stack.append((height + 1, join(left, right)))
        else:
            self.stack.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1
        if self.stack[-1][0] == self.height:
            self.node, self.done = self.stack.pop()[1], True


def root_of(leaves: list[str], height: int) -> tuple[str, list[str | None], list[str | None]]:
    """The block's root and, for every height below it, its first and second node, in one pass with one stack."""
    first: list[str | None] = [None] * (height + 1)
    second: list[str | None] = [None] * (height + 1)
    stack: list[tuple[int, str]] = []

    def note(h: int, node: str) -> None:
        if first[h] is None:
            first[h] = node
        elif second[h] is None:
            second[h] = node

    for leaf in leaves:
        h, node = 0, leaf
        note(h, node)
        while stack and stack[-1][0] == h:
            node = join(stack.pop()[1], node)
            h += 1
            note(h, node)
        stack.append((h, node))
    h, node = stack.pop()
    while h < height:  # what is left over rises alone until it meets its sibling
        if stack and stack[-1][0] == h:
            node = join(stack.pop()[1], node)
        else:
            node = join(node, None)
        h += 1
        note(h, node)
    return node, first, second


def traverse(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """The authentication path of every leaf in turn: the sibling at each height, None where there is none."""
    _, first, second = root_of(leaves, height)
    path = second[:height]
    stacks = [Treehash(h, 0, first[h], True) for h in range(height)]
    for s in range(len(leaves)):
        yield list(path)
        for h in range(height):
            if (s + 1) % (1 << h):
                break
            path[h] = stacks[h].node
            at = (s + 1 + (1 << h)) ^ (1 << h)
            stacks[h] = Treehash(h, at, done=at >= len(leaves))  # behind the last leaf there is nothing to make
        for _ in range(2 * height - 1):
            focus = min((t for t in stacks if not t.done), key=lambda t: (t.low(), t.height), default=None)
            if focus is None:
                break
            focus.step(leaves)


def depth(n: int) -> int:
    """Levels until one of n nodes is left."""
    return (n - 1).bit_length()


def steps(path: list[str | None], at: int) -> list[dict]:
    """A path as what lies left and right of the node at each height."""
    return [{"left": x or "", "right": ""} if at >> h & 1 else {"left": "", "right": x or ""} for h, x in enumerate(path)]


# --- levels of blocks --------------------------------------------------------------------


def numbered_leaves(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_i`` (place in the group, from 0) and ``_n`` (the group's leaves)."""
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    # a number of the scan lets rows that are equal in everything lie in several ranges
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = stash(spread.repartitionByRange(*by, "_row").sortWithinPartitions(*by, "_row").drop("_row").withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "leaves")
    ranges = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_nth").alias("_from"))
    mine = Window.partitionBy(group)  # a row a range
    offsets = ranges.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_c").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_c").over(mine).alias("_n"))
    # rows of a range stand in a row, so their number less the range's first one is their place in it; by size a broadcast
    return placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("_i", F.col("_nth") + F.col("_shift")).drop("_g", "_p", "_part", "_nth", "_shift")


def _block_height(n: int, height: int) -> int:
    """A group of one block stops at one node; blocks of larger groups rise to their full height."""
    return height if n > 1 << height else depth(n)


def block_roots(leaves: DataFrame, group: str, height: int) -> DataFrame:
    """(group, _i, _n, leaf) of leaves to (group, _i, leaf) of their blocks' roots."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("_i")
        values, n = block.column("leaf").to_pylist(), block.column("_n")[0].as_py()
        root = root_of(values, _block_height(n, height))[0]
        return pa.table({"g": block.column(group)[:1], "_i": pa.array([key[1].as_py()], pa.int64()), "leaf": pa.array([root], pa.string())})

    kind = leaves.schema[group].dataType.simpleString()
    out = leaves.select(group, "_i", "_n", "leaf").groupBy(F.col(group), F.shiftright("_i", height).alias("_b")).applyInArrow(run, f"g {kind}, _i bigint, leaf string")
    return out.withColumnRenamed("g", group)


def paths(leaves: DataFrame, group: str, height: int) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (group, _i, _n, leaf and others) with ``proof`` up to their group's root, and the roots (group, leaf).

    The levels of blocks above are made first; each is smaller by ``2**height``.
    """
    top = leaves.agg(F.max("_n")).first()[0] or 0
    levels, at = [leaves], top
    while at > 1:  # log(n) / height times
        above = block_roots(levels[-1], group, height).withColumn("_n", F.lit(None).cast("bigint"))
        sizes = levels[-1].select(F.col(group).alias("_g"), F.shiftright(F.col("_n") + ((1 << height) - 1), height).alias("_m")).distinct()  # a row a group
        above = stash(above.drop("_n").join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select(group, "_i", F.col("_m").alias("_n"), "leaf"), "roots")
        levels.append(above)
        at = -(-at // (1 << height))
    shared = None
    for level in reversed(levels[:-1]):
        upper = levels[levels.index(level) + 1].select(group, F.col("_i").alias("_b"), F.array().cast(f"array<{STEP}>").alias("proof")) if shared is None else shared.select(group, F.col("_i").alias("_b"), "proof")
        made = _block_paths(level, upper, group, height)
        shared = stash(made, "paths") if level is not leaves else made
    if shared is None:
        shared = leaves.withColumn("proof", F.array().cast(f"array<{STEP}>"))
    return shared, levels[-1].where("_i = 0").select(group, "leaf")


def _block_paths(level: DataFrame, upper: DataFrame, group: str, height: int) -> DataFrame:
    """Rows of ``level`` with the path inside their block and, behind it, their block's own (``upper``: one row a block)."""
    names = level.columns

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("_i")
        values, n = block.column("leaf").to_pylist(), block.column("_n")[0].as_py()
        shared = above.column("proof")[0].as_py()
        found = [[*steps(path, i), *shared] for i, path in enumerate(traverse(values, _block_height(n, height)))]
        return block.select(names).append_column("proof", pa.array(found, _STEPS))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema], f"proof array<{STEP}>"])
    left = level.withColumn("_b", F.shiftright("_i", height)).groupBy(group, "_b")
    return left.cogroup(upper.groupBy(group, "_b")).applyInArrow(run, schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all digests of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: list[str], columns: list[str], changed: Callable[[str], Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Group, order, ``leaf``, ``subroot``, ``root`` and ``proof`` (steps up to the root) of every row.

    ``columns`` make the leaf.  ``changed`` (column name to the column's changed
    value) adds ``changed_leaf``, the leaf of the changed row.
    """
    leaves = rows.select(group, *order, digest([F.col(c) for c in columns]).alias("leaf"), *([digest([changed(c) for c in columns]).alias("changed_leaf")] if changed else []))
    placed = stash(numbered_leaves(leaves, group, [*order, "leaf"]), "numbered")
    proven, roots = paths(placed, group, height)
    # the groups' roots are the leaves of one more tree, of one group
    tops = stash(numbered_leaves(roots.withColumnsRenamed({group: "_lang"}).withColumn("_all", F.lit(0)), "_all", ["_lang"]), "tops")
    above, root = paths(tops, "_all", height)
    lifted = stash(above.select(F.col("_lang").alias("_g"), F.col("leaf").alias("subroot"), F.col("proof").alias("_upper")), "lifted")  # a row a group
    whole = root.first()  # one row
    out = proven.join(lifted, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("proof", F.concat("proof", "_upper")).select(group, *order, "leaf", *(["changed_leaf"] if changed else []), "subroot", F.lit(whole and whole["leaf"]).alias("root"), "proof")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, with some rows tampered with before they are verified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tampered = lambda c: F.when(hit, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c)
    out = manifest(docs, "lang", ["doc_id"], ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    out = out.withColumn("folded_root", folded(F.col("changed_leaf"), F.col("proof")))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang")) + " || {} || " + _FIELD.format("text") + ")"
OP12_SQL = f"""WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format(_FIELD.format("n_chars"))} AS leaf, {_LEAF.format(_FIELD.format("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)"))} AS changed FROM
 (SELECT *, doc_id IS NOT NULL AND (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 7 = 0) AS hit FROM documents, c)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM l UNION ALL SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
s AS MATERIALIZED (SELECT lang, h AS subroot, lvl AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, subroot AS h FROM s UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
r AS (SELECT h AS root, lvl AS top FROM u WHERE n = 1),
k AS MATERIALIZED (SELECT row_number() OVER () AS k, l.*, s.subroot, s.i AS si, s.top, r.root, r.top AS rtop FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, r),
p AS MATERIALIZED (SELECT k.k, x.lvl AS lvl, (k.i >> x.lvl) & 1 = 1 AS is_left, t.h FROM k, LATERAL (SELECT unnest(range(k.top)) AS lvl) x LEFT JOIN t ON t.lang IS NOT DISTINCT FROM k.lang AND t.lvl = x.lvl AND t.i = xor(k.i >> x.lvl, 1)
 UNION ALL SELECT k.k, k.top + x.lvl, (k.si >> x.lvl) & 1 = 1, u.h FROM k, LATERAL (SELECT unnest(range(k.rtop)) AS lvl) x LEFT JOIN u ON u.lvl = x.lvl AND u.i = xor(k.si >> x.lvl, 1)),
q AS (SELECT k, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM p GROUP BY k),
f AS (SELECT k, 0 AS lvl, changed AS h, top + rtop AS stop FROM k UNION ALL SELECT f.k, f.lvl + 1, sha256(CASE WHEN p.is_left THEN coalesce(p.h, '') || f.h ELSE f.h || coalesce(p.h, '') END), f.stop FROM f JOIN p ON p.k = f.k AND p.lvl = f.lvl)
SELECT k.doc_id, k.leaf, k.subroot, k.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = k.root AS verified FROM k JOIN f ON f.k = k.k AND f.lvl = f.stop LEFT JOIN q ON q.k = k.k"""
