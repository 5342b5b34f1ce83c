"""Mixing sources to target weights, with DataFrame functions only.

Every source has a weight.  The sources share what all sizes come to by weight,
but none more than ``max_epochs`` times its own size; what it can't take is
shared by the others, by weight, until all fit.  Documents of a source follow
in the order of a hash of their keys, and a source's budget (its target,
rounded) is cut exactly: whole epochs take every document once more, the last
one takes documents from the front until the budget is spent, the last of them
in part.  The hash depends on the seed and the document alone, so reruns agree.

Prefix sums by source are distributed: rows are range-sorted by source and
hash, sums are taken inside each range, and the ranges' totals (two rows a
range at most) carry them on.  A source of any size lies in many ranges, as do
rows that are equal in everything, which a number of the scan tells apart.
The sources' own table goes the same way, however many there are.

Defined results: a null text has size 0; a null source is a source, the last; a
null key hashes like the empty text; documents of size 0 take nothing; rows
that are equal in key, text and source are alike, and which of them the cut
meets is open; columns called like the results are replaced; sources without a
word have the target 0; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stash

WEIGHTS = (5, 2, 1)
BLANKS = r"\x20\x09-\x0D"
MADE = ["size", "source_size", "target", "taken", "epochs"]


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: each with the blanks about it becomes one character."""
    marked = F.regexp_replace(text, f"[{BLANKS}]*[^{BLANKS}]+[{BLANKS}]*", "x")
    return F.when(F.regexp_like(text, F.lit(f"[^{BLANKS}]")), F.char_length(marked)).otherwise(0).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums (of the rows before and each row itself) in the order of the keys, null last, and ``order``.

    ``sums``: new column to the integer column that it sums.
    """
    by = [F.col(k).asc_nulls_last() for k in keys]
    rows = stash(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "mixing")
    inside = Window.partitionBy(*keys, "_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(sums.values())])
    offsets = ranges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), *[F.sum(f"_t{i}").over(earlier).alias(f"_o{i}") for i in range(len(sums))]).where("_o0 IS NOT NULL")
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumns({c: F.sum(v).over(inside) for c, v in sums.items()})
    # only keys that several ranges hold are here: two rows a range at most
    out = out.join(F.broadcast(offsets), same, "left").withColumns({c: F.col(c) + F.coalesce(f"_o{i}", F.lit(0)) for i, c in enumerate(sums)})
    return out.drop("_part", "_nth", "_at", *[f"_k{i}" for i in range(len(keys))], *[f"_o{i}" for i in range(len(sums))])


def with_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    In ascending order of size over weight the sources that stop at
    ``max_epochs`` times their size come first.  What they leave, over the weight
    of the rest, is the level of the rest; the first source whose own limit
    reaches the level of all from it on sets it.
    """
    limit = F.col("source_size") * max_epochs
    rows = sources.withColumn("_limit", limit)
    order = [(F.col("_limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    listed = stash(running(rows, [], order, {"_taken": "_limit", "_weights": "weight"}), "targets")
    total, weights = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, rest = F.lit(total).cast("bigint") - F.col("_taken") + F.col("_limit"), F.lit(weights).cast("bigint") - F.col("_weights") + F.col("weight")
    fits = left.cast("double") / rest <= F.col("_limit") / F.col("weight")
    # the level as a fraction of whole numbers, so that targets are rounded once
    level = listed.where(fits).select(F.struct("_weights", left.alias("left"), rest.alias("rest")).alias("l")).agg(F.min("l").alias("l")).first()
    target = F.col("_limit").cast("double")
    if level and level["l"]:
        share = (F.col("weight") * F.lit(level["l"]["left"]).cast("bigint")).cast("double") / F.lit(level["l"]["rest"])
        target = F.least(target, share)
    return listed.select("source", "source_size", target.alias("target"))


def source_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (one row each) with ``weight``: by code point, null last, the weights in turn."""
    placed = running(sources.withColumn("_one", F.lit(1).cast("bigint")), [], [F.col("source").asc_nulls_last()], {"_n": "_one"})
    return placed.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights)).cast("int")).cast("bigint")).drop("_one", "_n")


def mix(docs: DataFrame, keys: list[str], size: Column, source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The ``keys`` of every row with ``source``, ``size``, ``source_size``, ``target``,
    ``epochs`` (whole ones that its source takes) and ``taken`` (what the mix takes
    of it, repeats counted).

    ``keys`` and the ``size`` expression are read in one pass over ``docs``; the
    rest works on a table without texts.
    """
    keep = [k for k in keys if k.lower() not in [*MADE, "source"]]
    named = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keep]
    small = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{source}`").alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    hashed = F.md5(F.concat_ws("|", F.lit(seed), *named))
    rows = stash(small.withColumns({"_key": hashed, "_row": F.monotonically_increasing_id()}), "sizes")
    sources = stash(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = stash(with_targets(source_weights(sources, weights), max_epochs), "source-targets")
    placed = running(rows, ["source"], [F.col("_key"), F.col("size"), F.col("_row")], {"_sum": "size"})
    # a row a source; the rows of each go by its size: many sources are joined by shuffle, few by broadcast
    s = targets.withColumnsRenamed({"source": "_source"})
    out = placed.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    out = out.withColumn("epochs", epochs)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - (F.col("_sum") - F.col("size"))))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("_key", "_row", "_sum")


def mixed_texts(docs: DataFrame, mixed: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each time the mix takes a document: ``docs``, ``epoch`` (from 0) and ``text``, cut to the words it takes.

    ``key`` names rows of both tables, each once.
    """
    taken = mixed.where("taken > 0").select(F.col(key).alias("_k"), "size", "taken")
    rows = docs.join(taken, F.col(key) == F.col("_k")).drop("_k")
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANKS}]*[^{BLANKS}]+"), F.lit(0)), 1, words.cast("int")), "")
    return out.withColumn(text, F.when(words < F.col("size"), cut).otherwise(F.col(text))).drop("size", "taken")


OP13_SQL = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, 3 * source_size AS lim FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM w),
l AS (SELECT lft, rst FROM o WHERE lft::DOUBLE / rst <= lim / weight ORDER BY lim / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(lim::DOUBLE, (weight * l.lft)::DOUBLE / l.rst) AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e"""


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 5, 2, 1 of their sources in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, ["doc_id"], word_count(F.col("text")))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", "taken")
