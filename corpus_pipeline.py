"""A training-data pipeline: five stages over the table ``documents``.

Every stage takes (spark, docs, sf_dir), where docs is a plain read of Parquet
files, and returns a DataFrame; its result is written as Parquet and read back
as the next stage's input.  All but the last return the columns of documents;
other columns of the input are ignored.

Defined results: null and empty texts are not toxic, are one group of near
copies, and pass the other stages unchanged (a null text has no tokens); doc_id
may be null or repeated, as every stage tells rows apart by itself; texts of any
length are processed whole; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, sentencepiece_codec, simhash, suffix_dedup, toxicity
from tracewright.llm.rows import numbered
from tracewright.session import drop_path, fresh_path, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels), COLUMNS)
    return scored.where("_score < 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of least doc_id of each group of linked fingerprints.

    Documents without a word have fingerprint zero and are a group like any other.
    Rows are told apart by the file that holds them and their place in it, not by
    doc_id: exactly one row of a group stays.  A null doc_id comes after all
    others; of equal ones the first row stays.
    """
    rows = numbered(docs.select(*COLUMNS))
    who = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "rid").alias("who")
    marked = stash(simhash.add_fingerprints(rows.select(who, "text"), ["who"]), "fingerprints")
    classes = simhash.grouped(marked, "who")
    gone = classes.where("who.rid <> component_id.rid").select("who.rid")
    return rows.join(gone, "rid", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 200-byte passages seen before; the first occurrence of each stays.

    Documents of which nothing is left go; those that were empty stay.
    """
    left = suffix_dedup.rewrite(docs.select(*COLUMNS), keep_first=True, scan=True).where("text <> '' OR n_removed = 0")
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(docs, benchmark, COLUMNS).where(F.size("leaks") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]
#: Hashed features, fingerprints and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read back.

    What a stage read goes when its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
