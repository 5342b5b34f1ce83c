"""Empty tables, repeated rows under one doc_id, and columns that clash, through every query."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontamination, queries, sentencepiece_codec

pytest.importorskip("public_tokenizers")
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, shard string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn int, role string, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """One doc_id names several rows, equal ones and others; some have none; columns are called like results."""
    folder = tmp_path_factory.mktemp("repeated")
    texts = ["the cat sat on the mat and looked at the dog " * 3, "der Hund lief über die Straße und sah die Katze " * 3, "the cat sat on the mat and looked at the dog " * 3, None, "", "x"]
    rows = [(i % 4 if i % 5 else None, texts[i % 6], ["en", "de"][i % 2], "s", len(texts[i % 6] or ""), "mine", "mine", "mine") for i in range(24)]
    spark.createDataFrame(rows, SCHEMAS["documents"]).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, "looked at the dog the cat sat on the mat"), (1, None)], SCHEMAS["benchmark"]).write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 0, 0), (2, 0, None)], SCHEMAS["labels"]).write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(5, 0, "user", "hi"), (5, 1, "assistant", None)], SCHEMAS["conversations"]).write.parquet(str(folder / "conversations.parquet"))
    return str(folder), rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-1] if name.startswith("op6") else rows == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith("op6")])
def test_repeated_rows(spark, repeated, name):
    """Every row has its result, and equal rows have equal ones where a row is judged by itself."""
    path, rows = repeated
    got = queries.QUERIES[name](spark, path)
    assert len(got.columns) == len(set(got.columns))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)


def test_empty_pipeline(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_clashing_columns(spark, repeated):
    """Kept columns called like a result are replaced by it; others pass."""
    path, rows = repeated
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("mine") for c in ("leaks", "n_words", "token_ids", "lang_pred")})
    benchmark = spark.read.parquet(f"{path}/benchmark.parquet")
    keep = ["doc_id", "source", "leaks", "n_words", "token_ids", "lang_pred", "score"]
    found = decontamination.find_leaks(docs, benchmark, keep)
    assert found.schema["leaks"].dataType.typeName() == "array" and found.count() == len(rows)
    coded = sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), keep)
    assert coded.schema["token_ids"].dataType.typeName() == "array" and coded.count() == len(rows)
