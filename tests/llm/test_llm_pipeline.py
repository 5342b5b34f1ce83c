"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(120) for _ in range(60)]
    for i in range(0, 30, 2):
        texts[i] += " idiot moron scum idiot"
    passage, item = prose(70), prose(40)
    texts[41], texts[43] = texts[41] + " " + passage, texts[43] + " " + passage
    texts[45] = texts[47]
    texts[49] = texts[49] + " " + item + " " + prose(5)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, int(i < 30 and i % 2 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    for name, df in {"documents": docs, "labels": labels, "benchmark": bench}.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    current, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / f"out_{name}")
        stage(spark, current, str(tmp_path)).write.parquet(out)
        current = spark.read.parquet(out)
        kept[name] = {r.doc_id: r.asDict() for r in current.collect()}
    ids = [set(k) for k in kept.values()]
    clean = set(range(31, 60))
    assert clean <= ids[0] and ids[1] == ids[0] - {47} and ids[2] == ids[1] and ids[3] == ids[2] - {49} and ids[4] == ids[3]
    third = kept["suffix_array_dedup"]
    assert passage in third[41]["text"] and passage not in third[43]["text"] and third[43]["n_chars"] == len(third[43]["text"])
    assert all(r["round_trip"] for r in kept["sentencepiece"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def near_copies_kept(spark, path, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(path)
    return [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), "").collect()]


def test_blank_texts_are_copies(spark, tmp_path):
    got = near_copies_kept(spark, str(tmp_path / "docs"), [(4, ""), (2, None), (9, "one text of words"), (7, " \n "), (3, None), (5, "another one, not at all alike")])
    assert sorted(got) == [(2, None), (5, "another one, not at all alike"), (9, "one text of words")]


def test_copies_go_by_row(spark, tmp_path):
    one, two, three = "one text of words", "another one, not at all alike", "a third text that has its own words"
    rows = [(None, one), (5, one), (None, one), (8, two), (8, two), (3, two[::-1]), (None, three), (None, three), (6, "the clean text of a shared number"), (6, one)]
    got = near_copies_kept(spark, str(tmp_path / "docs"), rows)
    clean = {(5, one), (8, two), (3, two[::-1]), (None, three), (6, "the clean text of a shared number")}
    assert set(got) == clean and len(got) == len(clean)
