"""Alignment of tokenizers, the Merkle manifest and mixing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import alignment, merkle, mixing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"


def make_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  two  spaces ", "tab\tand\r\nline\n\nends\n", "marker ▁ here", "<|endoftext|> <s> </s> <0x41>", "日本語 🎉 é x", "a\x00b", "x" * 3000, texts[0], texts[0], "it's o'clock, don't; 12,345.67!"]
    langs = ["en", "de", None, "", "fr"]
    rows = [(i, t, langs[min(i % 7, 4)], None if i % 11 == 0 else f"s{i % 4}", len(t or "") if i % 9 else None, i) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no name", "en", "s1", 7, 0), (None, "no name", "en", "s1", 7, 0), (None, "other", "en", "s1", 5, 0), (900, "alone", "xx", "s9", 5, 0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = make_rows()
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], COLUMNS).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def as_rows(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", ["op12_merkle", "op13_mixing"])
def test_sql(spark, tables, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet'")
        got = queries.QUERIES[name](spark, tables[0])
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert as_rows(got, got.columns) == Counter(want)


@pytest.mark.parametrize("name", ["op11_cross_tokenizer", "op12_merkle", "op13_mixing"])
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


# --- alignment -----------------------------------------------------------------------------


def brute_groups(text):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    of = alignment.byte_alphabet()
    vocab = {i: p for p, i in a.get_vocab().items()}
    data = (" " + (text or "")).encode()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
    parts = [[bytes(of[c] for c in vocab[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]]
    if not text or any(b"".join(p) != data for p in parts):
        return []
    groups, at, spent = [], [0, 0], [0, 0]
    while at[0] < len(ids[0]):
        group = ([], [])
        while True:
            side = 0 if spent[0] <= spent[1] else 1
            group[side].append(ids[side][at[side]])
            spent[side] += len(parts[side][at[side]])
            at[side] += 1
            if spent[0] == spent[1]:
                break
        groups.append(group)
    return groups


def brute_alignment(rows):
    held = [brute_groups(t) for _, t, *_ in rows]
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in held]
    docs = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    for row, groups, found in zip(rows, held, links, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield (row[0], sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found), sum(docs[p] == most[p[0]] for p in found), sum(docs[p] for p in found), digest)


def test_alignment(spark, tables):
    got = queries.QUERIES["op11_cross_tokenizer"](spark, tables[0])
    assert as_rows(got, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]) == Counter(brute_alignment(tables[1]))


def test_spaces_at_the_end(spark, tmp_path):
    """A text's last space is a token of both; it is no chunk of its own."""
    texts = ["a b ", "a ", "one two  ", "x\n ", "é ", " ", "a b", "b\u00a0", " a "]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op11_cross_tokenizer"](spark, folder)
    want = list(brute_alignment(list(enumerate(texts))))
    assert all(r[1] for r in want)
    assert as_rows(got, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]) == Counter(want)


def test_whole_texts_as_chunks():
    """As with tokenizers that have no borders."""
    cut = alignment.Tokenizers(*[str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")])
    cut.chunked = False
    sequences, _ = cut([t for _, t, *_ in make_rows()])
    assert [len(s) for s in sequences] == [int(bool(brute_groups(t))) for _, t, *_ in make_rows()]


def test_groups_in_order_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").withColumn("n_a", F.lit("mine"))
    paths = [str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rows = alignment.align(alignment.tokenise(docs, *paths, ["doc_id", "text", "n_a", "size"])).collect()
    assert len(rows) == len(tables[1])
    for r in rows:
        assert [(g.a, g.b) for g in r.groups] == [tuple(g) for g in brute_groups(r.text)]
        assert r.n_a == sum(len(g.a) for g in r.groups)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MAX_CHUNKS", 50)
    paths = [str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    small = alignment.Tokenizers(*paths)
    texts = [t for _, t, *_ in make_rows()]
    for i in range(0, len(texts), 5):
        sequences, (a, ends, *_) = small(texts[i : i + 5])
        assert len(small.known) <= 50 or set(small.known) == set().union(*[alignment.chunks_of(t) for t in texts[i : i + 5] if t])


# --- manifest ------------------------------------------------------------------------------


def brute_tree(leaves, height):
    levels = [list(leaves)]
    for _ in range(height):
        x = levels[-1]
        levels.append([merkle.join(x[i], x[i + 1] if i + 1 < len(x) else None) for i in range(0, len(x), 2)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 100])
def test_traversal(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    for height in (merkle.depth(n), 8):
        levels = brute_tree(leaves, height)
        assert merkle.root_of(leaves, height)[0] == levels[-1][0]
        want = [[levels[h][i >> h ^ 1] if i >> h ^ 1 < len(levels[h]) else None for h in range(height)] for i in range(n)]
        assert list(merkle.traverse(leaves, height)) == want


def test_memory_is_logarithmic():
    leaves, height, most = ["%064x" % i for i in range(1024)], 10, 0
    made = []

    class Counted(merkle.Treehash):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            made.append(self)

    whole, merkle.Treehash = merkle.Treehash, Counted
    try:
        for i, _ in enumerate(merkle.traverse(leaves, height)):
            live = {t.height: t for t in made}
            most = max(most, sum(len(t.stack) + (t.node is not None) for t in live.values()))
            made = list(live.values())
    finally:
        merkle.Treehash = whole
    assert most <= 3 * height


@pytest.mark.parametrize("height", [1, 2, 3])
def test_levels_of_blocks(spark, tables, height):
    """Small blocks, so that groups take several levels; equal to the tree in one block."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    made = [merkle.manifest(docs, "lang", ["doc_id"], ["doc_id", "text"], height=h) for h in (height, 11)]
    columns = ["lang", "doc_id", "leaf", "subroot", "root"]
    few, many = ([(*[r[c] for c in columns], tuple(r.proof)) for r in m.collect()] for m in made)
    assert Counter(few) == Counter(many)
    assert made[0].where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_tampered_rows_fail(spark, tables):
    rows = queries.QUERIES["op12_merkle"](spark, tables[0]).collect()
    known = {r[0]: r[4] for r in tables[1]}
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and known[r.doc_id] is not None
        assert r.verified == (not hit)


# --- mixing --------------------------------------------------------------------------------


def test_mix(spark, tables):
    rows = queries.QUERIES["op13_mixing"](spark, tables[0]).collect()
    source = {r[0]: r[3] for r in tables[1]}
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s = "s1" if r.doc_id is None else source[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == int(target[s] + 0.5) for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # the rule as it is told: what goes beyond a limit is shared anew until none does
    want, fixed, left = {}, set(), float(sum(size.values()))
    while True:
        free = [s for s in order if s not in fixed]
        want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        fixed |= set(over)
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)


def test_mixed_texts(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", " ".join(f"w{i}-{j}" for j in range(n)), "mine") for i, n in enumerate([5, 0, 8, 3, 13, 2, 40, 4])], "doc_id bigint, source string, text string, taken string")
    mixed = mixing.mix(docs, ["doc_id"], mixing.word_count(F.col("text"))).cache()
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words = defaultdict(int)
    for r in mixing.mixed_texts(docs.drop("taken"), mixed, "doc_id").collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text.split()[0] == f"w{r.doc_id}-0"
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_rows_alike_are_spread(spark):
    """Rows that are equal in everything still make the exact budget."""
    docs = spark.createDataFrame([(None, "a", "one two three")] * 50 + [(1, None, "x y")] * 30, "doc_id bigint, source string, text string")
    rows = mixing.mix(docs.repartition(4), ["doc_id"], mixing.word_count(F.col("text"))).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.taken
    assert got == {"a": 150, None: 60} and {r.target for r in rows} == {150.0, 60.0}


def test_word_count(spark):
    texts = ["", " ", "a", " a ", "a b", "\ta\x0b\x0cb\r\n", "a b", " ", "\x1cx y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len((t or "").encode().split()) for t in texts]
