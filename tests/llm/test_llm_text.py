"""Operators on texts against brute force and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import chat, decontamination, langid, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_output, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rid string"


def documents(spark, texts):
    rows = [(i if i != 3 else None, t, "en", "s", 1, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", "   \n", "one", "Same words here now", "Same words here now", "a" * 5000, "word " * 4000, "é ß 日本 🎉\n\n#tag", "x\x00y   z"]


# --- language identification ---------------------------------------------


def cross_phrases(sample: bytes, data: bytes) -> int:
    n = 0
    for at in range(0, len(data), langid.BLOCK):
        block, i = data[at : at + langid.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k < len(block) + 1 and k <= len(block) - i and block[i : i + k] in sample:
                k += 1
            i += max(1, k - 1)
            n += 1
    return n


def test_phrases_equal_brute_force():
    rnd = random.Random(1)
    samples = {k: langid.symbols(" ".join("".join(rnd.choices(a, k=5)) for _ in range(60))) for k, a in (("x", "abc"), ("y", "cde"))}
    texts = [langid.symbols("".join(rnd.choices("abcde zq", k=n))) for n in (0, 1, 7, 511, 512, 513, 1500)]
    got = langid.Parser(samples).phrases(texts)
    assert got.tolist() == [[cross_phrases(samples[k], t) for k in ("x", "y")] for t in texts]


def test_language_edges(spark):
    samples = {"en": langid.symbols("the same words are here and there now one"), "de": langid.symbols("der die das und nicht immer heute")}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents(spark, EDGE), samples, ["doc_id"]).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.identify(documents(spark, EDGE), {}, ["doc_id"]).collect()} == {"und"}
    assert langid.training_text(documents(spark, []).drop("rid")) == {}


def test_training_text_is_spread(spark):
    """Every part of long texts may be drawn, and the number of stretches is bounded."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03d}") + "x"
    text = " ".join(name(i) for i in range(1000))
    docs = spark.createDataFrame([(i, text + " " * (i % 2), "en") for i in range(40)] + [(41, None, "en"), (42, "", "de"), (None, "x y", None)], "doc_id bigint, text string, lang string")
    got = langid.training_text(docs, per_lang=60, stretch=100)
    words = [w for w in got["en"].decode().split() if len(w) == 4 and w[-1] == "x"]
    assert list(got) == ["en"] and 5000 < len(got["en"]) <= 60 * 101
    assert {w[0] for w in words} == set("abcdefghij")


def test_numerals_are_no_letters(spark):
    assert langid.symbols("½ ² ① Ⅷ ৪ _ 7 _") == b"" and langid.symbols("Ab½é日") == "ab é日".encode()


# --- SimHash ----------------------------------------------------------------


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in EDGE:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def classes(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = defaultdict(set)
    for i in range(len(fps)):
        groups[find(i)].add(fps[i])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("tile", [40, 16_384])
def test_links_equal_all_pairs(spark, tile):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:30]:
        for _ in range(4):
            for _ in range(rnd.randrange(1, 4)):
                b ^= 1 << rnd.randrange(64)
            fps.add(b)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), tile=tile)
    stars = simhash.components(edges).collect()
    found = defaultdict(set)
    for r in stars:
        found[r.root] |= {r.node & (2**64 - 1), r.root & (2**64 - 1)}
    assert {frozenset(g) for g in found.values()} == classes(sorted(fps))


def test_near_duplicates_of_edges(spark):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(documents(spark, EDGE)).collect()}
    assert {got[i, 0] for i in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_hot_centre(spark, monkeypatch):
    """Keys that hold many of the rows go another way with the same result."""
    from tracewright import session

    monkeypatch.setattr(session, "SHARES", 4)
    edges = [(i, 1) for i in range(2, 40)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 39)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys([*range(2, 40), 200], 1), **dict.fromkeys(range(101, 110), 100)}
    copies = spark.createDataFrame([(i, "the same words in all of these") for i in range(50)] + [(99, "and quite another text is here")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(copies).collect()} == {*((i, 0) for i in range(50)), (99, 99)}


# --- repeated passages --------------------------------------------------------


def slow_removal(texts, first=False):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - 199):
            seen[t[s : s + 200]].append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places[1:] if first else places:
                gone[i][s : s + 200] = True
    return gone


@pytest.mark.parametrize(("group", "first"), [(100_000, False), (2, False), (100_000, True), (2, True)])
def test_repeats_equal_brute_force(spark, group, first):
    rnd = random.Random(3)
    passage = "".join(rnd.choices("abcd é", k=260))
    texts = [None, "", "short", "q" * 450, passage, "x" + passage + "y", "".join(rnd.choices("abc ", k=300)), passage[5:230] + "tail" * 3, passage + passage, passage[:199]]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_spans bigint").coalesce(1)
    got = {r.doc_id: r for r in suffix_dedup.rewrite(docs, group=group, keep_first=first).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(data, slow_removal(data, first), strict=True)):
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())


def test_places_beyond_the_key(monkeypatch):
    """A text of more places than the key has room for: pieces and places are made small."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "_POSITION", np.uint64((1 << 11) - 1))
    rnd = random.Random(5)
    passage = bytes(rnd.choices(range(97, 105), k=260))
    noise = lambda n: bytes(rnd.choices(range(65, 91), k=n))
    texts = [b"short", noise(5000) + passage + noise(1200) + passage + noise(30), noise(700), noise(2900) + passage]
    row, h, lo, hi, a = suffix_dedup.anchors_of(texts)
    starts = sorted((int(r), s) for r, x, y in zip(row, lo, hi, strict=True) for s in range(x, y + 1))
    assert starts == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - suffix_dedup.LENGTH + 1)]
    for r, g, x, y, at in zip(row, h, lo, hi, a, strict=True):
        assert y <= at <= x + suffix_dedup.LENGTH - suffix_dedup.GRAM
        assert suffix_dedup.gram_hashes(np.frombuffer(texts[r][at : at + suffix_dedup.GRAM], np.uint8)).view(np.int64)[0] == g
    of = {(int(r), s): (g, at - s) for r, g, x, y, at in zip(row, h, lo, hi, a, strict=True) for s in range(x, y + 1)}
    assert all(of[1, 5000 + k] == of[1, 6460 + k] == of[3, 2900 + k] for k in range(61))


def test_rows_keep_their_ids_when_splits_change(spark, tmp_path, monkeypatch):
    """The number of splits of a scan changes between the jobs, as it does when executors come and go."""
    rnd = random.Random(8)
    passage = "".join(rnd.choices("abcdefgh ", k=400))
    texts = ["".join(rnd.choices("ijklmnop ", k=rnd.randrange(100, 900))) + (passage if i % 5 == 0 else "") for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(16).write.parquet(str(tmp_path / "docs"))
    real, calls = suffix_dedup.stash, []

    def stash(df, name):
        calls.append(name)
        out = real(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 4 + 5 * len(calls))
        return out

    monkeypatch.setattr(suffix_dedup, "stash", stash)
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.rewrite(spark.read.parquet(str(tmp_path / "docs")), scan=True).collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(calls) > 1 and got == {i: int(gone.sum()) for i, gone in enumerate(slow_removal([t.encode() for t in texts]))}


def test_repeats_of_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab" * 300, 5, [1]), (1, "ab" * 300, 6, None)], "doc_id bigint, text string, rid int, spans array<int>")
    assert [(r.doc_id, r.n_removed, r.text) for r in suffix_dedup.rewrite(docs).collect()] == [(1, 600, "")] * 2
    assert suffix_dedup.rewrite(docs.limit(0)).count() == 0


def test_empty_table_and_columns_of_texts():
    assert suffix_dedup.anchors_of([b"short"])[0].size == 0
    assert suffix_dedup.inside_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


# --- decontamination -----------------------------------------------------------


def edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        cur = [i + 1]
        for j, e in enumerate(text):
            cur.append(min(prev[j] + (c != e), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_leaks_equal_alignment():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8)))
    items = [(i, decontamination.normal(" ".join(word() for _ in range(n)))) for i, n in enumerate((8, 15, 30, 60))]
    index = decontamination.Items(items)
    for _ in range(60):
        k = rnd.randrange(len(items))
        s = list(items[k][1])
        for _ in range(rnd.randrange(0, 2 * int(index.budget[k]) + 2)):
            p = rnd.randrange(len(s))
            s[p : p + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
        text = decontamination.normal(" ".join(word() for _ in range(9)) + "".join(s) + " ".join(word() for _ in range(9)))
        true = edits(items[k][1], text)
        assert dict(decontamination.leaks([text], index)[0]).get(k) == (true if true <= index.budget[k] else None)


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, "tiny"), (3, "The quick brown fox jumps over the lazy dog, twice."), (9, "the QUICK brown fox jumps over the lazy dog twice")], "item_id bigint, text string")
    docs = documents(spark, [*EDGE, "so: the quick  brown fox, jumps over the lazy dog twice!"])
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.find_leaks(docs, bench, ["doc_id"]).collect()}
    assert got[len(EDGE)] == [3] and not any(v for k, v in got.items() if k != len(EDGE))
    assert decontamination.find_leaks(docs, bench.limit(0), ["doc_id"]).where(F.size("leaks") > 0).count() == 0


def test_windows_equal_alignment():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, decontamination.normal(prose(n))) for i, n in enumerate((60, 70))]
    index = decontamination.Items(items, window=60, step=20)
    met = 0
    for _ in range(60):
        k = rnd.randrange(len(items))
        at = rnd.randrange(len(items[k][1]) - 70)
        s = list(items[k][1][at : at + rnd.choice([62, 79, 120])])
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.randrange(len(s))
            s[p : p + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
        text = decontamination.normal(prose(5) + " " + "".join(s) + " " + prose(5))
        size = len(items[k][1])
        least = min(edits(items[k][1][a : a + 60], text) for a in {*range(0, size - 60, 20), size - 60})
        met += least <= 3
        assert dict(decontamination.leaks([text], index)[0]).get(k) == (least if least <= 3 else None)
    assert 10 < met < 60


def test_partial_leaks(spark):
    item = "Seven tall ships left the grey harbour at dawn, and none of the many people who waved from the old stone pier that day would ever see them again; so the keeper wrote it down."
    short, tiny = "An honest clerk seldom forgets the ledger he keeps beside the window of his room", "Who was the third king?"
    bench = spark.createDataFrame([(1, item), (2, short), (3, tiny), (4, "a forty letter item of words and numbers")], "item_id bigint, text string")
    texts = {
        "excerpt": ("x " + item[40:125] + " y", [1]),
        "cut": ("so it began. " + item[:100], [1]),
        "word": ("then: " + short.replace("forgets", "misremembers") + " z", [2]),
        "missing": ("then: " + short.replace("seldom ", "") + " z", [2]),
        "first": (short.replace("An", "Another"), [2]),
        "two words": (short.replace("forgets", "misremembers").replace("window", "fireplace") + " z", []),
        "tiny": ("He asked: who was the  third king", [3]),
        "inside a word": ("who was the third kingdom", []),
        "half": ("a forty letter item of", []),
        "clean": ("Nothing of the kind is written in this text, which talks about the weather.", []),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.find_leaks(docs, bench, ["doc_id"]).collect()}
    assert got == {k: ids for k, (_, ids) in texts.items()}


# --- tokens ---------------------------------------------------------------------


def test_token_files(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tracewright.session import fresh_path

    path = str(public.path("word_bpe_49k.json"))
    texts = [*EDGE, "Don't <|endoftext|> STOP, É! 123 a.,b ...", "ﬁne ΣΑΣ İx é́"]
    where = fresh_path(spark, "t")
    token_output.write_tokens(documents(spark, texts), where, lambda x: token_output.encode_texts(path, x), 1, partitions=3)
    rows = token_output.with_start(token_output.token_digests(token_output.read_tokens(spark, where)), token_output.read_metadata(spark, where)).collect()
    plain = Tokenizer.from_file(path)
    start, expected = 0, {}
    for i in [3, *[i for i in range(len(texts)) if i != 3]]:  # the null id comes first
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        expected[i if i != 3 else None] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected
    assert [r.doc_id for r in token_output.read_tokens(spark, where, [5]).collect()] == [5]


def test_sentencepiece_parity(spark):
    pytest.importorskip("public_tokenizers")
    model = sentencepiece_codec.default_model()
    sentencepiece_codec.verify(model, [t for t in EDGE if t is not None] + [" a  b ", "▁▁x ▁", "\n \n", "<s> </s> <0x41>", "日本\ttab"])
    got = {r.doc_id: (r.n_tokens, r.round_trip) for r in sentencepiece_codec.encode_documents(documents(spark, EDGE), model, ["doc_id"]).collect()}
    assert got[0] == got[1] == (0, True) and all(ok for _, ok in got.values())


# --- quality ----------------------------------------------------------------------


def slow_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})


def test_sentencepiece_parity_of_documents(spark):
    """Ids of whole documents of every language, junk and long texts equal the reference implementation's."""
    pytest.importorskip("public_tokenizers")
    pytest.importorskip("sentencepiece")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) >= 200 and len({r.lang for r in rows}) >= 4 and max(len(r.text or "") for r in rows) > 10_000
    texts = [r.text or "" for r in rows]
    sentencepiece_codec.verify(sentencepiece_codec.default_model(), [*texts, "\n".join(texts[:100])])


def test_measures():
    rnd = random.Random(5)
    for _ in range(60):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(0, 60))]
        assert quality.repeated_words(words) == slow_repeats(words)
    t = quality.Text("a # b\n\n a # b\na # b\nc é")
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines) == (11, 11, 3, 1)


def test_cascade_order_never_changes_the_verdict(spark):
    texts = [*EDGE, "the words of a plain and quiet text go on for a while here so that it has more than twenty of them in all", "### $$$ " * 30, "SHOUTING ALL THE TIME IS NOT WHAT ANYONE WANTS TO READ IN A TEXT OF SOME LENGTH SO IT GOES AWAY NOW OK"]
    docs = documents(spark, texts)
    verdicts = [{r.doc_id: r.kept for r in quality.apply_rules(docs, order, ["doc_id"]).collect()} for order in (list(quality.RULES), list(quality.RULES)[::-1], quality.order_rules(quality.estimate(docs, quality.RULES)))]
    assert verdicts[0] == verdicts[1] == verdicts[2] and [k for k, v in verdicts[0].items() if v] == [len(EDGE)]


# --- toxicity ------------------------------------------------------------------------


def test_toxicity_held_out():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 6)))

    def text(bad):
        w = [word() for _ in range(60)]
        for _ in range(4 if bad else 0):
            w.insert(rnd.randrange(60), rnd.choice(["idiot", "moron", "scum"]))
        return " ".join(w)

    rows = [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    at, w, bias = toxicity.train([(toxicity.features(t), y) for t, y in rows[:700]])
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    dense[at] = w
    score = [dense[toxicity.features(t)].sum() + bias for t, _ in rows[700:]]
    assert np.mean([(s > 0.85) == bool(y) for s, (_, y) in zip(score, rows[700:], strict=True)]) > 0.97 and len(at) < 2000


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    docs = documents(spark, EDGE)
    out = toxicity.score_texts(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    assert len(out) == len(EDGE) and all(0 <= r._score < 0.7 for r in out if r.doc_id in (0, 1, 2))
    assert toxicity.fit(docs, labels.limit(0)) is None
    clash = docs.withColumnRenamed("score", "_score")
    assert toxicity.score_texts(clash, None, ["doc_id", "_score"]).columns == ["doc_id", "_score"]
    assert toxicity.score_texts(docs.limit(0), None, ["doc_id"]).count() == 0


def test_known_features():
    rnd = random.Random(9)
    known = np.array(rnd.choices([True, False], k=1 << 8))
    for n in (0, 1, 3, 50):
        text = " ".join(rnd.choices(["alpha", "beta", "gammas", "de"], k=n))
        found = toxicity.features(text, 8)
        assert toxicity.weighty(text, known, 8).tolist() == found[known[found]].tolist()
        for piece in (1, 2, 7):
            assert sorted(np.concatenate([np.empty(0, np.uint64), *toxicity.grams_of(text, piece)])) == sorted(np.concatenate([np.empty(0, np.uint64), *toxicity.grams_of(text)]))


def test_best_cut():
    z, y = np.array([3.0, 2.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_cut(z, y) == 1.5 and toxicity.best_cut(z, y, alarm=0.1) == -0.5 and toxicity.best_cut(z, np.ones(5, int)) == 0.0


# --- chat -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|> & &lt;|"), (1, 1, "assistant", "<|im_start|>assistant\nyes"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "b"), (None, 0, "a\nb", "x")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_turn_rows(conv)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [(r or "", t or "") for _, _, r, t in rows[:3]], 2: [("assistant", ""), ("assistant", "b")], None: [("a\nb", "x")]}
    digest = {r.conv_id: r for r in chat.digests(made).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"<|im_start|>assistant\nyes").hexdigest() and digest[2].loss_chars == 1 and digest[None].loss_chars == 0


def test_layouts(spark):
    rows = ['{"prompt":"p","completion":"c"}', '{"instruction":"i","input":"n","output":"o"}', '{"messages":[{"role":"user","content":"u"}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"other":1}', None, "no json"]
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "payload string"), "payload").collect()
    turns = {r.payload: r.turns and [(x.role, x.text) for x in r.turns] for r in got}
    assert [turns[r] for r in rows] == [[("user", "p"), ("assistant", "c")], [("user", "i\n\nn"), ("assistant", "o")], [("user", "u")], [("user", "h"), ("assistant", "g")], None, None, None]


def test_layouts_of_nested_and_uneven_records(spark):
    rows = ['{"data":{"completion":"c","prompt":"p"}}', '{"messages":[]}', '{"messages":[{"role":"user"},{"content":"x","role":"assistant"}]}', '{"messages":null}', '{"prompt":"p","completion":null}', "[1]", '{"prompt":"STRING","response":"a: STRING, b"}']
    got = {r.payload: r.turns and [(x.role, x.text) for x in r.turns] for r in chat.canonical_turns(spark.createDataFrame([(r, 1, [2]) for r in rows], "payload string, layout int, turns array<int>"), "payload").collect()}
    assert [got[r] for r in rows] == [[("user", "p"), ("assistant", "c")], [], [("user", None), ("assistant", "x")], None, [("user", "p"), ("assistant", None)], None, [("user", "STRING"), ("assistant", "a: STRING, b")]]
    flat = chat.turn_rows_of_json(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id bigint, j string"), "id", "j").collect()
    assert [(r.conv_id, r.turn, r.text) for r in sorted(flat, key=lambda r: (r.conv_id, r.turn)) if r.conv_id in (1, 2)] == [(2, 0, ""), (2, 1, "x")]
    assert chat.turn_rows_of_json(spark.createDataFrame([], "id bigint, j string"), "id", "j").count() == 0


# --- sharding --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_shards_are_even(spark, n):
    df = spark.range(n).select((F.col("id") / 3).cast("bigint").alias("doc_id"), F.lit(5).alias("shard"))
    rows = sharding.shard_rows(df, ["doc_id"], 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1


def test_movement_is_limited():
    """One more shard takes its share; few other rows change places, as they would nearly all by a modulus."""
    rnd = random.Random(12)
    histogram = {c: rnd.randrange(1, 9) for c in range(4096)}
    of = [{}, {}]
    for k, shards in enumerate((8, 9)):
        for cell, lo, hi, shard, _ in sharding.pieces(histogram, shards, 64, 4096):
            of[k].update({(cell, r): shard for r in range(lo, hi)})
    moved = [key for key in of[0] if of[0][key] != of[1][key]]
    assert len(of[0]) == len(of[1]) == sum(histogram.values())
    assert 1 / 9 <= len(moved) / len(of[0]) < 1 / 3, len(moved) / len(of[0])


def test_equal_rows_and_null_keys_are_dealt(spark):
    docs = spark.createDataFrame([(1, "a", 7)] * 50 + [(None, None, 7)] * 30 + [(i, "b", 7) for i in range(20)], "doc_id bigint, text string, shard int")
    got = sharding.shard_rows(docs, ["doc_id", "text"]).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and all(r.n == r.k == r.m + 1 and r.n in (12, 13) for r in got)


def test_overflow_goes_clockwise():
    cells = 16
    walks = sharding.ring(3, 2, cells)
    hist = {c: (30 if c == 4 else 1) for c in range(cells)}
    got = sharding.pieces(hist, 3, 2, cells)
    home = walks[4][0]
    order = [s for c, _, _, s, _ in got if c == 4]
    assert order == [s for s in walks[4] if s in order] and order[0] == home
    assert sum(hi - lo for _, lo, hi, _, _ in got) == sum(hist.values())


@pytest.mark.parametrize("variant", ["given", "cased", "added", "other pattern", "byte level", "truncated"])
def test_token_output_reads_its_tokenizer_file(tmp_path, variant):
    """Ids are the library's for any file, by the short way or not."""
    import json

    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = str(public_tokenizers.path("byte_bpe_50k.json" if variant == "byte level" else "word_bpe_49k.json"))
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    if variant == "cased":
        settings["normalizer"]["normalizers"].pop()
    elif variant == "added":
        settings["added_tokens"].append(settings["added_tokens"][0] | {"id": 49408, "content": "[MARK]"})
    elif variant == "other pattern":
        settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    elif variant == "truncated":
        settings["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    if variant not in ("given", "byte level"):
        path = str(tmp_path / "tokenizer.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(settings, f)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    texts = ["Hello World, don't STOP 12 times", "Écoute  le\nVent [MARK] <|endoftext|> x", "", None, "a" * 300, "ÀÉ é日本 \U0001f389"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_output.encode_texts(path, texts)]
    assert got == want
    assert token_output.word_tokenizer(path) == (variant in ("given", "truncated"))


def test_marks_behind_accented_letters():
    """They are chunks of their own, so the words before them are known already; ids stay the library's."""
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert token_output._chunks("caf\u00e9, fin. \u0142\u0105, x") == [c.encode() for c in ["caf\u00e9", ",", "fin", ".", "\u0142\u0105", ",", "x"]]
    texts = ["Caf\u00c9, \u00dcB\u00dc. \u0130, 5\u00d7, \u00bb, \u0149, a-, b.\nd\u00fc.\n", "\u0130. x", "\u00aa, \u00f7. 1, -. \u00e0, \u00e0\u00bb.", "\u00df\u00e4\u00ff! \u00e9(, \u017f, \u00d7\u00e9, \u00c3, \u00e3\u00a0\u00ad, z"]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_output.encode_texts(path, texts)] == want


def test_tokenizers_go_before_digests():
    """The worker that reads token files back holds no chunks of those it wrote."""
    from tracewright.llm import rows

    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows.take_over("token_output", token_output.forget)
    token_output.encode_texts(str(public_tokenizers.path("word_bpe_49k.json")), ["some words"])
    assert token_output._caches
    rows.take_over("token_digests", None)
    assert not token_output._caches


def test_chunk_cache_forgets_what_failed():
    from tracewright.llm.pieces import ChunkCache

    def encode(chunks: list[str]) -> list[bytes]:
        if "bad" in chunks:
            raise ValueError
        return [c.encode() for c in chunks]

    cache = ChunkCache(encode, 2)
    with pytest.raises(ValueError):
        cache([["a", "bad"]])
    assert cache([["a", "b", "a"], [], ["c"]]) == [b"aba", b"", b"c"]
    assert cache([["c", "d"], ["a"]]) == [b"cd", b"a"]
