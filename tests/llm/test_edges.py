"""Small tables with nulls, empty and very long texts, ties, repeated rows, clashing columns; empty tables."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import bpe, chat, common, components, gsaca, linededup, packing, quality, rolling, simhash, substring, suffix, tokens, topk
from tidemark.llm import queries as q

SCHEMA = "doc_id long, text string, id string, kept long, n_tokens string, spans int, bits int"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
TEXTS = [
    "", None, " ", "\n", "a", " ", "word " * 19, "one two three four five six seven eight nine ten " * 6, "x" * 5000, LONG, LONG[:5000] + " Z " + LONG[5000:9000],
    "the same line that many documents hold\nown line\n  The Same Line that many documents hold\t", "the same line that many documents hold", "THE SAME LINE THAT MANY DOCUMENTS HOLD\n\n",
    "zażółć gęślą jaźń 漢字かな交じり文 Ωμέγα ΣΊΣΥΦΟΣ İstanbul été 👩‍👩‍👧   sep", "<|endoftext|> in <|startoftext|>text<|endoftext|>", "it's we'll I'd they're\r\n\ttabs  double   spaces ",
    "\x0b\x0cform feeds\x1funit", "a b c a b c a b c", "a b", "a b c",
]


@pytest.fixture(scope="module")
def docs():
    return {k * 3 - 5: t for k, t in enumerate(TEXTS)} | {100 + k: TEXTS[k] for k in (7, 9, 10, 11)}


@pytest.fixture(scope="module")
def frame(spark, docs):
    rows = [(d, t, "id", 1, "x", 2, 3) for d, t in docs.items()]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def sha(column):
    return F.sha2(F.col(column).cast("binary"), 256)


def test_counts(frame, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = tokens.token_counts(frame, q.BYTE_BPE, q.BYTE_RANKS)
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == {(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in docs.items()}


_text = st.text(st.one_of(st.sampled_from(" \n\t'sdtrevml.0A  \x1f<|>"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(_text)
def test_encoders_agree_with_the_library(text):
    byte, word = _libraries()
    assert tokens.encoder(q.BYTE_BPE, q.BYTE_RANKS).encode(text).tolist() == byte.encode(text, add_special_tokens=False).ids
    pieces = list(tokens.safe_pieces(text, 3))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in byte.encode(p, add_special_tokens=False).ids] == byte.encode(text, add_special_tokens=False).ids
    own = bpe.word_bpe(q.WORD_BPE)
    (ids,) = own.encode([text])
    want = word.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids).decode() == word.decode(want, skip_special_tokens=False)


_loaded = []


def _libraries():
    if not _loaded:
        _loaded.extend(Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    return _loaded


def test_long_words():
    byte, word = _libraries()
    for text in ("ab" * 30_000, "a" * 20_000, " " * 30_000 + "x", "x " * 5000 + " " * 9000, "é" * 700, "qz" * 400 + " " + "ab" * 400):
        assert tokens.encoder(q.BYTE_BPE, q.BYTE_RANKS).encode(text).tolist() == byte.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.word_bpe(q.WORD_BPE).encode([text])[0], "<u4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_round_trip(frame, docs):
    _, t = _libraries()
    got = bpe.encode_decode(frame, q.WORD_BPE)
    want = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in docs.items()}
    assert {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got.collect()} == {d: (x, t.decode(x, skip_special_tokens=False)) for d, x in want.items()}


def test_substring(frame, docs):
    assert rows(substring.substring_dedup(frame).withColumn("s", sha("kept")), "doc_id", "n_words", "n_removed", "s") == brute.substring(docs)
    kept = {r.doc_id: r for r in substring.substring_dedup(frame, layout="text", carry=("id",)).collect()}
    assert kept[-5].id == "id" and kept[37].kept == docs[37] != ""


def test_substring_tells_thue_morse_words_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    for n in (1024, 2048):
        tail = " " + " ".join(f"x{k}" for k in range(19))
        docs = {1: word[:n] + tail, 2: word[:n].translate({97: 98, 98: 97}) + tail}
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        assert [r.n_removed for r in substring.substring_dedup(df).orderBy("doc_id").collect()] == [0, 0]


def test_substring_with_a_second_exchange(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = df.select(F.col("doc_id").alias("id"), common.text_in("text").alias("text"), F.lit(0).cast("long").alias("print")).select("id", "print", "text")
    got = [{(r.id, bytes(r.spans)) for r in substring.late_spans(docs, 20, **k).collect()} for k in ({"bits": 0}, {"bits": 3}, {"bits": 9, "level_bits": 4, "chunk": 5000})]
    assert got[0] == got[1] == got[2] and got[0]


def test_rolling_hashes_follow_their_definition():
    rng, prime = random.Random(3), 2**61 - 1
    values = [rng.randrange(prime) for _ in range(200)] + [prime - 1, 0, 1]
    symbols = np.array(values, np.uint64)
    for width in (1, 2, 3, 7, 20):
        polynomials = [[sum(values[i + k] * pow(b, width - 1 - k, prime) for k in range(width)) % prime for i in range(len(values) - width + 1)] for b in rolling.BASES]
        first, last = rolling.window_pairs((symbols, symbols), width)
        assert [(int(x) >> 3, (int(x) & 7) << 58 | int(y) >> 6) for x, y in zip(first, last, strict=True)] == list(zip(*polynomials, strict=True))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=8))
def test_substring_small_alphabet(spark, texts):
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert rows(substring.substring_dedup(df, width=3).withColumn("s", sha("kept")), "doc_id", "n_words", "n_removed", "s") == brute.substring(docs, 3)


def test_suffix(frame, docs):
    got = suffix.suffix_dedup(frame).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), sha("kept").alias("s"))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n", "s") == brute.suffix(docs)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=8))
def test_suffix_small_alphabet(spark, texts):
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = suffix.suffix_dedup(df, width=12, gram=5).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), sha("kept").alias("s"))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n", "s") == brute.suffix(docs, 12)


def test_suffix_with_hot_anchors(frame, docs):
    for hot in (1, 2, 30):
        got = suffix.suffix_dedup(frame, hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), sha("kept").alias("s"))
        assert rows(got, "doc_id", "n_bytes", "n_removed", "n", "s") == brute.suffix(docs)


def test_suffix_over_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh ", k=3000))
    many = {k: base[: 400 + 37 * k] + rng.choice("xyz") * 3 + base[300 + 11 * k : 900] for k in range(40)}
    monkeypatch.setattr(suffix, "PIECE", 1 << 10)  # the pieces of a long text
    batch = pa.record_batch([pa.array([7]), pa.array([0]), pa.array([LONG.encode()], pa.binary())], ["id", "print", "text"])
    cut = [(at, bytes(raw)) for _, raw, _, at in suffix.pieces([batch], 100)]
    assert [at for at, _ in cut] == list(range(0, len(LONG) - 99, 1 << 10)) and all(raw == LONG.encode()[at : at + 1123] for at, raw in cut)
    got = {}
    for block in (2, 7, 1 << 14):
        monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", block)
        codecs = suffix._codecs(100, 36, 0, 0)
        found = suffix._decide(100, 36, codecs)(0, _contexts(many))
        got[block] = {(d, x) for d, a, b in zip(*(found[c].tolist() for c in ("id", "pos", "end")), strict=True) for x in range(a, b)}
    assert got[2] == got[7] == got[1 << 14] and got[2]


def _contexts(many):
    rows = [(d, p) for d, t in many.items() for p in range(64, len(t) - 100, 50)]
    text = np.array([np.frombuffer(many[d][p - 64 : p + 100].encode(), np.uint8) for d, p in rows])
    gram = np.array([hash(text[k, 64:100].tobytes()) & (2**63 - 1) for k in range(len(rows))], np.uint64)
    whole = np.array([hash(x.tobytes()) & (2**63 - 1) for x in text], np.uint64)
    ids, pos = np.array([d for d, _ in rows]), np.array([p for _, p in rows])
    side = lambda n: np.full(len(rows), n, np.uint8)
    return {"gram": gram, "whole": whole, "id": ids, "print": np.zeros(len(rows), np.int64), "pos": pos, "left": side(64), "right": side(100), "text": text}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert gsaca.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_lines(frame, docs):
    assert rows(linededup.line_dedup(frame).withColumn("s", sha("kept")), "doc_id", "n_lines", "n_dropped", "s") == brute.lines(docs)


def test_simhash(frame, docs):
    assert rows(simhash.near_duplicates(frame), "doc_id", "fingerprint", "component_id") == brute.simhash(docs)


def test_all_close_fingerprints_meet(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(12)} | {0, 2**64 - 1, 3, 2**63}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(signed, "bits long")).collect()}
    values = sorted(x for (x,) in signed)
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (100, 101), (99, 102)] + [(200, 201)] * 2
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 99 for k in range(99, 103)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality(frame, docs):
    got = quality.measure(frame, carry=("text", "kept"))
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == {(d, *brute.measures(t)) for d, t in docs.items()}
    assert {r.doc_id: r.text for r in got.collect()} == docs
    bits = [r.failures for r in got.collect()]
    for policy in (quality.BASE, quality.STANDARD_1, quality.STANDARD, quality.STRICT):
        ablated = {r.rule: (r.failed, r.only_this) for r in quality.ablations(got, policy).collect()}
        assert set(ablated) == set(policy.rules)
        for k, rule in enumerate(quality.RULES):
            if rule.name in ablated:
                assert ablated[rule.name] == (sum(b >> k & 1 for b in bits), sum(b & policy.mask == 1 << k for b in bits))
    assert quality.STRICT.mask == (1 << len(quality.RULES)) - 1


def test_packing(frame, docs):
    t, _ = _libraries()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in docs.items()}
    for size in (2048, 16):
        got = packing.pack(frame, q.BYTE_BPE, q.BYTE_RANKS, size=size).toPandas()
        back = {d: np.frombuffer(b"".join(p.sort_values("start").ids), "<u4").tolist() for d, p in got.groupby("doc_id")}
        assert back == ids
        fill = got.groupby("sequence_id").length.sum()
        assert fill.max() <= size
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert list(s.offset) == [0, *s.length.cumsum()][:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_placing(lengths):
    windows = packing.place(lengths, 16)
    pieces = sorted(p for w in windows for p in w)
    assert all(sum(n for _, _, n in w) in (16, 8, 4, 2, 1) for w in windows)
    for d, n in enumerate(lengths):
        own = [(s, k) for x, s, k in pieces if x == d]
        assert [s for s, _ in own] + [n] == [0] + [s + k for s, k in own]


def test_best_fit_takes_the_tightest_window():
    tree = packing._Capacities(64)
    model = []
    rng = random.Random(1)
    for k in range(600):
        if model and rng.random() < 0.5:
            want = rng.randint(1, 64)
            fits = [c for c, _ in model if c >= want]
            found = tree.tightest(want)
            assert (found[0] if found else None) == (min(fits) if fits else None)
            if found:
                model.remove(found)
        else:
            entry = (rng.randint(1, 63), k)
            model.append(entry)
            tree.add(*entry)


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    v = {0: [1.0, 2.0], 1: [1.0, 2.0], 2: [1.0, 2.0], 3: [-1.0, 0.001], 4: None, 5: [nan, 1.0], 6: [inf, 0.0], 7: [1.0], 8: [None, 1.0], 50: [0.5, -0.5], 100: [3e8, 3e8], 150: [], 9: [1e30, -1e30]}
    df = spark.createDataFrame([(k, x, "s", 1) for k, x in v.items()], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3)
    good = {k: [math.floor(256 * x) for x in e] for k, e in v.items() if e and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for a in (0, 50, 100):
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-clip(sum(x * y for x, y in zip(good[a], good[b], strict=True))), b) for b in good if b != a and len(good[a]) == len(good[b]))
        want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(scores[:3])}
    assert rows(got, "query_id", "rank", "vec_id", "score") == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_merges_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = random.Random(2)
    v = {k: [rng.randint(-3, 3) / 256 for _ in range(4)] for k in range(300)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    want = set()
    for a in range(0, 300, 50):
        scores = sorted((-sum(round(x * 256) * round(y * 256) for x, y in zip(v[a], v[b], strict=True)), b) for b in v if b != a)
        want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(scores[:5])}
    assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == want


CHAT = "conv_id long, turn long, role string, text string, digest string"


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s>", "<|im_start|>", "[INST:user]", "a%5Db]", None, "", "plain", "<", "\\"]
    data = [(c, k, r, said[(c + k) % len(said)], "d") for c in range(30) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"][: 1 + c % 5])]
    data += [(100, 0, "user", "hi", "d"), (100, 0, "user", "hi", "d"), (100, None, None, None, "d"), (101, 0, "a]b%</s>\n", "x", "d"), (None, 0, "assistant", "null id", "d")]
    df = spark.createDataFrame(data, CHAT)
    for least in (256, 1, 3):
        check_chat(df, data, least)
    assert chat.formatted(df.limit(0))[0].count() == 0


def check_chat(df, data, least):
    trees, leaf_of = chat.formatted(df, least=least)
    content = chat.contents(trees).withColumn("a", sha("turns_text")).withColumn("b", sha("loss_text")).withColumn("n", F.length("loss_text"))
    got = rows(leaf_of.join(content, "digest"), "conv", "n_turns", "a", "n", "b")
    assert got == brute.conversations([r[:4] for r in data])
    for t in trees.collect():
        assert "".join(t.tokens[n.begin : n.end] for n in t.nodes) == t.tokens  # each shared token once, depth first
        for k, n in enumerate(t.nodes):
            spans = [(x.begin, x.end) for x in n.attends]
            assert sum(b - a for a, b in spans) + sum(x.end - x.begin for x in t.parent_attends or []) == n.position
            assert all(b <= n.begin for _, b in spans) and spans == sorted(spans)
            up = n.parent
            while up >= 0:
                assert any(a <= t.nodes[up].begin and t.nodes[up].end <= b for a, b in spans)
                up = t.nodes[up].parent


def test_chat_emits_shared_turns_once(spark):
    data = [(c, k, "user", f"turn {k}" if k < 4 else f"own {c % 700}", "d") for c in range(1024) for k in range(5)]
    df = spark.createDataFrame(data, CHAT)
    sizes = {}
    for least in (10_000, 16):
        trees, leaf_of = chat.formatted(df, least=least)
        found = trees.collect()
        sizes[least] = (len(found) > 1, sum(len(t.tokens) for t in found))
        content = chat.contents(trees)
        got = rows(leaf_of.join(content, "digest"), "conv", "n_turns", "turns_text")
        assert got == {(c, 5, "".join(f"user\nturn {k}\n" for k in range(4)) + f"user\nown {c % 700}\n") for c in range(1024)}
    assert sizes[10_000][1] == sizes[16][1] and not sizes[10_000][0] and sizes[16][0]


def test_trees_without_a_parent_stay_spread(spark):
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        data = [(c, k, "user", f"turn {k} of {c if c % 3 else 0}" if k < 2 else f"own {c}", "d") for c in range(1500) for k in range(3)]
        found, _ = chat.formatted(spark.createDataFrame(data, CHAT), least=64)
        assert found.filter("parent IS NOT NULL").count() > 1
        for df in (found, chat.contents(found)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 3 * sum(sizes) / 32
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@settings(max_examples=300, deadline=None)
@given(st.text("<\\/s>[INST:]|%x\n", max_size=30), st.text("<\\/s>[INST:]|%x\n5D2", max_size=12))
def test_template_is_reversible(text, role):
    t = chat.Template()
    assert not any(c in t.escape(text) for c in t.controls)
    assert t.unescape(t.escape(text)) == text
    once, a, b = t.format(role, text)
    assert t.unescape(once[a:b]) == text
    assert t.parse(once + once) == [(role, text)] * 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for out in (
        tokens.token_counts(empty, q.BYTE_BPE, q.BYTE_RANKS), bpe.encode_decode(empty, q.WORD_BPE), substring.substring_dedup(empty), suffix.suffix_dedup(empty),
        packing.pack(empty, q.BYTE_BPE, q.BYTE_RANKS), quality.measure(empty), linededup.line_dedup(empty), simhash.near_duplicates(empty),
    ):
        assert out.count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows_ = [(None, text), (3, text), (3, text), (7, text + " more"), (7, "short"), (None, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    for out in (
        tokens.token_counts(df, q.BYTE_BPE, q.BYTE_RANKS), bpe.encode_decode(df, q.WORD_BPE), substring.substring_dedup(df), suffix.suffix_dedup(df), quality.measure(df),
        linededup.line_dedup(df), simhash.near_duplicates(df),
    ):
        assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 3, 7, 7, None, None]
    removed = sorted((str(r.doc_id), r.n_removed) for r in substring.substring_dedup(df).collect())
    assert removed == [("3", 60), ("3", 60), ("7", 0), ("7", 60), ("None", 0), ("None", 0)]
    cut = sorted((str(r.doc_id), r.n_removed) for r in suffix.suffix_dedup(df).collect())
    assert cut == [("3", len(text)), ("3", len(text)), ("7", 0), ("7", len(text)), ("None", 0), ("None", 0)]
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert {r.n_removed for r in substring.substring_dedup(twice).collect()} == {0}
    assert {r.n_removed for r in suffix.suffix_dedup(twice).collect()} == {0}
    assert {r.component_id for r in simhash.near_duplicates(df).filter("doc_id = 3").collect()} == {None}
    assert packing.pack(df, q.BYTE_BPE, q.BYTE_RANKS).groupBy("doc_id").count().count() == 3


def test_hashes_of_words():
    raw = np.frombuffer("zwei drei\nzwei  drei x".encode(), np.uint8)
    begins, ends, first = rolling.word_bounds(raw, np.array([0, 9, len(raw)]))
    h = rolling.word_hashes(raw, begins, ends)
    assert first.tolist() == [0, 2, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_character_classes_agree_on_assigned_characters():
    import unicodedata

    import regex

    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)
        if kind not in ("Cn", "Cs"):
            assert bool(letter.match(c)) == (kind[0] == "L") and bool(number.match(c)) == (kind[0] == "N")
