"""Byte-level BPE by tree reduction against the tiktoken library."""

import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.test_edges import SCHEMA, TEXTS
from tidemark.llm import bytetree
from tidemark.llm import queries as q


def own():
    return bytetree.tree_bpe(q.MULTI_RANKS, public_tokenizers.PATTERN)


_library = []


def library():
    if not _library:
        _library.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own().ranks, special_tokens={}))
    return _library[0]


def same(text):
    ids = own().encode(text)
    assert ids.tolist() == library().encode_ordinary(text)
    assert own().decode(ids.tolist()) == text.encode()


ALPHABET = " \n\t\x0b\r'sdtrevmlaZ09.!éß漢字　\x1f՘౜\U00011de0힣éa"


@pytest.fixture(params=[1, 3, 50])
def leaf(request, monkeypatch):
    monkeypatch.setattr(bytetree, "_LEAF_CHARS", request.param)


def test_small_leaves(leaf):
    rnd = random.Random(3)
    for _ in range(4000):
        same("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["a" * 40_000, "ab" * 30_000, " " * 40_000 + "x", "1" * 30_000, "word " * 20_000, "\n \t" * 20_000, "漢字かな" * 8_000, "it's " * 9_000])
def test_long_matches_and_texts(text):
    same(text)


def test_joins_are_associative():
    rnd = random.Random(5)
    bpe = own()
    for _ in range(500):
        a, b, c = (bytes(rnd.choice(b"abcde ing\xc3\xa9") for _ in range(rnd.randint(0, 30))) for _ in range(3))
        x, y, z = map(bpe.merge, (a, b, c))
        assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z)) == bpe.merge(a + b + c)


def test_a_token_that_merges_never_reach(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"abx": 259}
    ranks[b"zabc"] = 260  # "za" is no token: merges end at z, abc? no: bc, then a bc stays
    del ranks[b"abc"]
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    bpe = bytetree.TreeBpe(str(path), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("zabc", "zabcz", "abc", "abx", "zabc zabc", "abcabcabc" * 30, "xzabc"):
        assert bpe.encode(text).tolist() == lib.encode_ordinary(text)


def test_edges(spark):
    rows = [(k * 3 - 5, t, "id", 1, "x", 2, 3) for k, t in enumerate(TEXTS)] + [(None, "null id", "id", 1, "x", 2, 3), (1, TEXTS[2], "id", 1, "x", 2, 3)]
    got = bytetree.encode_decode(spark.createDataFrame(rows, SCHEMA).repartition(3), q.MULTI_RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((r[0] is not None, r[0] or 0, np.array(library().encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    empty = bytetree.encode_decode(spark.createDataFrame([], SCHEMA), q.MULTI_RANKS, public_tokenizers.PATTERN)
    assert empty.columns == ["doc_id", "ids", "n_tokens", "decoded"] and empty.collect() == []


def test_query(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    want = set()
    for d, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        ids = library().encode_ordinary(text or "")
        want.add((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text or "")))
    got = q.op12_byte_bpe_round_trip(spark, sf_dir)
    assert {tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
