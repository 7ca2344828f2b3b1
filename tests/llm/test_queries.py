"""Each registered query over its whole table against the brute-force version."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_jaccard import linked
from tidemark.llm import queries as q


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_token_counts(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(e.ids) for d, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    got = q.op1_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)


def test_bpe_round_trip(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: e.ids for d, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    want = {(d, len(x), brute.sha(np.array(x, "<u4").tobytes()), brute.sha(t.decode(x, skip_special_tokens=False))) for d, x in ids.items()}
    assert rows(q.op2_bpe_round_trip(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_substring(spark, sf_dir, docs):
    assert rows(q.op3_substring_dedup(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(docs)


def test_chat(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/conversations.parquet")
    data = list(zip(*[t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True))
    data += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = q.op4_chat_format(spark, sf_dir)
    assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute.conversations(data)


def test_suffix(spark, sf_dir, docs):
    got = rows(q.op5_suffix_dedup(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(docs)


def test_packing(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*e.ids, 1], "<u4") for d, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    got = q.op6_packing(spark, sf_dir).toPandas()
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert [*pieces.start, len(ids[d])] == [0, *(pieces.start + pieces.length)]
    assert set(got.doc_id) == set(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in got.itertuples())
    fill = []
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert [*s.offset, s.length.sum()] == [0, *s.length.cumsum()]
        fill.append(int(s.length.sum()))
    assert max(fill) <= 2048
    assert sum(2048 - n for n in fill if n & (n - 1)) <= 0.02 * sum(fill)


def test_top_k(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)}
    want = set()
    for a in (x for x in vectors if x % 50 == 0):
        scores = sorted((-sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True)), b) for b in vectors if b != a)
        want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(scores[:5])}
    assert rows(q.op7_exact_top_k(spark, sf_dir), "query_id", "rank", "vec_id", "score") == want


def test_quality(spark, sf_dir, docs):
    want = set()
    for d, t in docs.items():
        m = brute.measures(t)
        want.add((d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    got = q.op8_quality_rules(spark, sf_dir)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("kept AND base_failed").count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    verdicts = [(r.kept, labels[r.doc_id]) for r in got.filter("NOT base_failed").collect() if labels.get(r.doc_id) is not None]
    assert verdicts and all(kept for kept, quality in verdicts if quality == 1)


def test_lines(spark, sf_dir, docs):
    assert rows(q.op9_line_dedup(spark, sf_dir), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.lines(docs)


def test_simhash(spark, sf_dir, docs):
    assert rows(q.op10_simhash_near_dedup(spark, sf_dir), "doc_id", "fingerprint", "component_id") == brute.simhash(docs)


def test_pipeline_edges(spark, sf_dir):
    import corpus_pipeline as p

    line = "a line that many documents hold, word for word"
    words = " ".join(f"word{k}" for k in range(80))
    texts = [None, "", " \n ", words, words, f"{words} other {line}", f"{line}\n{words.upper()}\n{line}", "x" * 30_000, " ".join(f"v{k}" for k in range(30_000))]
    rows_ = [(d, t, None, "s", None, "extra") for d, t in enumerate(texts)] + [(None, words, "en", "s", 1, "extra"), (3, words, "en", "s", 1, "extra")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for data in (rows_, []):
        frame = spark.createDataFrame(data, schema)
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == list(p.COLUMNS)
            got = out.collect()
            assert len(got) <= len(data) and {r.doc_id for r in got} <= {r[0] for r in data}
            if name == "near_dedup" and data:
                assert len({r.text for r in got}) == len(got)  # of equal texts, one stays
            frame = spark.createDataFrame(got, out.schema)
        assert {r.doc_id for r in p.pack(spark, frame, sf_dir).collect()} == {r.doc_id for r in frame.collect()}


def test_pipeline(spark, sf_dir, docs):
    import base64

    import corpus_pipeline as p
    from tidemark.llm import quality

    frame, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, frame, sf_dir).cache()
        assert out.columns == frame.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert all(r.n_chars == len(r.text) for r in out.select("text", "n_chars").collect())
        if name == "quality_rules":
            ledger = quality.apply_policy(quality.measure(frame), quality.STANDARD)
            assert got == {r.doc_id: kept[r.doc_id] for r in ledger.filter("kept").collect()}
        elif name == "line_dedup":
            assert {(d, brute.sha(t)) for d, t in got.items()} == {(x[0], x[3]) for x in brute.lines(kept)}
        elif name == "near_dedup":
            assert got == {d: kept[d] for d, c in linked(kept).items() if d == c}  # five words, a similarity of 0.8 or more
        else:
            want = {x[0]: x[3] for x in brute.substring(kept)}
            assert {d: brute.sha(" ".join(brute.WORD.findall(t))) for d, t in got.items()} == want
        frame, kept = out, got
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in p.run(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, base64.b64decode(r.ids)))
    got = {d: np.frombuffer(b"".join(x for _, x in sorted(y)), "<u4").tolist() for d, y in pieces.items()}
    assert got == {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in kept.items()}
