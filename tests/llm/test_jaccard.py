"""The exact near-duplicates of the pipeline against every pair of documents."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import jaccard, rolling, simhash


def shingles(text, width=5):
    w = brute.WORD.findall(brute.lower(text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def linked(docs):
    """{id: smallest id reached}, over all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def varied(seed=5):
    """Copies with words changed, from light to beyond the bound; a large group; a passage that many hold; short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=40)
    texts = [None, "", " \n", "One", "one", "one two three four", "One two  three\nfour", "one two three four five", "a b a b a b a b a b a b", "a b a b a b a b"]
    for k in range(30):
        base = rng.choices(words, k=rng.choice([6, 30, 120, 400]))
        for _ in range(60 if k == 0 else 4):
            copy = [rng.choice(words) if rng.random() < rng.choice([0.003, 0.015, 0.03]) else w for w in base]
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 3)]))
        texts.append(" ".join([*base, *passage]))
        texts.append(" ".join([*rng.choices(words, k=10), *passage]).upper())
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_every_pair_is_found(spark):
    docs = varied()
    want = linked(docs)
    assert len(set(want.values())) < len(docs) - 60
    for n in (1, 7):
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(n)
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()} == want


def test_ids(spark):
    text = " ".join(f"x{k}" for k in range(50))
    frame = spark.createDataFrame([(1, "a"), (1, text), (3, text + " y"), (None, "b c"), (4, "B  C")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.near_duplicates(frame).collect())
    assert got == [("1", "1"), ("1", "1"), ("3", "1"), ("4", "None"), ("None", "None")]
    assert jaccard.near_duplicates(frame.limit(0)).collect() == []


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    """Documents 2 and 56 have a similarity of 0.967 and SimHashes five bits apart."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 300 OR doc_id IN (434, 774)")
    docs = {r.doc_id: r.text for r in table.collect()}
    want = {d for d, c in linked(docs).items() if d == c}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, sf_dir).collect()} == want
    assert 2 in want and 56 not in want


def test_a_group_in_which_few_pairs_are_similar(spark):
    """Near copies that share most rare words, with many pairs just beyond the bound: the later rounds decide."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    base = rng.choices(words, k=150)
    texts = [" ".join(rng.choice(words) if rng.random() < 0.019 else w for w in base) for _ in range(120)]
    texts += [" ".join(base[:140] + rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    docs = dict(enumerate(texts))
    want = linked(docs)
    assert 2 < len(set(want.values())) < len(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()} == want


def test_set_fingerprints():
    rng = np.random.default_rng(3)
    at = np.cumsum([0, 1, 0, 2, 255, 256, 700])
    hashed = rng.integers(0, 2**64, at[-1], np.uint64)
    got = simhash.set_fingerprints(hashed, at)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        for j, salt in enumerate(simhash._SALTS):
            mixed = [int(x) for x in rolling.mix(hashed[a:b] ^ salt)]
            assert int(got[k, j]) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in mixed) > b - a)


def test_halves_within_a_bit_meet(spark):
    """Two sets in 2 bits of one half apart do not; a group in one cell takes few rows for each set."""
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**64, (160, simhash.PRINTS), np.uint64)
    want = set()
    for k in range(0, 100, 2):
        j, bit = int(rng.integers(simhash.PRINTS)), int(rng.integers(64))
        prints[k + 1, j] = prints[k, j] ^ np.uint64(1 << bit)
        prints[k + 1, j] ^= np.uint64(0b101 << (32 if bit < 32 else 0))  # the other half: two bits
        if k % 10 == 8:
            prints[k + 1, j] = prints[k, j] ^ np.uint64((1 << bit) | (1 << (bit ^ 1)) | (0b101 << (32 if bit < 32 else 0)))
        else:
            want.add((k, k + 1))
    prints[100:, 0] = prints[100, 0]
    rows = [(k, row.astype("<u8").tobytes()) for k, row in enumerate(prints)]
    got = [tuple(r) for r in simhash.near(spark.createDataFrame(rows, "key long, prints binary").repartition(3)).collect()]
    assert {p for p in got if p[0] < 100} == want
    group = [p for p in got if p[0] >= 100]
    assert {k for p in group for k in p} == set(range(100, 160)) and len(set(group)) == len(group) <= simhash.LINKS * 60
    assert simhash.near(spark.createDataFrame([], "key long, prints binary")).collect() == []


def components(nodes, pairs):
    """The number of components."""
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return sum(find(x) == x for x in up)


def test_stage_meets_by_fingerprints(spark, sf_dir, monkeypatch):
    """The range join links nine tenths of what similarity links by itself, and the stage keeps what brute force keeps."""
    docs = varied()
    named, near = [], simhash.near

    def recorded(sets):
        out = near(sets)
        named.extend((r.u, r.v) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "near", recorded)
    frame = spark.createDataFrame([(d, t, None, "s", None) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, sf_dir).collect()}
    assert got == {d for d, c in linked(docs).items() if d == c}
    ids = sorted(docs)
    batch = pa.record_batch([pa.array(ids), pa.array([(docs[d] or "").encode() for d in ids], pa.binary())], ["id", "text"])
    key = {d: k for part, _, _, keys in jaccard._sets(iter([batch]), 5) for d, k in zip(part.column("id").to_pylist(), keys.tolist(), strict=True)}
    sets = {key[d]: shingles(t) for d, t in docs.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    by_bits, whole = (len(sets) - components(sets, p) for p in (set(named) & set(pairs), pairs))
    assert whole > 60 and 10 * by_bits >= 9 * whole


def test_fingerprints_change_no_result(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    base = rng.choices(words, k=150)
    texts = [" ".join(rng.choice(words) if rng.random() < 0.019 else w for w in base) for _ in range(120)]
    texts += [" ".join(base[:140] + rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "a", "A ", "one two"] * 3
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(frame).collect()} == linked(docs)
    rows = [(1, "a"), (1, "b c"), (None, "B  C"), (4, None)]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1"), ("1", "None"), ("4", "4"), ("None", "None")]
    assert simhash.similar(frame.limit(0)).collect() == []
