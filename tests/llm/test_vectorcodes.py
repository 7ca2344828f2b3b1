"""Vector codes against a plain Lloyd iteration in Python's integers."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label string, id string, v int, code string, error long, n int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """[(id, label, code, error)] and the codebooks, from (id, vector, label)."""
    good = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    held = [[max(-(2**62), min(2**62, math.floor(x * scale) if abs(x) < 2**900 else int(math.copysign(2**62, x)))) for x in r[1]] for r in good]
    w = len(held[0]) // parts if held else 0
    cut = [[tuple(v[w * p : w * p + w]) for p in range(parts)] for v in held]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)] if held else []

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for v in cut:
                of.setdefault(nearest(v[p], book)[1], []).append(v[p])
            for k, xs in of.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for r, v in zip(good, cut, strict=True):
        found = [nearest(x, b) for x, b in zip(v, books, strict=True)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), min(2**63 - 1, sum(d for d, _ in found))))
    return out, books


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "id", 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = vectorcodes.compress(df, **settings)
    want, books = plain(rows, **settings)
    key = lambda r: tuple(map(str, r))
    assert got.codebooks == books
    codes = [(r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in got.codes.collect()]
    assert sorted(codes, key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    summed = [(r.vec_id, r.label, bytes(r.code).hex(), r.error, r.label_error) for r in vectorcodes.with_label_error(got.codes).collect()]
    assert sorted(summed, key=key) == sorted([(*r, min(2**63 - 1, sums[r[1]])) for r in want], key=key)


def test_clusters_ties_and_repeats(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(900):
        centre = rnd.randrange(5)
        rows.append((rnd.randrange(400), [round(centre * 0.3 + rnd.gauss(0, 0.05), 2) for _ in range(16)], rnd.choice([None, "a", "b", "rare"])))
    check(spark, rows)
    check(spark, [(r[0], [float(int(x)) for x in r[1]], None) for r in rows])  # few distinct points: equal entries and ties
    check(spark, rows, parts=4, entries=5, rounds=2, scale=10)


def test_edges(spark):
    rnd = random.Random(1)
    one = [rnd.random() for _ in range(16)]
    bad = [(None, one, None), (1, None, "a"), (2, [*one[:15], None], "a"), (3, [*one[:15], float("nan")], None), (4, [*one[:15], float("inf")], None), (5, [], "a"), (6, one[:8], "b"), (7, one[:9], "b")]
    check(spark, bad)
    check(spark, [*bad, *[(k, [rnd.uniform(-2, 2) for _ in range(16)], "c") for k in range(40)], (8, one, "c"), (8, one, "c")])
    check(spark, [(k, [rnd.choice([1e6, -1e9, 1e17, 0.5, 1e306, -1e308]) * rnd.random() for _ in range(8)], None) for k in range(60)])
    check(spark, [(1, one, None)])
    check(spark, [])
    check(spark, [(1, None, "a")])


def _cells(tree, book, n):
    sums, counts = tree.totals(book)
    return sums.tolist(), counts.tolist(), *(x.tolist() for x in tree.codes(book, n))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 1000, 4097])
@pytest.mark.parametrize("spread", [3, 200, 2**27, 2**40])
def test_trees(n, spread):
    rng = np.random.default_rng(n + spread)
    rows = rng.integers(-spread, spread, (n, 3))
    book = rows[rng.integers(0, n, 9)] if n > 4 else rng.integers(-spread, spread, (9, 3))
    exact = rows.astype(object)
    apart = ((exact[:, None] - book.astype(object)[None]) ** 2).sum(2)
    entry = np.array([min(range(9), key=lambda k, a=a: (a[k], k)) for a in apart])
    want = [exact[entry == k].sum(0).tolist() if (entry == k).any() else [0] * 3 for k in range(9)], [int((entry == k).sum()) for k in range(9)], entry.tolist(), apart[np.arange(n), entry].tolist()
    assert _cells(vectorcodes.Tree.build(rows), book if spread < 2**28 else book.astype(object), n) == want


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(0, 50, (2048, 4)) + 1000 * k for k in range(4)])
    tree = vectorcodes.Tree.build(rows)
    book = np.array([[1000 * k + 25] * 4 for k in range(4)])
    touched = sum(len(at) for level, at, _ in tree.assigned(book) if level < 0)
    assert touched < len(rows) / 20  # points that were looked at one by one
    assert tree.totals(book)[1].tolist() == [2048] * 4


def test_many_chunks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (2 * vectorcodes.CHUNK_ROWS + 77, 2))
    rows = [(k, [float(a), float(b)], str(k % 3)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").coalesce(1)
    got = vectorcodes.compress(df, parts=2, entries=4, rounds=1)
    book = np.floor(4096 * x[:4]).astype(np.int64)
    scaled = np.floor(4096 * x).astype(np.int64)
    for p in range(2):
        entry = ((scaled[:, p : p + 1] - book[:, p][None]) ** 2).argmin(1)
        assert [c[0] for c in got.codebooks[p]] == [int(scaled[entry == k, p].sum()) // int((entry == k).sum()) for k in range(4)]
    assert got.codes.count() == len(rows)
