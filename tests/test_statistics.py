"""Co-moments and ranks against plain versions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators.comoments import _of_batch, comoments, merged
from tidemark.operators.ranks import ranked

NAMES = ("a", "b", "c", "d")


def plain(values):
    """{(left, right): (n, r)}, in long doubles."""
    out = {}
    for i in range(len(NAMES)):
        for j in range(i + 1, len(NAMES)):
            both = ~(np.isnan(values[:, i]) | np.isnan(values[:, j]))
            x, y = (values[both, k].astype(np.longdouble) for k in (i, j))
            r = None
            if len(x) and x.min() < x.max() and y.min() < y.max():
                u, v = x - x.mean(), y - y.mean()
                r = float((u @ v) / np.sqrt((u @ u) * (v @ v)))
            out[NAMES[i], NAMES[j]] = (len(x), r)
    return out


def data(kind, rng, n=3000):
    base = rng.normal(size=(n, 4))
    base[:, 1] += base[:, 0]
    holes = rng.random((n, 4)) < 0.2
    if kind == "far":  # a mean of 1e9 and a spread of 1
        base += 1e9
    elif kind == "regimes":  # c is present only where d is far from its other values, and close together
        base[: n // 2, 3] += 1e9
        holes[n // 2 :, 2] = True
        base[: n // 2, 0] = 7.7  # equal wherever c is
    elif kind == "constant":
        base[:, 2] = 0.1
    elif kind == "empty column":
        holes[:, 3] = True
    return np.where(holes, np.nan, base)


@pytest.mark.parametrize("kind", ["usual", "far", "regimes", "constant", "empty column"])
def test_correlations_of_pairs(spark, kind):
    values = data(kind, np.random.default_rng(4))
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in values]
    got = {(r["left"], r["right"]): r for r in comoments(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in NAMES)).repartition(7), NAMES).collect()}
    want = plain(values)
    assert set(got) == set(want)
    for pair, (n, r) in want.items():
        g = got[pair]
        assert g.n == n
        if r is None:
            assert g.xx == 0 or g.yy == 0
        else:
            assert g.xy / np.sqrt(g.xx) / np.sqrt(g.yy) == pytest.approx(r, abs=1e-8), pair


def test_merging_is_associative():
    rng = np.random.default_rng(1)
    parts = [_of_batch(list(data(k, rng, n).T)) for k, n in (("usual", 50), ("far", 3), ("constant", 1), ("regimes", 20))]
    left = merged(merged(merged(parts[0], parts[1]), parts[2]), parts[3])
    right = merged(parts[0], merged(parts[1], merged(parts[2], parts[3])))
    np.testing.assert_allclose(left, right, rtol=1e-9)


def test_no_rows(spark):
    assert comoments(spark.createDataFrame([], "a double, b double"), ("a", "b")).collect() == []
    (one,) = comoments(spark.createDataFrame([(1.0, None)], "a double, b double"), ("a", "b")).collect()
    assert one.n == 0


def test_ranks(spark):
    rnd, t0 = random.Random(3), datetime(2026, 1, 5)
    rows = [(s, t0 + timedelta(minutes=m), k) for s, n in (("a", 300), ("b", 1), (None, 40)) for k, m in enumerate(rnd.sample(range(20_000), n))] + [("c", None, 1), ("c", t0, 2), ("c", t0, 3)]
    df = spark.createDataFrame(rows, "symbol string, at timestamp_ntz, k int").repartition(5)
    got = ranked(df, "at").collect()
    sizes = Counter(r[0] for r in rows)
    assert len(got) == len(rows) and all(r.n == sizes[r.symbol] for r in got)
    for s in sizes:
        own = sorted((r for r in got if r.symbol == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        times = [r["at"] or datetime.min for r in own]
        assert times == sorted(times)
