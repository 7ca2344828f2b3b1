"""Curve summaries merged from days, and exact quantiles, against plain versions."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

from tidemark.operators import curves
from tidemark.operators.quantiles import quantiles

T0 = datetime(2026, 1, 5)
CURVE = "symbol string, time timestamp_ntz, seq long, sub int, value decimal(20,2)"


def falls(points):
    """(fall, peak time, trough time, recovery time) of [(time, seq, sub, value)] in order."""
    peak, peak_time, best = points[0][3], points[0][0], None
    for time, _, _, value in points:
        if value > peak:
            peak, peak_time = value, time
        if peak - value > 0 and (best is None or peak - value > best[0]):
            best = (peak - value, peak_time, time, peak)
    if not best:
        return None, None, None, None
    return (*best[:3], next((p[0] for p in points if p[0] > best[2] and p[3] >= best[3]), None))


def curve_of(rnd, kind):
    times = sorted(rnd.choices(range(0, 6 * 86_400, rnd.choice([1, 3600, 20_000])), k=rnd.randint(1, 40)))
    value, out = 100, []
    for k, s in enumerate(times):
        value = {"walk": value + rnd.randint(-3, 3), "flat": value, "up": value + rnd.randint(0, 1), "few": rnd.randint(0, 3), "down": value - rnd.randint(0, 2)}[kind]
        out.append((T0 + timedelta(seconds=s), k, 0, Decimal(value)))
    return out


def test_drawdown_and_spacing_of_random_curves(spark):
    rnd = random.Random(8)
    series = {f"S{n:03}": curve_of(rnd, rnd.choice(["walk", "walk", "few", "flat", "up", "down"])) for n in range(400)}
    rows = [(s, *p) for s, points in series.items() for p in points]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, CURVE)
    got = {r.symbol: (r.maximum_drawdown, r.peak_time, r.trough_time, r.recovery_time) for r in curves.drawdown(df).collect()}
    assert got == {s: falls(p) for s, p in series.items()}
    assert sum(x[3] is not None for x in got.values()) > 40 and sum(x[0] is not None and x[1].date() != x[2].date() for x in got.values()) > 40
    want = {}
    for s, p in series.items():
        gaps = [int((b[0] - a[0]).total_seconds()) for a, b in zip(p, p[1:], strict=False)]
        want[s] = (len(p), float(np.median(gaps)) if gaps else None, max(gaps, default=0), sum(g > 60 for g in gaps))
    assert {r.symbol: (r.observation_count, r.median_spacing_seconds, r.maximum_gap_seconds, r.gaps_over_limit) for r in curves.spacing(df).collect()} == want
    assert curves.drawdown(df.limit(0)).collect() == curves.spacing(df.limit(0)).collect() == []


def test_a_curve_is_read_once(spark):
    plan = curves.drawdown(spark.createDataFrame([("S", T0, 1, 0, Decimal(1))], CURVE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "InMemoryRelation" not in plan


def test_losing_streaks_over_days(spark):
    rnd, rows, want = random.Random(6), [], {}
    for n in range(200):
        seconds, p = sorted(rnd.sample(range(0, 5 * 86_400, 600), rnd.randint(1, 60))), rnd.choice([0.3, 0.9, 1.0])
        results = [Decimal(-1) if rnd.random() < p else Decimal(rnd.choice([0, 2])) for _ in seconds]
        rows += [(f"S{n}", T0 + timedelta(seconds=s), x) for s, x in zip(seconds, results, strict=True)]
        best = run = 0
        for x in results:
            run = run + 1 if x < 0 else 0
            best = max(best, run)
        want[f"S{n}"] = best
    rnd.shuffle(rows)
    got = curves.losing_streaks(spark.createDataFrame(rows, "symbol string, exit_time timestamp_ntz, net_pnl decimal(20,2)"))
    assert {r.symbol: r.max_consecutive_losses for r in got.collect()} == want


SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize(("few", "parts"), [(10_000, 64), (100, 16), (5, 4)])
def test_quantiles(spark, few, parts):
    rng = np.random.default_rng(few)
    series = {
        "normal": rng.normal(size=3001), "tail": np.exp(rng.normal(size=2000) * 20), "equal": np.full(500, 7.25), "two": np.repeat([1.0, 2.0], [3, 700]), "one": np.array([3.0]),
        "wide": np.concatenate([rng.normal(size=300), [1e308, -1e308]]), "near": 1.0 + rng.integers(0, 50, 1000) * 2.0**-52, "zeros": np.array([0.0, -0.0, 0.0, 5e-324]),
    }
    rows = [(s, float(x)) for s, xs in series.items() for x in xs] + [("normal", None), ("nothing", None)]
    got = {r.symbol: (r.n, r.quantiles) for r in quantiles(spark.createDataFrame(rows, "symbol string, x double").repartition(5), SHARES, few, parts).collect()}
    assert set(got) == set(series)
    for s, xs in series.items():
        assert got[s][0] == len(xs)
        np.testing.assert_allclose(got[s][1], np.quantile(xs, SHARES), rtol=1e-12, atol=1e-300, err_msg=s)


def test_weighted_quantiles(spark):
    rnd = random.Random(1)
    rows = [("a", float(rnd.randint(0, 30)), rnd.randint(0, 9)) for _ in range(100)]
    flat = [x for _, x, n in rows for _ in range(n)]
    got = quantiles(spark.createDataFrame(rows, "symbol string, x double, n long"), SHARES, few=5, parts=3).first()
    assert got.n == len(flat)
    np.testing.assert_allclose(got.quantiles, np.quantile(flat, SHARES))
