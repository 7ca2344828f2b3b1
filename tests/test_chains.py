"""Greedy choice by pointer doubling against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import UTC, ContractError, SignalReplay
from tidemark.operators import chains, signal_replay

DAY = chains.BUCKET


def greedy(rows):
    until, out = {}, set()
    for symbol, at, end in sorted(rows, key=lambda r: (r[0], r[1])):
        if until.get(symbol, at) <= at:
            out.add((symbol, at))
            if end is not None:
                until[symbol] = end
    return out


def cases():
    rnd = random.Random(4)
    yield "scattered", [(s, at, at + rnd.randint(1, DAY)) for s in "ab" for at in rnd.sample(range(-5 * DAY, 30 * DAY), 150)]
    yield "one long run", [("a", k * 1000, k * 1000 + 1001) for k in range(700)]  # every end lies behind the next begin: no root but the first
    yield "touching", [("a", k * 1000, k * 1000 + 1000) for k in range(300)]
    yield "one holds all", [("a", 0, 40 * DAY), *[("a", k * DAY + 5, k * DAY + 9) for k in range(60)]]
    yield "never ends", [("a", k * 10, None if k % 7 == 3 else k * 10 + rnd.choice([5, 10, 15, 2 * DAY])) for k in range(200)]
    yield "dense", [("a", at, at + rnd.randint(1, 3 * DAY)) for at in rnd.sample(range(20 * DAY), 400)]
    yield "single", [("a", 7, 8)]


@pytest.mark.parametrize(("name", "rows"), list(cases()), ids=[n for n, _ in cases()])
def test_greedy_choice(spark, name, rows):
    df = spark.createDataFrame(rows, "symbol string, at long, end long").repartition(3)
    got = [tuple(r) for r in chains.chosen(df).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_no_candidates(spark):
    assert chains.chosen(spark.createDataFrame([], "symbol string, at long, end long")).collect() == []


def test_window_helpers(spark):
    rnd = random.Random(2)
    rows = [(s, rnd.randint(-40, 40), rnd.choice([None, rnd.randint(0, 99)])) for s in "ab" for _ in range(80)]
    df = spark.createDataFrame(rows, "symbol string, at long, v long")
    got = chains.before(df, "at", {"m": F.col("v")}, span=7).collect()
    want = sorted((s, at, v if v is not None else -1, max((w for t, b, w in rows if t == s and b < at and w is not None), default=-1)) for s, at, v in rows)
    assert sorted((r.symbol, r.at, r.v if r.v is not None else -1, r.m if r.m is not None else -1) for r in got) == want
    got = chains.after(df, "at", {"m": F.col("v"), "n": F.when(F.col("v") > 50, F.col("v"))}, span=7).collect()
    least = lambda s, at, low: min((w for t, b, w in rows if t == s and b > at and w is not None and w > low), default=-1)
    want = sorted((s, at, -1 if v is None else v, least(s, at, -1), least(s, at, 50)) for s, at, v in rows)
    assert sorted((r.symbol, r.at, *(-1 if x is None else x for x in (r.v, r.m, r.n))) for r in got) == want
    got = chains.next_at(df, "at", "v", "n", span=7).collect()
    want = sorted((s, at, -1 if v is None else v, -99 if v is None else min((b for t, b, _ in rows if t == s and b >= v), default=-99)) for s, at, v in rows)
    assert sorted((r.symbol, r.at, -1 if r.v is None else r.v, -99 if r.n is None else r.n) for r in got) == want


def plain(rows):
    """The loop over one series: (at, result, end) in order."""
    until, stuck, out = None, False, []
    for at, result, end in sorted(rows, key=lambda r: r[0]):
        if stuck or (until is not None and until > at):
            out.append((at, "position_open_at_decision"))
            continue
        out.append((at, result))
        if result == "trade":
            until = end
        stuck = stuck or result in signal_replay.OPEN_REASONS
    return out


@pytest.mark.parametrize("stuck", [0, 0.01, 0.2])
def test_outcomes(spark, stuck):
    rnd, t0 = random.Random(int(100 * stuck)), datetime(2024, 1, 1)
    rows = []
    for minute in rnd.sample(range(0, 6000, 5), 500):
        at = t0 + timedelta(minutes=minute)
        result = rnd.choice(signal_replay.OPEN_REASONS) if rnd.random() < stuck else rnd.choice(["trade", "trade", "no_entry_quote_after_decision", "entry_quote_exceeds_max_delay"])
        rows.append((at, result, at + timedelta(minutes=rnd.choice([5, 12, 60, 61, 130])) if result != "no_entry_quote_after_decision" else None))
    df = spark.createDataFrame([("S", f"s{k}", at, result, (end,)) for k, (at, result, end) in enumerate(rows)], "symbol string, signal_id string, decision_time timestamp_ntz, result string, end struct<time: timestamp_ntz>")
    got = sorted((r.decision_time, r.outcome) for r in signal_replay.outcomes(df).collect())
    assert got == plain(rows)


def test_check(spark):
    t0 = datetime(2024, 1, 1)
    hour = timedelta(hours=1)
    signal = ("S", "a", t0, t0 + hour, 0.9, "UP", "long")
    tick = ("S", 1, t0, 1.0, 1.1)
    config = SignalReplay(period_start=t0.replace(tzinfo=UTC), period_end=(t0 + 2 * hour).replace(tzinfo=UTC))

    def run(signals, ticks, config=SignalReplay()):  # noqa: B008
        s = spark.createDataFrame(signals, "symbol string, signal_id string, decision_time timestamp_ntz, target_time timestamp_ntz, p_up double, target_label string, side string")
        t = spark.createDataFrame(ticks, "symbol string, source_seq long, time timestamp_ntz, bid double, ask double")
        signal_replay.check(s, t, config)

    run([signal], [tick])
    run([signal], [tick], config)
    change = lambda row, k, v: (*row[:k], v, *row[k + 1 :])
    for signals, ticks in (
        ([], [tick]), ([signal], []), ([signal, change(signal, 1, "b")], [tick]), ([change(signal, 3, t0)], [tick]), ([change(signal, 6, "flat")], [tick]), ([change(signal, 4, 0.2)], [tick]),
        ([change(signal, 2, None)], [tick]), ([signal], [change(tick, 3, None)]), ([signal], [change(tick, 4, 0.5)]), ([signal], [change(tick, 3, -1.0)]),
        ([signal, change(signal, 2, t0 + 3 * hour)], [tick]), ([signal], [tick, change(tick, 2, t0 - hour)]),
    ):
        with pytest.raises(ContractError):
            run(signals, ticks, config)
