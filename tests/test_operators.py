"""Operators on small made-up tables: the reference cases, edges and metamorphic checks."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.contracts import UTC, AccountScope, BarRequest, ContractError, DecisionReplay, SignalReplay
from tidemark.operators import bars, curves, deals, decision_replay, features, learning, neural, signal_replay, target
from tidemark.streaming.replay import Machine

T0 = datetime(2026, 1, 5)
HOUR = timedelta(hours=1)
BAR = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, tick_volume double, spread double, real_volume double"


def make_bars(spark, closes, times=None, **changes):
    rows = []
    for k, c in enumerate(closes):
        c = float(c)
        row = {"symbol": "S", "timestamp": times[k] if times else T0 + k * HOUR, "open": c, "high": c + 1, "low": c - 1, "close": c, "tick_volume": 100.0 + 5 * (k % 10), "spread": 1.0, "real_volume": 0.0}
        rows.append(tuple((row | changes.get(f"at{k}", {})).values()))
    return spark.createDataFrame(rows, BAR)


def request(**changes):
    at = datetime(2026, 1, 5, 8, tzinfo=UTC)
    return BarRequest(**({"symbol": "S", "start": at, "end": at + 4 * HOUR, "cutoff": at + 4 * HOUR} | changes))


def test_requests():
    assert request().last_required_open == datetime(2026, 1, 5, 11, tzinfo=UTC)
    assert request(cutoff=datetime(2026, 1, 5, 11, 30, tzinfo=UTC)).last_required_open == datetime(2026, 1, 5, 10, tzinfo=UTC)
    for bad in ({"symbol": " "}, {"start": datetime(2026, 1, 5, 8, 30, tzinfo=UTC)}, {"start": datetime(2026, 1, 5, 8)}, {"end": datetime(2026, 1, 5, 8, tzinfo=UTC)}, {"timeframe": "M1"}):
        with pytest.raises(ContractError):
            request(**bad)
    with pytest.raises(ContractError):
        AccountScope("1", "server", trade_mode="real")
    with pytest.raises(ContractError):
        SignalReplay(lower_threshold=Decimal("0.6"))


def test_direction(spark):
    got = [tuple(r)[2:] for r in target.direction(make_bars(spark, [100.0, 101, 100, 100, 102])).orderBy("decision_timestamp").select("symbol", "target_timestamp", "target_h1_direction", F.round("future_return_1h", 8)).collect()]
    assert [x[0] for x in got] == ["UP", "DOWN", "ZERO", "UP", None]
    assert got[0][1] == 0.01
    times = [T0, T0 + HOUR, T0 + 48 * HOUR, T0 + 49 * HOUR]
    gap = target.direction(make_bars(spark, [1.0, 2, 3, 4], times)).orderBy("decision_timestamp").collect()
    assert [r.target_h1_direction for r in gap] == ["UP", "GAP", "UP", None]
    assert gap[1].future_return_1h is None
    zero = target.direction(make_bars(spark, [0.0, 2, 3])).orderBy("decision_timestamp").collect()
    assert zero[0].target_h1_direction is None


def test_features_look_back_only(spark):
    closes = [100 + 0.1 * t + math.sin(t / 3) for t in range(48)]
    before = features.build(make_bars(spark, closes)).orderBy("timestamp").collect()
    closes[31] *= 2
    after = features.build(make_bars(spark, closes)).orderBy("timestamp").collect()
    assert before[:31] == after[:31]
    assert before[31] != after[31]
    assert before[0].return_1h is None
    assert before[22].relative_tick_volume_24h is None and before[23].relative_tick_volume_24h is not None
    assert before[23].return_24h is None and before[24].return_24h is not None
    assert before[5].rolling_vol_6h is None and before[6].rolling_vol_6h is not None


def test_features_reset_at_gaps(spark):
    times = [T0 + (k + (48 if k >= 20 else 0)) * HOUR for k in range(48)]
    got = features.build(make_bars(spark, [100.0 + k for k in range(48)], times)).orderBy("timestamp").collect()
    assert got[22].return_3h is None and got[23].return_3h is not None
    assert got[25].rolling_vol_6h is None and got[26].rolling_vol_6h is not None


def test_correlation_of_a_constant_is_left_out(spark):
    built = features.build(make_bars(spark, [5.0] * 60))
    assert features.correlations(built).filter("left = 'return_1h' OR right = 'return_1h'").count() == 0


def test_audit(spark):
    good = make_bars(spark, [10.0, 11, 12, 13])
    assert bars.audit(good).count() == 0
    assert bars.validate_snapshot(good) is good
    bad = make_bars(
        spark, [10.0, 11, 12, 13, 14], [T0, T0, T0 + HOUR, T0 + 5 * HOUR, None],
        at0={"high": 1.0}, at1={"tick_volume": -1.0}, at2={"close": float("nan")}, at3={"open": float("inf")},
    )
    found = {r.code: r.rows for r in bars.audit(bad).collect()}
    assert found == {"duplicate_opening_time": 2, "ohlc_contradiction": 1, "negative_nonnegative_field": 1, "invalid_numeric_value": 2, "invalid_timestamp": 1, "unclassified_gap": 1}
    with pytest.raises(ContractError):
        bars.validate_snapshot(bad)
    shuffled = make_bars(spark, [10.0, 11, 12], [T0 + HOUR, T0, T0 + 2 * HOUR]).withColumn("row", F.monotonically_increasing_id())
    assert [r.code for r in bars.audit(shuffled, "row").collect()] == ["timestamp_not_ordered"]
    assert bars.audit(good.drop("close")).first().code == "missing_columns"


def test_time_policy(spark):
    at = datetime(2026, 1, 5, 7)
    raw = make_bars(spark, [10.0] * 7, [at + k * HOUR for k in range(6)] + [None])
    late = request(cutoff=datetime(2026, 1, 5, 11, 30, tzinfo=UTC))
    assert bars.time_policy(raw, late).count() == 3
    counts = bars.exclusions(raw, late).first()
    assert tuple(counts) == (1, 1, 1, 2)
    cover = bars.coverage(raw, late).first()
    assert cover.covers_start and cover.covers_end
    empty = bars.coverage(raw.limit(0), late).first()
    assert not empty.covers_start and not empty.covers_end


def test_split_purges_labels_over_boundaries(spark):
    rows = [("S", T0 + k * HOUR, T0 + (k + 1) * HOUR, "UP" if k % 2 else "DOWN", 0.1 * (-1) ** k) for k in range(20)]
    frame = spark.createDataFrame(rows, "symbol string, decision_timestamp timestamp_ntz, target_timestamp timestamp_ntz, target_h1_direction string, return_1h double")
    parts = learning.check_split(learning.split(frame))
    assert {r.partition: r["count"] for r in parts.groupBy("partition").count().collect()} == {"train": 11, "purged_train": 1, "validation": 3, "purged_validation": 1, "test": 4}
    assert learning.majority(parts).first().majority_label == "DOWN"
    with pytest.raises(ContractError):
        learning.check_split(learning.split(frame.limit(9)))
    tie = learning.majority(learning.split(frame).filter("decision_timestamp < '2026-01-05 10:00:00'"))
    assert tie.first().majority_label == "DOWN"


def test_metrics_edges(spark):
    one = spark.createDataFrame([("UP", "UP"), ("UP", "DOWN")], "t string, p string")
    got = learning.metrics(one, "t", "p").first()
    assert (got.accuracy, got.balanced_accuracy, got.mcc) == (0.5, 0.5, 0.0)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [3.0, 0.5] + [1.0, -2.0]
    y = (x[:, 0] - x[:, 1] + rng.normal(size=200) > 3).astype(float)
    rows = [("S", "train" if k < 150 else "validation", "UP" if v else "DOWN", float(a), float(b)) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "symbol string, partition string, target_h1_direction string, a double, b double")
    got = [r.b2_logistic for r in learning.logistic(frame, ("a", "b"))(frame).collect()]
    z = np.c_[(x - x[:150].mean(0)) / x[:150].std(0), np.ones(200)]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[:150] @ w))
        grad = z[:150].T @ (p - y[:150]) + np.r_[w[:2], 0]
        w -= np.linalg.solve((z[:150] * (p * (1 - p))[:, None]).T @ z[:150] + np.diag([1, 1, 0]), grad)
    assert got == ["UP" if v > 0 else "DOWN" for v in z @ w]


def test_deals(spark):
    start, end = datetime(2026, 10, 17, tzinfo=UTC), datetime(2026, 10, 18, tzinfo=UTC)
    ms = int(start.timestamp() * 1000)
    day = 86_400_000
    schema = "ticket long, time long, time_msc long, type int, symbol string, profit decimal(20,8), commission decimal(20,8), swap decimal(20,8), fee decimal(20,8)"
    row = lambda t, at, kind, *money: (t, at // 1000, at, kind, "EURUSD", *[Decimal(m) for m in money])
    rows = [
        row(1, ms, 0, "0", "-2.5", "0", "-0.1"), row(2, ms + day - 1, 1, "10", "-2.5", "0.25", "-0.1"), row(3, ms - 1, 0, "7", "0", "0", "0"), row(4, ms + day, 1, "7", "0", "0", "0"),
        row(5, ms + 5, 2, "100", "0", "0", "0"), row(6, ms + 6, 99, "1", "0", "0", "0"),
    ]
    parts = deals.partitioned(deals.checked(spark.createDataFrame(rows, schema)), start, end)
    total = deals.reconciliation(parts).first()
    assert (total.trades, total.other_operations, total.outside_interval, total.unknown_types, total.balanced) == (2, 2, 2, 1, True)
    assert deals.daily(parts).first().subtotal == Decimal("5.05")
    assert {r.type_label for r in deals.other_operations(parts).collect()} == {"BALANCE", "UNKNOWN_TYPE_99"}
    assert deals.reconciliation(parts.limit(0)).first().subtotal == 0
    for bad in (row(1, ms, 0, "0", "0", "0", "0"), row(0, ms, 0, "0", "0", "0", "0"), (9, 1, ms, 0, "X", *[Decimal(0)] * 4), (9, ms // 1000, ms, 0, "X", None, *[Decimal(0)] * 3)):
        with pytest.raises(ContractError):
            deals.checked(spark.createDataFrame([*rows, bad], schema))
    negative = spark.createDataFrame([(-1,)], "ms long").select(F.expr("floor(ms / 1000)")).first()[0]
    assert negative == -1
    scoped = spark.createDataFrame(rows, schema).withColumn("account_login", F.when(F.col("ticket") == 2, "other").otherwise("me"))
    assert [r.ticket for r in deals.in_scope(scoped, {"account_login": "me", "absent": "x"}).collect()] == [2]


TICK = "symbol string, time timestamp_ntz, source_seq long, bid decimal(18,8), ask decimal(18,8)"
DECISION = "symbol string, signal_id string, decision_time timestamp_ntz, action string"
PERIOD = {"period_start": datetime(2026, 1, 5, tzinfo=UTC), "period_end": datetime(2026, 1, 7, tzinfo=UTC)}


def quotes(spark, rows, symbol="S"):
    return spark.createDataFrame([(symbol, T0 + timedelta(seconds=s), k, Decimal(b), Decimal(a)) for k, (s, b, a) in enumerate(rows)], TICK)


def test_decision_replay_reference_case(spark):
    ticks = quotes(spark, [(s, "1.10000", "1.10020") for s in (0, 1, 1800, 2700, 3600, 3601)])
    asked = spark.createDataFrame([("S", "a", T0, "long"), ("S", "b", T0 + timedelta(minutes=30), "long"), ("S", "c", T0 + timedelta(minutes=45), "ABSTAIN")], DECISION)
    config = DecisionReplay(**PERIOD)
    decision_replay.check(asked, ticks, config)
    got = decision_replay.replay(asked, ticks, config)
    (p,) = got.positions.collect()
    assert (p.entry_source_seq, p.exit_source_seq, p.exit_reason, p.quote_pnl, p.balance_after) == (1, 4, "target", Decimal("-20.00"), Decimal("9980.00"))
    assert [r.disposition for r in got.actions.orderBy("decision_time").collect()] == ["entered", "same_side_noop", "abstain_hold"]
    events = [(r.event, r.value) for r in got.equity.orderBy("time", "seq", "sub").collect()]
    assert events == [("initial_balance", 10000), ("position_open_mark", 9980), ("quote_mark", 9980), ("quote_mark", 9980), ("target", 9980), ("period_end_flat", 9980)]
    m = got.metrics.first()
    assert (m.closed_positions, m.open_at_period_end, m.realized_balance, m.maximum_drawdown) == (1, False, 9980.0, 20.0)


def test_decision_replay_conflict(spark):
    asked = spark.createDataFrame([("S", "a", T0, "long"), ("S", "b", T0 + timedelta(seconds=5), "ABSTAIN")], DECISION)
    with pytest.raises(Exception, match="before the last intent"):
        decision_replay.replay(asked, quotes(spark, [(0, "1", "1.1"), (9, "1", "1.1")]), DecisionReplay(**PERIOD)).positions.collect()


def test_decision_replay_against_an_event_loop(spark):
    """Random series with ties, gaps, reversals, unfilled entries and open ends, all in one run."""
    rng, all_ticks, all_asked, want = random.Random(11), [], [], {}
    for n in range(150):
        symbol = f"S{n:03}"
        times = sorted(rng.choices(range(0, 40_000, rng.choice([1, 30, 600])), k=rng.randint(2, 40)))
        ticks = [(symbol, T0 + timedelta(seconds=s), k, Decimal(rng.randint(100, 140)) / 100) for k, s in enumerate(times)]
        ticks = [(*t, t[3] + Decimal("0.02")) for t in ticks]
        asked = [(symbol, f"{symbol}-{s}", T0 + timedelta(seconds=s), rng.choice(["long", "short", "ABSTAIN"])) for s in sorted(rng.sample(range(0, 40_000, 200), k=rng.randint(1, 8)))]
        us = lambda t: int((t - T0).total_seconds()) * 1_000_000
        merged = sorted([(us(t[1]), 0, t[2], t[3], t[4], None, None) for t in ticks] + [(us(d[2]), 1, 0, None, None, d[1], d[3]) for d in asked])
        machine = Machine(900 * 1_000_000)
        try:
            want[symbol] = [e for row in merged for e in machine.feed(*row)]
        except ContractError:
            continue
        all_ticks += ticks
        all_asked += asked
    got = decision_replay.replay(spark.createDataFrame(all_asked, DECISION), spark.createDataFrame(all_ticks, TICK), DecisionReplay(**PERIOD, max_entry_delay=900))
    rows = got.equity.filter("event NOT IN ('initial_balance', 'period_end_flat')").collect()
    mine = sorted((r.symbol, int((r.time - T0).total_seconds()) * 1_000_000, r.seq, r.sub, r.event, r.signal_id, r.value) for r in rows)
    assert len(want) > 60
    assert {e[2] for w in want.values() for e in w} == {"position_open_mark", "quote_mark", "target", "reversal"}
    assert [(x[0], x[1], x[2], *x[4:]) for x in mine] == [(s, *e) for s in sorted(want) for e in want[s]]


def test_decision_replay_of_one_long_series(spark):
    """Five days of one series, more buckets than one and runs of many steps between two roots."""
    rng, us = random.Random(3), lambda t: int((t - T0).total_seconds()) * 1_000_000
    seconds = [k for k in range(432_000) if rng.random() < 1 / 40]
    ticks = [("S", T0 + timedelta(seconds=s), k, Decimal(rng.randint(100, 140)) / 100) for k, s in enumerate(seconds)]
    ticks = [(*t, t[3] + Decimal("0.02")) for t in ticks]
    asked = [("S", f"d{s}", T0 + timedelta(seconds=s), rng.choice(["long", "long", "short", "ABSTAIN"])) for s in range(0, 430_000, 900)]
    merged = sorted([(us(t[1]), 0, t[2], t[3], t[4], None, None) for t in ticks] + [(us(d[2]), 1, 0, None, None, d[1], d[3]) for d in asked])
    machine = Machine(60 * 1_000_000)
    want = [e for row in merged for e in machine.feed(*row)]
    got = decision_replay.replay(spark.createDataFrame(asked, DECISION), spark.createDataFrame(ticks, TICK), DecisionReplay(T0.replace(tzinfo=UTC), (T0 + timedelta(days=9)).replace(tzinfo=UTC)))
    rows = got.equity.filter("event NOT IN ('initial_balance', 'period_end_flat')").orderBy("time", "seq", "sub").collect()
    assert [(us(r.time), r.seq, r.event, r.signal_id, r.value) for r in rows] == want
    assert {"reversal", "target"} <= {e[2] for e in want} and len({e[3] for e in want}) > 150


def test_signal_replay_by_hand(spark):
    ticks = quotes(spark, [(5, "1.1000", "1.1002"), (1800, "1.1010", "1.1012"), (3605, "1.1020", "1.1022"), (7300, "1.1000", "1.1002"), (100_000, "1.2", "1.2")])
    schema = "symbol string, signal_id string, decision_time timestamp_ntz, target_time timestamp_ntz, side string, target_label string"
    rows = [("S", f"x{k}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s) + HOUR, side, "UP") for k, (s, side) in enumerate([(0, "long"), (1800, "short"), (3605, "short"), (7290, "long"), (90_000, "long")])]
    signals = spark.createDataFrame(rows, schema)
    config = SignalReplay(max_entry_delay=5000)
    got = signal_replay.replay(signals, ticks, config)
    reasons = {r.signal_id: r.outcome for r in got.outcomes.collect()}
    assert reasons == {"x0": "trade", "x1": "position_open_at_decision", "x2": "no_entry_quote_before_target", "x3": "exit_quote_exceeds_max_delay", "x4": "position_open_at_decision"}
    (t,) = got.trades.collect()
    assert (t.quote_pnl, t.midpoint_pnl, t.spread_cost) == (Decimal("180"), Decimal("200"), Decimal("20"))
    assert t.net_pnl == Decimal("180") - Decimal("9.5") and t.prediction_correct
    (o,) = got.open_positions.collect()
    assert o.last_ask == Decimal("1.2") and o.unrealized_pnl == Decimal("9980") - Decimal("9.5") - Decimal("7.2")
    assert [r.event for r in got.equity.orderBy("time", "seq").collect()] == ["initial_balance", "quote_mark", "quote_mark", "trade_exit", "quote_mark", "quote_mark"]


def curve(spark, values):
    return spark.createDataFrame([("S", T0 + k * HOUR, k, 0, float(v)) for k, v in enumerate(values)], "symbol string, time timestamp_ntz, seq long, sub int, value double")


def test_drawdown(spark):
    d = curves.drawdown(curve(spark, [100, 120, 90, 120, 90, 130])).first()
    assert (d.maximum_drawdown, d.maximum_drawdown_pct, d.peak_time, d.trough_time, d.recovery_time) == (30, 25, T0 + HOUR, T0 + 2 * HOUR, T0 + 3 * HOUR)
    d = curves.drawdown(curve(spark, [100, 80, 90] * 10)).first()
    assert (d.recovered, d.peak_to_trough_seconds, d.recovery_time) == (True, 3600, T0 + 3 * HOUR)
    d = curves.drawdown(curve(spark, [5, 4, 3])).first()
    assert (d.recovered, d.unrecovered_seconds_at_end) == (False, 7200)
    assert curves.drawdown(curve(spark, [1, 2, 2])).first().maximum_drawdown is None
    gaps = curves.spacing(curve(spark, range(50))).first()
    assert (gaps.observation_count, gaps.median_spacing_seconds, gaps.maximum_gap_seconds, gaps.gaps_over_limit) == (50, 3600, 3600, 49)


def test_trade_summaries(spark):
    rows = [("S", T0 + k * HOUR, "long", Decimal(v)) for k, v in enumerate([5, -1, -2, 0, -3, 4])]
    trades = spark.createDataFrame(rows, "symbol string, exit_time timestamp_ntz, side string, net_pnl decimal(31,10)")
    s = curves.trade_summary(trades).first()
    assert (s.wins, s.losses, s.profit_factor, s.profit_factor_status) == (2, 3, 1.5, "defined")
    assert curves.losing_streaks(trades).first().max_consecutive_losses == 2
    assert curves.trade_summary(trades.filter("net_pnl > 0")).first().profit_factor_status == "no_gross_losses"
    sides = {r.side: r.closed_trades for r in curves.side_summary(trades).collect()}
    assert sides == {"long": 6, "short": 0}


def test_network():
    x = np.linspace(-1, 1, 40)[:, None]
    y = np.sin(3 * x)
    net = neural.Network()
    assert net.gradient_error(x, y) < 1e-7
    first = net.loss(x, y)
    assert list(net.fit(x, y))[-1] == 400
    assert net.loss(x, y) < first / 20
