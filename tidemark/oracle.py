"""The registered queries in DuckDB's SQL, written on their own from the contracts."""

from __future__ import annotations

from itertools import combinations

from tidemark.operators.features import CANDIDATES, RETURNS, SELECTED, VOLATILITIES

_W = "(PARTITION BY symbol ORDER BY ts)"
_TABLES: dict[str, str] = {}
_USES: dict[str, tuple[str, ...]] = {}


def _table(name: str, sql: str, *uses: str) -> None:
    _TABLES[name], _USES[name] = sql, uses


def _with(sql: str, *uses: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for x in _USES[name]:
            visit(x)
        if name not in order:
            order.append(name)

    for x in uses:
        visit(x)
    word = "WITH RECURSIVE" if any("RECURSIVE_" in _TABLES[x] for x in order) else "WITH"
    body = ", ".join(f"{x} AS ({_TABLES[x].replace('RECURSIVE_', '')})" for x in order)
    return f"{word} {body} {sql}"


_BAR = "arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, e.ts) AS close, count(*) AS tick_volume, 0::BIGINT AS spread, 0::BIGINT AS real_volume"
_table("bars", f"SELECT event_type AS symbol, date_trunc('hour', e.ts) AS ts, {_BAR} FROM events e GROUP BY 1, 2")
_table("allbars", f"SELECT 'ALL' AS symbol, date_trunc('hour', e.ts) AS ts, {_BAR} FROM events e GROUP BY 1, 2")
_table(
    "segs",
    f"SELECT *, sum(CASE WHEN b IS NULL OR ts <> b + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER {_W} AS segment_id FROM (SELECT *, lag(ts) OVER {_W} AS b FROM bars)",
    "bars",
)
_table(
    "target",
    f"""SELECT symbol, ts AS decision_timestamp, nt AS target_timestamp,
 CASE WHEN nt = ts + INTERVAL 1 HOUR THEN nc / nullif(close, 0) - 1 END AS future_return_1h,
 CASE WHEN nt IS NULL THEN NULL WHEN nt <> ts + INTERVAL 1 HOUR THEN 'GAP' WHEN nc / nullif(close, 0) - 1 > 0 THEN 'UP'
  WHEN nc / nullif(close, 0) - 1 < 0 THEN 'DOWN' WHEN nc / nullif(close, 0) - 1 = 0 THEN 'ZERO' END AS target_h1_direction
 FROM (SELECT *, lead(ts) OVER {_W} AS nt, lead(close) OVER {_W} AS nc FROM bars)""",
    "bars",
)
_S = "PARTITION BY symbol, segment_id ORDER BY ts"
_table(
    "rets", "SELECT *, " + ", ".join(f"close / nullif(lag(close, {k}) OVER ({_S}), 0) - 1 AS return_{k}h" for k in RETURNS) + " FROM segs", "segs"
)
_frame = lambda n: f"({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_table(
    "feats",
    "SELECT symbol, ts, segment_id, "
    + ", ".join(f"return_{k}h" for k in RETURNS)
    + ", "
    + ", ".join(f"CASE WHEN count(return_1h) OVER {_frame(k)} = {k} THEN stddev_pop(return_1h) OVER {_frame(k)} END AS rolling_vol_{k}h" for k in VOLATILITIES)
    + f""", (high - low) / nullif(close, 0) AS range_pct, close / nullif(open, 0) - 1 AS body_return,
 CASE WHEN count(tick_volume) OVER {_frame(24)} = 24 THEN tick_volume / nullif(avg(tick_volume) OVER {_frame(24)}, 0) - 1 END AS relative_tick_volume_24h,
 sin(2 * pi() * hour(ts) / 24.0::DOUBLE) AS hour_sin, cos(2 * pi() * hour(ts) / 24.0::DOUBLE) AS hour_cos,
 sin(2 * pi() * (isodow(ts) - 1) / 7.0::DOUBLE) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7.0::DOUBLE) AS dow_cos FROM rets""",
    "rets",
)
_table(
    "matrix",
    f"""SELECT t.symbol, t.decision_timestamp, t.target_timestamp, t.target_h1_direction, {", ".join(f"f.{c}" for c in SELECTED)},
 coalesce(t.target_h1_direction IN ('UP', 'DOWN'), false) AS is_binary, {" AND ".join(f"f.{c} IS NOT NULL" for c in SELECTED)} AS is_complete
 FROM target t JOIN feats f ON f.symbol = t.symbol AND f.ts = t.decision_timestamp""",
    "target",
    "feats",
)
_table(
    "numbered",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY decision_timestamp) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n
 FROM matrix WHERE is_binary AND is_complete""",
    "matrix",
)
_table(
    "parts",
    """SELECT *, CASE WHEN decision_timestamp < v THEN CASE WHEN target_timestamp < v THEN 'train' ELSE 'purged_train' END
 WHEN decision_timestamp < t THEN CASE WHEN target_timestamp < t THEN 'validation' ELSE 'purged_validation' END ELSE 'test' END AS part
 FROM (SELECT *, max(CASE WHEN k = floor(n::DOUBLE * 0.6::DOUBLE) THEN decision_timestamp END) OVER (PARTITION BY symbol) AS v,
 max(CASE WHEN k = floor(n::DOUBLE * 0.8::DOUBLE) THEN decision_timestamp END) OVER (PARTITION BY symbol) AS t FROM numbered)""",
    "numbered",
)
_table(
    "majority",
    """SELECT symbol, target_h1_direction AS majority_label FROM (SELECT symbol, target_h1_direction, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, target_h1_direction) AS r
 FROM parts WHERE part = 'train' GROUP BY 1, 2) WHERE r = 1""",
    "parts",
)
_table(
    "preds",
    """SELECT p.symbol, decision_timestamp, part AS "partition", target_h1_direction AS truth, majority_label AS b0_majority,
 CASE WHEN return_1h > 0 THEN 'UP' WHEN return_1h < 0 THEN 'DOWN' ELSE majority_label END AS b1_persistence
 FROM parts p JOIN majority m ON m.symbol = p.symbol WHERE part IN ('train', 'validation')""",
    "parts",
    "majority",
)
_table(
    "broken0",
    """SELECT symbol, ts, open, CASE WHEN hour(ts) = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN hour(ts) = 5 THEN NULL ELSE close END AS close,
 CASE WHEN hour(ts) = 7 THEN -tick_volume ELSE tick_volume END AS tick_volume FROM bars""",
    "bars",
)
_table("broken", "SELECT * FROM broken0 UNION ALL SELECT * FROM broken0 WHERE hour(ts) = 11", "broken0")
_V = "CAST(value AS DECIMAL(18, 2))"
_table(
    "deals",
    f"""SELECT event_id + 1 AS ticket, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 7 WHEN 'error' THEN 99 END::BIGINT AS type,
 date_trunc('milliseconds', ts) AS time_utc, {_V} - 50 AS profit, {_V} * -0.01 AS commission, {_V} * 0.002 AS swap, -0.2 AS fee FROM events""",
)
_table(
    "dealt",
    """SELECT *, profit + commission + swap + fee AS subtotal, CASE type WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'BALANCE' WHEN 7 THEN 'COMMISSION' ELSE 'UNKNOWN_TYPE_' || type END AS type_label,
 time_utc >= TIMESTAMP '2024-01-05' AND time_utc < TIMESTAMP '2024-01-25' AS in_interval,
 CASE WHEN NOT (time_utc >= TIMESTAMP '2024-01-05' AND time_utc < TIMESTAMP '2024-01-25') THEN 'outside_interval' WHEN type IN (0, 1) THEN 'trade' ELSE 'other_operation' END AS part FROM deals""",
    "deals",
)
_table("ticks", f"SELECT event_id AS seq, ts AS time, {_V} AS bid, {_V} + 0.02 AS ask FROM events")
_table(
    "decisions",
    """SELECT 'd' || strftime(ts, '%Y%m%d%H') AS signal_id, ts + INTERVAL 1 HOUR AS decision_time, ts + INTERVAL 2 HOUR AS target_time,
 CASE WHEN b > 0.05::DOUBLE THEN 'long' WHEN b < -0.05::DOUBLE THEN 'short' ELSE 'ABSTAIN' END AS action, b FROM (SELECT *, close / nullif(open, 0) - 1 AS b FROM allbars)""",
    "allbars",
)
_table(
    "signals",
    """SELECT *, CASE WHEN p <= 0.45 THEN 'short' ELSE 'long' END AS side, CASE WHEN hour(decision_time) % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS target_label
 FROM (SELECT *, round(0.5::DOUBLE + b / (2.0::DOUBLE * (1.0::DOUBLE + abs(b))), 6)::DECIMAL(8, 6) AS p FROM decisions) WHERE p <= 0.45 OR p >= 0.55""",
    "decisions",
)


def _quotes(source: str) -> str:
    return f"""SELECT d.*, e.seq AS es, e.time AS et, e.bid AS eb, e.ask AS ea, x.seq AS xs, x.time AS xt, x.bid AS xb, x.ask AS xa
 FROM {source} d ASOF LEFT JOIN ticks e ON d.decision_time < e.time ASOF LEFT JOIN ticks x ON d.target_time <= x.time"""


def _seconds(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1000000.0::DOUBLE)"


_table(
    "priced",
    f"""SELECT *, row_number() OVER (ORDER BY decision_time) AS rn, CASE WHEN et IS NULL THEN 'no_entry_quote_after_decision' WHEN et >= target_time THEN 'no_entry_quote_before_target'
 WHEN {_seconds("et", "decision_time")} > 900 THEN 'entry_quote_exceeds_max_delay' WHEN xt IS NULL THEN 'no_exit_quote_at_or_after_target'
 WHEN {_seconds("xt", "target_time")} > 9000 THEN 'exit_quote_exceeds_max_delay' ELSE 'trade' END AS result FROM ({_quotes("signals")})""",
    "signals",
    "ticks",
)
_table(
    "greedy",
    """RECURSIVE_SELECT 0::BIGINT AS rn, TIMESTAMP '1970-01-01' AS until, false AS stuck, '' AS outcome
 UNION ALL SELECT p.rn, CASE WHEN NOT (g.stuck OR g.until > p.decision_time) AND p.result = 'trade' THEN p.xt ELSE g.until END,
 g.stuck OR (g.until <= p.decision_time AND p.result IN ('no_exit_quote_at_or_after_target', 'exit_quote_exceeds_max_delay')),
 CASE WHEN g.stuck OR g.until > p.decision_time THEN 'position_open_at_decision' ELSE p.result END FROM greedy g JOIN priced p ON p.rn = g.rn + 1""",
    "priced",
)
_table("outcomes", "SELECT p.*, g.outcome FROM priced p JOIN greedy g ON g.rn = p.rn", "priced", "greedy")


def _roll(a: str, b: str, triple: int = 3) -> str:
    return f"""coalesce(list_sum(list_transform(list_filter(generate_series(date_trunc('day', {a})::TIMESTAMP, date_trunc('day', {b})::TIMESTAMP, INTERVAL 1 DAY),
 lambda g: isodow(g) < 6 AND g + INTERVAL 22 HOUR > {a} AND g + INTERVAL 22 HOUR <= {b}), lambda g: CASE WHEN isodow(g) = 3 THEN {triple} ELSE 1 END)), 0)"""


_table(
    "trades0",
    f"""SELECT *, CASE WHEN side = 'long' THEN xb - ea ELSE eb - xa END * 100000 AS quote_pnl,
 CASE WHEN side = 'long' THEN 1 ELSE -1 END * ((xb + xa) - (eb + ea)) * 50000 AS midpoint_pnl, ((ea - eb) + (xa - xb)) * 50000 AS spread_cost,
 CASE WHEN side = 'long' THEN 7.2 ELSE -2.4 END * {_roll("et", "xt")} AS swap_cost FROM outcomes WHERE outcome = 'trade'""",
    "outcomes",
)
_table(
    "trades",
    """SELECT *, CAST(10000 + sum(net_pnl) OVER (ORDER BY xt) AS DECIMAL(30, 4)) AS balance_after FROM (SELECT *, CAST(quote_pnl - 9.5 - swap_cost AS DECIMAL(30, 4)) AS net_pnl FROM trades0)""",
    "trades0",
)
_table("period", "SELECT min(decision_time) AS a, max(target_time) + INTERVAL 9000 SECOND AS b FROM signals", "signals")
_table("final", "SELECT 10000 + coalesce((SELECT sum(net_pnl) FROM trades), 0) AS v", "trades")
_OPEN = "('no_exit_quote_at_or_after_target', 'exit_quote_exceeds_max_delay')"
_table(
    "opened",
    f"""SELECT o.*, coalesce(o.xt, l.time) AS zt, coalesce(o.xs, l.seq) AS zs FROM outcomes o, (SELECT time, seq FROM ticks ORDER BY time DESC, seq DESC LIMIT 1) l WHERE outcome IN {_OPEN}""",
    "outcomes",
    "ticks",
)
_MARK = f"CASE WHEN side = 'long' THEN t.bid - ea ELSE eb - t.ask END * 100000 - 9.5 - CASE WHEN side = 'long' THEN 7.2 ELSE -2.4 END * {_roll('et', 't.time')}"
_table(
    "equity1",
    f"""SELECT t.time, t.seq, CASE WHEN t.seq = xs THEN 'trade_exit' ELSE 'quote_mark' END AS event, signal_id,
 CAST(CASE WHEN t.seq = xs THEN balance_after ELSE balance_after - net_pnl + {_MARK} END AS DOUBLE) AS value
 FROM trades JOIN ticks t ON (t.time, t.seq) >= (et, es) AND (t.time, t.seq) <= (xt, xs)
 UNION ALL SELECT t.time, t.seq, 'quote_mark', signal_id, CAST((SELECT v FROM final) + {_MARK} AS DOUBLE) FROM opened JOIN ticks t ON (t.time, t.seq) >= (et, es) AND (t.time, t.seq) <= (zt, zs)
 UNION ALL SELECT a, -1, 'initial_balance', '', 10000 FROM period
 UNION ALL SELECT b, 4611686018427387904, 'period_end_flat', '', (SELECT v FROM final)::DOUBLE FROM period WHERE NOT EXISTS (SELECT 1 FROM opened)""",
    "trades",
    "ticks",
    "opened",
    "period",
    "final",
)
_table("followed", "SELECT *, lead(time) OVER (ORDER BY time, seq) AS at, lead(seq) OVER (ORDER BY time, seq) AS \"as\" FROM ticks", "ticks")
_table(
    "asked",
    f"""SELECT q.*, f.at AS aft, f."as" AS afs, row_number() OVER (ORDER BY decision_time) AS rn FROM ({_quotes("decisions")}) q LEFT JOIN followed f ON f.seq = q.es""",
    "decisions",
    "ticks",
    "followed",
)
_HELD = "(g.side IS NOT NULL AND (g.end_t IS NULL OR g.end_t > a.decision_time))"
_OPENS = f"(a.action <> 'ABSTAIN' AND a.et IS NOT NULL AND (({_HELD} AND a.action <> g.side) OR (NOT {_HELD} AND {_seconds('a.et', 'a.decision_time')} <= 900)))"
_LATE = "(a.xt IS NOT NULL AND (a.xt, a.xs) <= (a.et, a.es))"
_table(
    "machine",
    f"""RECURSIVE_SELECT 0::BIGINT AS rn, NULL::VARCHAR AS side, NULL::TIMESTAMP AS end_t, NULL::BIGINT AS end_s, NULL::VARCHAR AS id, ''::VARCHAR AS disposition, 'flat'::VARCHAR AS side_at, false AS opens, NULL::VARCHAR AS closes
 UNION ALL SELECT a.rn, CASE WHEN {_OPENS} THEN a.action WHEN {_HELD} THEN g.side END,
 CASE WHEN {_OPENS} THEN CASE WHEN {_LATE} THEN a.aft ELSE a.xt END WHEN {_HELD} THEN g.end_t END,
 CASE WHEN {_OPENS} THEN CASE WHEN {_LATE} THEN a.afs ELSE a.xs END WHEN {_HELD} THEN g.end_s END,
 CASE WHEN {_OPENS} THEN a.signal_id WHEN {_HELD} THEN g.id END,
 CASE WHEN a.action = 'ABSTAIN' THEN CASE WHEN {_HELD} THEN 'abstain_hold' ELSE 'abstain_while_flat' END
  WHEN {_HELD} AND a.action = g.side THEN 'same_side_noop'
  WHEN {_HELD} THEN CASE WHEN a.et IS NULL THEN 'reversal_queued' ELSE 'reversed_into' END
  WHEN a.et IS NULL THEN 'entry_queued' WHEN {_OPENS} THEN 'entered' ELSE 'entry_unfilled_delay_over_60s' END,
 CASE WHEN {_HELD} THEN g.side ELSE 'flat' END, {_OPENS}, CASE WHEN {_OPENS} AND {_HELD} THEN g.id END
 FROM machine g JOIN asked a ON a.rn = g.rn + 1""",
    "asked",
)
_table(
    "opened2",
    """SELECT a.*, m.closes IS NOT NULL AS reversed, coalesce(r.et, m.end_t) AS zt, coalesce(r.es, m.end_s) AS zs,
 CASE WHEN r.et IS NOT NULL THEN 'reversal' WHEN m.end_t IS NOT NULL THEN 'target' ELSE 'open_at_period_end' END AS reason
 FROM machine m JOIN asked a ON a.rn = m.rn LEFT JOIN (SELECT m2.closes, a2.et, a2.es FROM machine m2 JOIN asked a2 ON a2.rn = m2.rn WHERE m2.closes IS NOT NULL) r ON r.closes = a.signal_id WHERE m.opens""",
    "machine",
    "asked",
)
_table(
    "positions",
    """SELECT *, CAST(10000 + coalesce(sum(quote_pnl) OVER (ORDER BY et, es), 0) AS DECIMAL(30, 2)) AS balance_after FROM (
 SELECT o.*, z.bid AS zb, z.ask AS za, l.time AS lt, l.seq AS ls, CAST(CASE WHEN action = 'long' THEN z.bid - ea ELSE eb - z.ask END * 100000 AS DECIMAL(30, 2)) AS quote_pnl
 FROM opened2 o LEFT JOIN ticks z ON z.seq = o.zs, (SELECT time, seq FROM ticks ORDER BY time DESC, seq DESC LIMIT 1) l)""",
    "opened2",
    "ticks",
)
_table("final2", "SELECT CAST(10000 + coalesce(sum(quote_pnl), 0) AS DOUBLE) AS v, count(zt) AS closed, count(*) - count(zt) AS open FROM positions", "positions")
_table(
    "equity2",
    """SELECT t.time, t.seq, CASE WHEN t.seq = es AND reversed THEN 1 ELSE 0 END::BIGINT AS sub,
 CASE WHEN t.seq = es THEN 'position_open_mark' WHEN t.seq = zs THEN reason ELSE 'quote_mark' END AS event, signal_id,
 CAST(CASE WHEN t.seq = zs AND t.seq <> es THEN balance_after ELSE balance_after - coalesce(quote_pnl, 0) + CASE WHEN action = 'long' THEN t.bid - ea ELSE eb - t.ask END * 100000 END AS DOUBLE) AS value
 FROM positions JOIN ticks t ON (t.time, t.seq) >= (et, es) AND (t.time, t.seq) <= (coalesce(zt, lt), coalesce(zs, ls))
 UNION ALL SELECT TIMESTAMP '2024-01-01', -1, 0, 'initial_balance', '', 10000
 UNION ALL SELECT TIMESTAMP '2024-02-01', 4611686018427387904, 0, 'period_end_flat', '', v FROM final2 WHERE open = 0""",
    "positions",
    "ticks",
    "final2",
)


def _drawdown(curve: str, order: str) -> str:
    return f"""falls AS (SELECT *, max(value) OVER (ORDER BY {order}) AS peak FROM {curve}),
 trough AS (SELECT *, peak - value AS fall FROM falls WHERE peak - value > 0 ORDER BY peak - value DESC, {order} LIMIT 1),
 top AS (SELECT min(f.time) AS pt FROM falls f, trough t WHERE f.value = t.peak AND ({", ".join("f." + c for c in order.split(", "))}) <= ({", ".join("t." + c for c in order.split(", "))})),
 back AS (SELECT min(f.time) AS rt FROM falls f, trough t WHERE f.time > t.time AND f.value >= t.peak)"""


def _rounded(columns: str, places: int = 8) -> str:
    return ", ".join(f"round({c}, {places}) + 0 AS {c}" for c in columns.split())  # + 0: no negative zero


_pairs = list(combinations(CANDIDATES, 2))
_corr = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(abs(corr({a}, {b})), 8) AS r FROM feats" for a, b in _pairs)
_diag = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, 0::BIGINT AS non_finite, min(CASE WHEN {c} IS NOT NULL THEN ts END) AS first_valid, count(DISTINCT round({c}, 6)) AS distinct_values FROM feats"
    for c in CANDIDATES
)


def _metrics(model: str) -> str:
    return f"""SELECT symbol, "partition", tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp)::DOUBLE, 8) AS accuracy,
 round((coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)) / (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END), 8) AS balanced_accuracy,
 round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 8) AS mcc, '{model}' AS model FROM (
 SELECT symbol, "partition", count(*) FILTER (truth = 'DOWN' AND {model} = 'DOWN') AS tn, count(*) FILTER (truth = 'DOWN' AND {model} = 'UP') AS fp,
 count(*) FILTER (truth = 'UP' AND {model} = 'DOWN') AS fn, count(*) FILTER (truth = 'UP' AND {model} = 'UP') AS tp FROM preds GROUP BY 1, 2)"""


_MONEY = ("profit", "commission", "swap", "fee", "subtotal")
_d = lambda c: f"CAST({c} AS DOUBLE) AS {c}"
_GAPS = "(PARTITION BY symbol ORDER BY ts)"

SQL: dict[str, str] = {
    "bars_h1": _with('SELECT symbol, ts AS "timestamp", open, high, low, close, tick_volume, spread, real_volume FROM bars', "bars"),
    "streaming_bars": _with('SELECT symbol, ts AS "timestamp", open, high, low, close, tick_volume FROM bars', "bars"),
    "segment_ids": _with('SELECT symbol, ts AS "timestamp", segment_id::BIGINT AS segment_id FROM segs', "segs"),
    "target_direction": _with("SELECT symbol, decision_timestamp, target_timestamp, round(future_return_1h, 8) AS future_return_1h, target_h1_direction FROM target", "target"),
    "target_report": _with(
        """SELECT symbol, count(*) AS rows, count(*) FILTER (target_h1_direction = 'UP') AS n_up, count(*) FILTER (target_h1_direction = 'DOWN') AS n_down,
 count(*) FILTER (target_h1_direction = 'ZERO') AS n_zero, count(*) FILTER (target_h1_direction = 'GAP') AS n_gap, count(*) FILTER (target_h1_direction IS NULL) AS n_unlabeled,
 count(future_return_1h) AS n_returns, round(avg(future_return_1h), 6) AS mean, round(stddev_samp(future_return_1h), 6) AS std, round(min(future_return_1h), 6) AS min, round(max(future_return_1h), 6) AS max,
 round(count(*) FILTER (target_h1_direction = 'UP') / nullif(count(*) FILTER (target_h1_direction IN ('UP', 'DOWN')), 0)::DOUBLE, 6) AS up_fraction,
 round(quantile_cont(future_return_1h, 0.25), 6) AS p25, round(quantile_cont(future_return_1h, 0.5), 6) AS p50, round(quantile_cont(future_return_1h, 0.75), 6) AS p75 FROM target GROUP BY 1""",
        "target",
    ),
    "features_15": _with(f'SELECT symbol, ts AS "timestamp", segment_id::BIGINT AS segment_id, {_rounded(" ".join(CANDIDATES), 6)} FROM feats', "feats"),
    "feature_diagnostics": _with(f"SELECT * FROM ({_diag})", "feats"),
    "feature_corr_top10": _with(f'SELECT "left", "right", round(r, 6) AS abs_correlation FROM ({_corr}) WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY r DESC, "left" DESC, "right" DESC LIMIT 10', "feats"),
    "time_policy_bars": _with(
        """SELECT symbol, ts AS "timestamp", open, high, low, close, tick_volume, spread, real_volume FROM bars
 WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-27 12:30:00'""",
        "bars",
    ),
    "time_policy_exclusions": _with(
        """SELECT symbol, 0::BIGINT AS invalid_timestamp, count(*) FILTER (ts < TIMESTAMP '2024-01-03') AS before_start, count(*) FILTER (ts >= TIMESTAMP '2024-01-28') AS at_or_after_end,
 count(*) FILTER (ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-27 12:30:00') AS incomplete_at_cutoff FROM bars GROUP BY 1""",
        "bars",
    ),
    "time_policy_coverage": _with(
        """SELECT symbol, min(ts) AS first_timestamp, max(ts) AS last_timestamp, min(ts) <= TIMESTAMP '2024-01-03' AS covers_start, max(ts) >= TIMESTAMP '2024-01-27 11:00:00' AS covers_end FROM bars GROUP BY 1""",
        "bars",
    ),
    "audit_issues": _with(
        f"""SELECT symbol, code, severity, rows FROM (
 SELECT symbol, 'duplicate_opening_time' AS code, 'error' AS severity, sum(n) FILTER (n > 1)::BIGINT AS rows FROM (SELECT symbol, ts, count(*) AS n FROM broken GROUP BY 1, 2) GROUP BY 1
 UNION ALL SELECT symbol, 'invalid_numeric_value', 'error', count(*) FILTER (close IS NULL) FROM broken GROUP BY 1
 UNION ALL SELECT symbol, 'ohlc_contradiction', 'error', count(*) FILTER (close IS NOT NULL AND (high < greatest(open, close) OR low > least(open, close))) FROM broken GROUP BY 1
 UNION ALL SELECT symbol, 'negative_nonnegative_field', 'error', count(*) FILTER (close IS NOT NULL AND tick_volume < 0) FROM broken GROUP BY 1
 UNION ALL SELECT symbol, 'unclassified_gap', 'review', count(*) FILTER (ts > b + INTERVAL 1 HOUR) FROM (SELECT symbol, ts, lag(ts) OVER {_GAPS} AS b FROM bars) GROUP BY 1) WHERE rows > 0""",
        "broken",
        "bars",
    ),
    "unclassified_gaps": _with(
        f"""SELECT symbol, b AS "left", ts AS "right", round(epoch(ts - b) / 3600.0::DOUBLE, 8) AS hours FROM (SELECT symbol, ts, lag(ts) OVER {_GAPS} AS b FROM bars) WHERE ts > b + INTERVAL 1 HOUR""",
        "bars",
    ),
    "learning_matrix": _with(
        f"SELECT symbol, decision_timestamp, target_timestamp, target_h1_direction, {_rounded(" ".join(SELECTED), 6)} FROM matrix WHERE is_binary AND is_complete", "matrix"
    ),
    "learning_accounting": _with(
        """SELECT symbol, count(*) AS market_rows, count(*) FILTER (is_binary) AS binary_rows, count(*) FILTER (is_binary AND NOT is_complete) AS incomplete_rows,
 count(*) FILTER (is_binary AND is_complete) AS sample_rows FROM matrix GROUP BY 1""",
        "matrix",
    ),
    "chronological_split": _with('SELECT symbol, part AS "partition", v AS validation_start, t AS test_start, count(*) AS rows FROM parts GROUP BY 1, 2, 3, 4', "parts"),
    "majority_label": _with("SELECT * FROM majority", "majority"),
    "persistence_predictions": _with("SELECT * FROM preds", "preds"),
    "classification_metrics": _with(f"{_metrics('b0_majority')} UNION ALL {_metrics('b1_persistence')}", "preds"),
    "deals_partitioned": _with(f'SELECT ticket, type, type_label, time_utc, in_interval, part AS "partition", {_d("subtotal")} FROM dealt', "dealt"),
    "deals_daily": _with("SELECT time_utc::DATE AS date, count(*) AS deals, " + ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in _MONEY) + " FROM dealt WHERE part = 'trade' GROUP BY 1", "dealt"),
    "deals_reconciliation": _with(
        "SELECT count(*) AS rows, count(*) FILTER (part = 'trade') AS trades, count(*) FILTER (part = 'other_operation') AS other_operations, count(*) FILTER (part = 'outside_interval') AS outside_interval, "
        "count(*) FILTER (part = 'other_operation' AND type_label LIKE 'UNKNOWN_TYPE_%') AS unknown_types, "
        + ", ".join(f"CAST(coalesce(sum({m}) FILTER (part = 'trade'), 0) AS DOUBLE) AS {m}" for m in _MONEY)
        + ", true AS balanced FROM dealt",
        "dealt",
    ),
    "deals_other_operations": _with("SELECT type, type_label, count(*) AS deals, CAST(sum(subtotal) AS DOUBLE) AS subtotal FROM dealt WHERE part = 'other_operation' GROUP BY 1, 2", "dealt"),
    "deal_violations": """WITH d AS (SELECT event_id + 1 AS ticket FROM events), a AS (SELECT ticket FROM d UNION ALL SELECT ticket FROM d WHERE ticket % 501 = 0)
 SELECT ticket, 1::BIGINT AS rule_order, 'duplicate_ticket' AS code FROM a WHERE ticket % 501 = 0 UNION ALL SELECT ticket, 3, 'seconds_disagree' FROM a WHERE ticket % 97 = 0""",
    "asof_entry": _with(f'SELECT signal_id, decision_time, et AS entry_time, es AS entry_seq, CAST(eb AS DOUBLE) AS bid, CAST(ea AS DOUBLE) AS ask FROM ({_quotes("decisions")})', "decisions", "ticks"),
    "asof_exit": _with(f'SELECT signal_id, target_time, xt AS exit_time, xs AS exit_seq, CAST(xb AS DOUBLE) AS bid, CAST(xa AS DOUBLE) AS ask FROM ({_quotes("decisions")})', "decisions", "ticks"),
    "v1_trades": _with(
        f"""SELECT signal_id, side, et AS entry_time, xt AS exit_time, CAST(CASE WHEN side = 'long' THEN ea ELSE eb END AS DOUBLE) AS entry_price, CAST(CASE WHEN side = 'long' THEN xb ELSE xa END AS DOUBLE) AS exit_price,
 {_d("midpoint_pnl")}, {_d("spread_cost")}, {_d("quote_pnl")}, 2.0::DOUBLE AS slippage_cost, 7.0::DOUBLE AS commission_cost, 0.5::DOUBLE AS fee_cost, 0.0::DOUBLE AS tax_cost, {_d("swap_cost")}, {_d("net_pnl")},
 round({_seconds("xt", "et")}, 8) AS hold_seconds, (side = 'long') = (target_label = 'UP') AS prediction_correct, {_d("balance_after")} FROM trades""",
        "trades",
    ),
    "v1_skipped": _with("SELECT signal_id, decision_time, outcome AS reason FROM outcomes WHERE outcome <> 'trade'", "outcomes"),
    "v1_balance_curve": _with(
        "SELECT a AS time, 'initial_balance' AS event, '' AS signal_id, 10000::DOUBLE AS value FROM period UNION ALL SELECT xt, 'trade_exit', signal_id, balance_after::DOUBLE FROM trades", "period", "trades"
    ),
    "v1_equity_curve": _with("SELECT time, seq, event, signal_id, value FROM equity1", "equity1"),
    "v1_trade_summary": _with(
        """SELECT 'ALL' AS symbol, n AS closed_trades, w AS wins, l AS losses, gw AS gross_wins, gl AS gross_losses, net, round(CASE WHEN gl > 0 THEN gw / gl END, 8) AS profit_factor,
 CASE WHEN gl > 0 THEN 'defined' WHEN gw > 0 THEN 'no_gross_losses' ELSE 'no_closed_trade_pnl' END AS profit_factor_status, round(w / n::DOUBLE, 8) AS win_rate, round(gw / nullif(w, 0), 8) AS average_win,
 round(-gl / nullif(l, 0), 8) AS average_loss, round(net / n, 8) AS expectancy FROM (SELECT count(*) AS n, count(*) FILTER (net_pnl > 0) AS w, count(*) FILTER (net_pnl < 0) AS l,
 coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0)::DOUBLE AS gw, coalesce(-sum(net_pnl) FILTER (net_pnl < 0), 0)::DOUBLE AS gl, sum(net_pnl)::DOUBLE AS net FROM trades)""",
        "trades",
    ),
    "v1_side_summary": _with(
        """SELECT 'ALL' AS symbol, s.side, count(t.signal_id) AS closed_trades, coalesce(sum(net_pnl), 0)::DOUBLE AS net_pnl, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses
 FROM (VALUES ('long'), ('short')) s(side) LEFT JOIN trades t ON t.side = s.side GROUP BY 1, 2""",
        "trades",
    ),
    "v1_cost_decomposition": _with(
        """SELECT 'ALL' AS symbol, sum(midpoint_pnl)::DOUBLE AS midpoint_pnl, sum(spread_cost)::DOUBLE AS spread_cost, count(*) * 2.0::DOUBLE AS slippage_cost, count(*) * 7.0::DOUBLE AS commission_cost,
 count(*) * 0.5::DOUBLE AS fee_cost, 0.0::DOUBLE AS tax_cost, sum(swap_cost)::DOUBLE AS swap_cost FROM trades""",
        "trades",
    ),
    "v1_classifier_accuracy": _with("SELECT 'ALL' AS symbol, count(*) AS signals, round(avg(CASE WHEN (side = 'long') = (target_label = 'UP') THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM signals", "signals"),
    "v1_time_in_market": _with(
        f"""SELECT 'ALL' AS symbol, round(s, 8) AS seconds_in_market, round(s / p * 100, 8) AS pct_of_period FROM (SELECT (SELECT sum(h) FROM (SELECT {_seconds("xt", "et")} AS h FROM trades UNION ALL SELECT {_seconds("zt", "et")} FROM opened)) AS s,
 (SELECT {_seconds("max(time)", "min(time)")} FROM equity1) AS p)""",
        "trades",
        "opened",
        "equity1",
    ),
    "rollover_swaps": _with(f'SELECT ts AS "timestamp", {_roll("ts", "(ts + INTERVAL 50 HOUR)", 1)}::BIGINT AS rollovers, {_roll("ts", "(ts + INTERVAL 50 HOUR)")}::BIGINT AS weight FROM allbars', "allbars"),
    "max_consecutive_losses": _with(
        """SELECT 'ALL' AS symbol, max(n) AS max_consecutive_losses FROM (SELECT run, count(*) FILTER (net_pnl < 0) AS n FROM (
 SELECT net_pnl, sum(CASE WHEN net_pnl < 0 THEN 0 ELSE 1 END) OVER (ORDER BY xt) AS run FROM trades) GROUP BY 1)""",
        "trades",
    ),
    "drawdown": _with(
        f""", {_drawdown("equity1", "time, seq")} SELECT 'ALL' AS symbol, round(fall, 6) AS maximum_drawdown, round(fall / peak * 100, 6) AS maximum_drawdown_pct, pt AS peak_time, time AS trough_time, rt AS recovery_time,
 rt IS NOT NULL AS recovered, floor({_seconds("time", "pt")})::BIGINT AS peak_to_trough_seconds, floor({_seconds("rt", "pt")})::BIGINT AS peak_to_recovery_seconds,
 CASE WHEN rt IS NULL THEN floor({_seconds("(SELECT max(time) FROM equity1)", "pt")}) ELSE 0 END::BIGINT AS unrecovered_seconds_at_end FROM trough, top, back""",
        "equity1",
    ).replace(") , falls", "), falls"),
    "v1_drawdown_trades": _with(
        f""", {_drawdown("equity1", "time, seq")} SELECT 'ALL' AS symbol, t.signal_id, et AS entry_time, xt AS exit_time FROM trades t, trough d, top p WHERE t.et <= d.time AND t.xt >= p.pt""", "equity1", "trades"
    ).replace(") , falls", "), falls"),
    "v1_headline": _with(
        f"""SELECT 'ALL' AS symbol, count(*) AS signals, count(*) FILTER (outcome = 'trade') AS closed_trades, count(*) FILTER (outcome IN {_OPEN}) AS open_trades, count(*) FILTER (outcome <> 'trade') AS skipped_signals,
 count(*) FILTER (outcome NOT IN ('trade', 'position_open_at_decision')) AS missing_quote_signals, bool_and(outcome IN ('trade', 'position_open_at_decision')) AS headline_metrics_ready,
 (SELECT v FROM final)::DOUBLE AS final_balance, round(((SELECT v FROM final) - 10000)::DOUBLE / 10000 * 100, 8) AS return_pct FROM outcomes""",
        "outcomes",
        "final",
    ),
    "curve_gaps": _with(
        """SELECT 'ALL' AS symbol, count(*) AS observation_count, quantile_cont(gap, 0.5)::DOUBLE AS median_spacing_seconds, max(gap)::BIGINT AS maximum_gap_seconds, count(*) FILTER (gap > 60) AS gaps_over_limit
 FROM (SELECT floor((epoch_us(time) - epoch_us(lag(time) OVER (ORDER BY time, seq))) / 1000000.0::DOUBLE) AS gap FROM equity1)""",
        "equity1",
    ),
    "tick_order_issues": """WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ingest, epoch_us(ts) - CASE WHEN event_id % 97 = 5 THEN 7200000000 ELSE 0 END AS us,
 CASE WHEN event_id % 13 <> 0 THEN CASE WHEN event_id % 101 = 7 THEN event_id - 1 ELSE event_id END END AS num FROM events),
 n AS (SELECT *, lag(num) OVER (ORDER BY ingest) AS prior FROM t WHERE num IS NOT NULL), u AS (SELECT *, lag(us) OVER (ORDER BY ingest) AS prior FROM t)
 SELECT ingest, 'time_steps_back' AS code, us AS value, prior FROM u WHERE us < prior UNION ALL SELECT ingest, 'number_not_increasing', num, prior FROM n WHERE num <= prior""",
    "v2_positions": _with(
        f"""SELECT signal_id, action AS side, et AS entry_time, es AS entry_source_seq, CAST(CASE WHEN action = 'long' THEN ea ELSE eb END AS DOUBLE) AS entry_price, zt AS exit_time, zs AS exit_source_seq,
 CAST(CASE WHEN action = 'long' THEN zb ELSE za END AS DOUBLE) AS exit_price, quote_pnl::DOUBLE AS quote_pnl, reason AS exit_reason, round({_seconds("coalesce(zt, lt)", "et")}, 8) AS hold_seconds,
 CASE WHEN zt IS NOT NULL THEN greatest(0, round({_seconds("zt", "target_time")}, 8)) END AS target_lateness_seconds, greatest(0, date_diff('day', et::DATE, coalesce(zt, lt)::DATE)) AS utc_midnights_crossed,
 balance_after::DOUBLE AS balance_after FROM positions""",
        "positions",
    ),
    "v2_signal_actions": _with(
        f"""SELECT signal_id, decision_time, action, side_at AS side_at_decision, disposition, CASE WHEN disposition IN ('entered', 'reversed_into', 'entry_unfilled_delay_over_60s') THEN et END AS execution_time,
 CASE WHEN disposition IN ('entered', 'reversed_into', 'entry_unfilled_delay_over_60s') THEN es END AS execution_source_seq,
 CASE WHEN opens THEN round({_seconds("et", "decision_time")}, 8) END AS entry_delay_seconds FROM machine m JOIN asked a ON a.rn = m.rn""",
        "machine",
        "asked",
    ),
    "v2_balance_curve": _with(
        "SELECT TIMESTAMP '2024-01-01' AS time, 'initial_balance' AS event, '' AS signal_id, 10000::DOUBLE AS value UNION ALL SELECT zt, 'position_close', signal_id, balance_after::DOUBLE FROM positions WHERE zt IS NOT NULL",
        "positions",
    ),
    "v2_equity_curve": _with("SELECT * FROM equity2", "equity2"),
    "v2_stream_equity": _with("SELECT time, seq, event, signal_id, value FROM equity2 WHERE event NOT IN ('initial_balance', 'period_end_flat')", "equity2"),
    "v2_metrics": _with(
        f""", {_drawdown("equity2", "time, seq, sub")} SELECT 'ALL' AS symbol, closed AS closed_positions, open > 0 AS open_at_period_end, (SELECT count(*) FROM ticks) AS quotes, (SELECT count(*) FROM equity2) AS equity_observations,
 v - 10000 AS closed_quote_pnl, v AS realized_balance, (SELECT value FROM equity2 ORDER BY time DESC, seq DESC, sub DESC LIMIT 1) AS ending_equity, coalesce((SELECT fall FROM trough), 0) AS maximum_drawdown, (SELECT time FROM trough) AS maximum_drawdown_time FROM final2""",
        "equity2",
        "final2",
        "ticks",
    ).replace(") , falls", "), falls"),
    "mse_rmse_mae": _with("SELECT symbol, round(avg((close - open) * (close - open)), 6) AS mse, round(avg(abs(close - open)), 6) AS mae, round(sqrt(avg((close - open) * (close - open))), 6) AS rmse FROM bars GROUP BY 1", "bars"),
}
