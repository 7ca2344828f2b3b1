"""Per-signal replay with explicit costs: entries, exits, greedy non-overlap, curves.

What a signal would enter and leave at does not depend on other signals, so both quotes come from
as-of joins. Which of the signals are taken is a greedy choice of intervals that do not overlap, made in
rounds of joins (``chains``), so a series of any length is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.contracts import ContractError, SignalReplay, naive
from tidemark.functions import scalars as S
from tidemark.operators import asof, chains, curves

OPEN_REASONS = ("no_exit_quote_at_or_after_target", "exit_quote_exceeds_max_delay")


@dataclass(frozen=True)
class Replay:
    outcomes: DataFrame
    trades: DataFrame
    skipped: DataFrame
    open_positions: DataFrame
    balance: DataFrame
    equity: DataFrame


def check(signals: DataFrame, ticks: DataFrame, config: SignalReplay = SignalReplay()) -> None:  # noqa: B008
    """Raise unless the inputs keep their contract: two passes, one over each.

    There are signals and quotes; a series has no two signals at a time; targets come after decisions; sides agree with the
    thresholds where a probability is given; quotes hold 0 < bid <= ask; with bounds given, nothing lies outside the period.
    """
    at = F.col("decision_time")
    outside = lambda c: _outside(c, config)
    wrong = F.when(outside(at), "outside_period").when(F.coalesce(F.col("target_time") <= at, F.lit(True)), "target_not_after_decision").when(~F.coalesce(F.col("side").isin("long", "short"), F.lit(False)), "unknown_side")
    if "p_up" in signals.columns:
        low, high = F.lit(config.lower_threshold), F.lit(config.upper_threshold)
        derived = F.when(F.col("p_up") <= low, "short").when(F.col("p_up") >= high, "long").otherwise("ABSTAIN")
        wrong = wrong.when(F.coalesce(derived != F.col("side"), F.lit(True)), "side_against_thresholds")
    each = signals.select("symbol", "decision_time", wrong.alias("code")).groupBy("symbol", "decision_time").agg(F.count("*").alias("n"), F.min("code").alias("code"))
    code = F.coalesce("code", F.when((F.col("n") > 1) | at.isNull(), "repeated_or_missing_time"))
    found = each.agg(F.count("*").alias("rows"), F.min(F.when(code.isNotNull(), F.struct(at, code.alias("code")))).alias("bad")).first()
    if found.bad:
        raise ContractError(f"signal at {found.bad.decision_time}: {found.bad.code}")
    bad = F.coalesce(outside(F.col("time")) | (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")), F.lit(True))
    quotes = ticks.agg(F.count("*").alias("rows"), F.min(F.when(bad, F.col("source_seq"))).alias("bad")).first()
    if quotes.bad is not None:
        raise ContractError(f"quote {quotes.bad} is outside the period or breaks 0 < bid <= ask")
    if not found.rows or not quotes.rows:
        raise ContractError("a replay needs signals and quotes")


def _outside(c: Column, config: SignalReplay) -> Column:
    bound = lambda x: F.lit(naive(x)).cast("timestamp_ntz")
    out = F.lit(False)
    if config.period_start:
        out = out | (c < bound(config.period_start))
    if config.period_end:
        out = out | (c >= bound(config.period_end))
    return out


def priced(signals: DataFrame, ticks: DataFrame, config: SignalReplay) -> DataFrame:
    """Signals with entry and exit quotes and the result that each would have on its own."""
    rows = asof.entry_and_exit(signals, ticks)
    last = ticks.groupBy("symbol").agg(F.max(F.struct(*asof.QUOTE)).alias("last"))
    rows = rows.join(last, "symbol", "left")
    delay = S.seconds(F.col("entry.time"), F.col("decision_time"))
    late = S.seconds(F.col("exit.time"), F.col("target_time"))
    result = (
        F.when(F.col("entry").isNull(), "no_entry_quote_after_decision")
        .when(F.col("entry.time") >= F.col("target_time"), "no_entry_quote_before_target")
        .when(delay > config.max_entry_delay, "entry_quote_exceeds_max_delay")
        .when(F.col("exit").isNull(), OPEN_REASONS[0])
        .when(late > config.max_exit_delay, OPEN_REASONS[1])
        .otherwise("trade")
    )
    return rows.withColumn("result", result).withColumn("end", F.coalesce("exit", "last"))


def outcomes(priced_: DataFrame) -> DataFrame:
    """Each signal with its ``outcome``: trade, or why it is skipped or left open.

    Signals that would open a position are chosen greedily (``chains``); after the first of them that never closes, nothing
    opens. Another signal has its own result only if no position is open at its time.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = session.checkpointed(priced_.withColumn("_at", micros("decision_time")))
    opening = rows.filter(F.col("result").isin("trade", *OPEN_REASONS))
    candidates = opening.select("symbol", F.col("_at").alias("at"), F.when(F.col("result") == "trade", micros("end.time")).alias("end"))
    taken = session.checkpointed(chains.chosen(candidates)).select("symbol", F.col("at").alias("_at"), F.lit(True).alias("_taken"))
    marked = rows.join(taken, ["symbol", "_at"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    stuck = marked.filter(F.col("_taken") & (F.col("result") != "trade")).groupBy("symbol").agg(F.min("_at").alias("_stuck"))
    ends = F.when(F.col("_taken") & (F.col("result") == "trade"), micros("end.time"))
    marked = chains.before(marked, "_at", {"_until": ends}).join(stuck, "symbol", "left")
    busy = F.coalesce(F.col("_at") > F.col("_stuck"), F.lit(False)) | F.coalesce(F.col("_until") > F.col("_at"), F.lit(False))
    out = marked.withColumn("outcome", F.when(busy, "position_open_at_decision").otherwise(F.col("result")))
    return session.checkpointed(out.drop("_at", "_taken", "_until", "_stuck"))  # a row per signal, from which every output starts


def economics(rows: DataFrame, config: SignalReplay) -> DataFrame:
    """Trades with exact decimal results; midpoint result minus spread equals the quote result."""
    units = F.lit(config.base_units).cast(S.UNITS)
    side, entry, exit_ = F.col("side"), F.col("entry"), F.col("exit")
    money = lambda x: x.cast("decimal(31,10)")
    doubled = F.when(side == "long", (exit_.bid + exit_.ask) - (entry.bid + entry.ask)).otherwise((entry.bid + entry.ask) - (exit_.bid + exit_.ask))
    midpoint = money(doubled.cast(S.PRICE) * units) / 2
    spread = money(((entry.ask - entry.bid) + (exit_.ask - exit_.bid)).cast(S.PRICE) * units) / 2
    costs = {k: F.lit(v).cast(S.MONEY) for k, v in config.round_turn_costs.items()}
    weight = S.rollover_weight(F.col("entry.time"), F.col("exit.time"), config.rollover_minutes, config.triple_weekday)
    scale = config.base_units / 100000
    rate = F.when(side == "long", F.lit(config.swap_per_100k_long * scale).cast(S.MONEY)).otherwise(F.lit(config.swap_per_100k_short * scale).cast(S.MONEY))
    swap = (rate * weight.cast("decimal(6,0)")).cast(S.MONEY)
    entry_price = S.entry_price(side, entry.bid, entry.ask)
    quote = S.liquidation(side, entry_price, exit_.bid, exit_.ask, units)
    explicit = costs["slippage"] + costs["commission"] + costs["fee"] + costs["tax"]
    return rows.select(
        "symbol",
        "signal_id",
        "side",
        "decision_time",
        "target_time",
        "target_label",
        "entry",
        "exit",
        F.col("entry.time").alias("entry_time"),
        F.col("exit.time").alias("exit_time"),
        entry_price.alias("entry_price"),
        S.exit_price(side, exit_.bid, exit_.ask).alias("exit_price"),
        money(midpoint).alias("midpoint_pnl"),
        money(spread).alias("spread_cost"),
        quote.alias("quote_pnl"),
        *[c.alias(f"{k}_cost") for k, c in costs.items()],
        swap.alias("swap_cost"),
        (quote - explicit - swap).cast("decimal(31,10)").alias("net_pnl"),
        S.seconds(F.col("exit.time"), F.col("entry.time")).alias("hold_seconds"),
        (F.when(side == "long", F.col("target_label") == "UP").otherwise(F.col("target_label") == "DOWN")).alias("prediction_correct"),
    )


def _mark(config: SignalReplay) -> Column:
    """Unrealised result at a quote, all round-turn costs and swaps so far charged from the first mark."""
    p = F.col("p")
    entry_price = S.entry_price(p.side, p.entry.bid, p.entry.ask)
    raw = S.liquidation(p.side, entry_price, F.col("bid"), F.col("ask"), F.lit(config.base_units).cast(S.UNITS))
    costs = F.lit(sum(config.round_turn_costs.values())).cast(S.MONEY)
    scale = config.base_units / 100000
    rate = F.when(p.side == "long", F.lit(config.swap_per_100k_long * scale).cast(S.MONEY)).otherwise(F.lit(config.swap_per_100k_short * scale).cast(S.MONEY))
    weight = S.rollover_weight(p.entry.time, F.col("time"), config.rollover_minutes, config.triple_weekday)
    return (raw - costs - (rate * weight.cast("decimal(6,0)")).cast(S.MONEY)).cast("decimal(31,10)")


def replay(signals: DataFrame, ticks: DataFrame, config: SignalReplay = SignalReplay()) -> Replay:  # noqa: B008
    """The replay of inputs that ``check`` accepts; quotes that it refuses, of zero, say, are priced as they are."""
    found = outcomes(priced(signals, ticks, config))
    trades = economics(found.filter("outcome = 'trade'"), config)
    skipped = found.filter("outcome <> 'trade'").select("symbol", "signal_id", "decision_time", F.col("outcome").alias("reason"))
    start = F.lit(naive(config.period_start)).cast("timestamp_ntz") if config.period_start else F.min("decision_time")
    end = F.lit(naive(config.period_end)).cast("timestamp_ntz") if config.period_end else F.max("target_time") + F.expr(f"interval {config.max_exit_delay} seconds")
    period = signals.groupBy("symbol").agg(start.alias("start"), end.alias("end"))
    opening = F.lit(config.starting_balance).cast("decimal(31,10)")

    before = Window.partitionBy("symbol").orderBy("exit_time").rowsBetween(Window.unboundedPreceding, -1)
    prior = (opening + F.coalesce(F.sum("net_pnl").over(before), F.lit(0).cast("decimal(31,10)"))).cast("decimal(31,10)")
    booked = trades.withColumn("balance_before", prior).withColumn("balance_after", (F.col("balance_before") + F.col("net_pnl")).cast("decimal(31,10)"))
    balance = period.select("symbol", F.col("start").alias("time"), F.lit("initial_balance").alias("event"), F.lit("").alias("signal_id"), opening.alias("value")).union(
        booked.select("symbol", "exit_time", F.lit("trade_exit"), "signal_id", "balance_after")
    )
    totals = trades.groupBy("symbol").agg(F.sum("net_pnl").alias("_net"))
    final = period.join(totals, "symbol", "left").withColumn("final", (opening + F.coalesce("_net", F.lit(0).cast("decimal(31,10)"))).cast("decimal(31,10)")).drop("_net")

    opened = found.filter(F.col("outcome").isin(*OPEN_REASONS)).join(final.select("symbol", F.col("final").alias("balance_before")), "symbol")
    closed_marks = asof.marks(booked.withColumn("end", F.col("exit")), ticks, "entry", "end", ("signal_id", "side", "balance_before", "balance_after"))
    is_exit = (F.col("time") == F.col("p.end.time")) & (F.col("source_seq") == F.col("p.end.source_seq"))
    mark = (F.col("p.balance_before") + _mark(config)).cast("decimal(31,10)")
    curve = closed_marks.select(
        "symbol", "time", F.col("source_seq").alias("seq"), F.when(is_exit, "trade_exit").otherwise("quote_mark").alias("event"), F.col("p.signal_id").alias("signal_id"),
        F.when(is_exit, F.col("p.balance_after")).otherwise(mark).alias("value"),
    )
    open_marks = asof.marks(opened, ticks, "entry", "end", ("signal_id", "side", "balance_before"))
    curve = curve.union(open_marks.select("symbol", "time", "source_seq", F.lit("quote_mark"), "p.signal_id", mark))
    curve = curve.union(period.select("symbol", "start", F.lit(-1).cast("long"), F.lit("initial_balance"), F.lit(""), opening))
    flat = final.join(opened.select("symbol"), "symbol", "left_anti")
    curve = curve.union(flat.select("symbol", "end", F.lit(2**62), F.lit("period_end_flat"), F.lit(""), "final"))

    at_end = opened.select("*", F.struct("side", "entry").alias("p"), F.col("end.time").alias("time"), F.col("end.bid").alias("bid"), F.col("end.ask").alias("ask"))
    open_positions = at_end.select(
        "symbol", "signal_id", "side", "decision_time", "target_time", F.col("entry.time").alias("entry_time"), F.col("time").alias("last_mark_time"),
        F.col("entry.bid").alias("entry_bid"), F.col("entry.ask").alias("entry_ask"), F.col("bid").alias("last_bid"), F.col("ask").alias("last_ask"), _mark(config).alias("unrealized_pnl"),
    )
    return Replay(found, booked, skipped, open_positions, balance, curve.withColumn("sub", F.lit(0)))


def cost_decomposition(trades: DataFrame) -> DataFrame:
    names = ("midpoint_pnl", "spread_cost", "slippage_cost", "commission_cost", "fee_cost", "tax_cost", "swap_cost")
    return trades.groupBy("symbol").agg(*[F.sum(n).cast("double").alias(n) for n in names])


def classifier_accuracy(signals: DataFrame) -> DataFrame:
    """Over all signals, the skipped ones included."""
    right = F.when(F.col("side") == "long", F.col("target_label") == "UP").otherwise(F.col("target_label") == "DOWN")
    return signals.groupBy("symbol").agg(F.count("*").alias("signals"), F.avg(right.cast("double")).alias("accuracy"))


def time_in_market(result: Replay) -> DataFrame:
    held = result.trades.select("symbol", F.col("hold_seconds").alias("s")).union(
        result.open_positions.select("symbol", S.seconds(F.col("last_mark_time"), F.col("entry_time")))
    )
    span = result.equity.groupBy("symbol").agg(S.seconds(F.max("time"), F.min("time")).alias("period_seconds"))
    sums = held.groupBy("symbol").agg(F.sum("s").alias("seconds_in_market"))
    return span.join(sums, "symbol", "left").select("symbol", F.coalesce("seconds_in_market", F.lit(0.0)).alias("seconds_in_market"), F.coalesce(F.try_divide("seconds_in_market", "period_seconds") * 100, F.lit(0.0)).alias("pct_of_period"))


def drawdown_trades(result: Replay) -> DataFrame:
    """Trades that were open at any time between the peak and the trough of the deepest equity fall."""
    fall = curves.drawdown(result.equity.select("symbol", "time", "seq", "sub", "value")).select("symbol", "peak_time", "trough_time")
    return result.trades.join(fall, "symbol").filter("entry_time <= trough_time AND exit_time >= peak_time").select("symbol", "signal_id", "entry_time", "exit_time")


def headline(result: Replay, config: SignalReplay = SignalReplay()) -> DataFrame:  # noqa: B008
    """Counts of trades, skips and open positions, closing balance, and whether the figures may be quoted.

    They may if nothing is left open and every skip is due to an open position.
    """
    quoted = F.col("outcome").isin("trade", "position_open_at_decision")
    counts = result.outcomes.groupBy("symbol").agg(
        F.count("*").alias("signals"),
        F.count_if(F.col("outcome") == "trade").alias("closed_trades"),
        F.count_if(F.col("outcome").isin(*OPEN_REASONS)).alias("open_trades"),
        F.count_if(F.col("outcome") != "trade").alias("skipped_signals"),
        F.count_if(~F.col("outcome").isin("trade", "position_open_at_decision")).alias("missing_quote_signals"),
        F.bool_and(quoted).alias("headline_metrics_ready"),
    )
    net = result.trades.groupBy("symbol").agg(F.sum("net_pnl").cast("double").alias("_net"))
    start = F.lit(config.starting_balance).cast("double")
    pnl = F.coalesce("_net", F.lit(0.0))
    return counts.join(net, "symbol", "left").select("*", (start + pnl).alias("final_balance"), (pnl / start * 100).alias("return_pct")).drop("_net")
