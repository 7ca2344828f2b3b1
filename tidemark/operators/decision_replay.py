"""Single-position decision replay: reversals, holds, target exits, equity at every quote.

For each decision three quotes decide everything and come from as-of joins: the next one after the
decision, the one after that, and the first at or after its target. The state machine then is a chain of decisions
that open positions, found in rounds of joins, so neither quotes nor decisions of a series meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.contracts import ContractError, DecisionReplay, naive
from tidemark.functions import scalars as S
from tidemark.operators import asof, chains, curves

ABSTAIN = "ABSTAIN"


@dataclass(frozen=True)
class Replay:
    positions: DataFrame
    actions: DataFrame
    balance: DataFrame
    equity: DataFrame
    metrics: DataFrame


def check(decisions: DataFrame, ticks: DataFrame, config: DecisionReplay) -> None:
    low, high = naive(config.period_start), naive(config.period_end)
    rows = decisions.groupBy("symbol", "decision_time").agg(F.count("*").alias("n"), F.min("signal_id").alias("signal_id"))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (low, high))
    bad = rows.filter((F.col("n") > 1) | (F.col("decision_time") < start) | (F.col("decision_time") >= end)).first()
    if bad:
        raise ContractError(f"decision {bad.signal_id}: repeated or outside the period")
    if decisions.filter(~F.col("action").isin("long", "short", ABSTAIN) | F.col("action").isNull()).first():
        raise ContractError("an action is long, short or ABSTAIN")
    wrong = ticks.filter((F.col("time") < start) | (F.col("time") >= end) | F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") < F.col("bid"))).first()
    if wrong:
        raise ContractError(f"quote {wrong.source_seq} is outside the period or breaks 0 < bid <= ask")
    if decisions.first() is None or ticks.first() is None:
        raise ContractError("a replay needs decisions and quotes")


def _following(ticks: DataFrame) -> DataFrame:
    """Quotes with ``after``: the time and number of the next one in (time, source_seq) order."""
    keyed = ticks.select("*", asof.bucket(F.col("time")).alias("_bucket"))
    key = F.struct("time", "source_seq")
    inside = Window.partitionBy("symbol", "_bucket").orderBy("time", "source_seq")
    firsts = keyed.groupBy("symbol", "_bucket").agg(F.min(key).alias("_first"))
    next_ = firsts.select("symbol", "_bucket", F.lead("_first").over(Window.partitionBy("symbol").orderBy("_bucket")).alias("_next"))
    return keyed.withColumn("_in", F.lead(key).over(inside)).join(next_, ["symbol", "_bucket"]).withColumn("after", F.coalesce("_in", "_next")).drop("_bucket", "_in", "_next")


_FOREVER = 2**62


def folded(decisions: DataFrame, ticks: DataFrame, config: DecisionReplay) -> DataFrame:
    """Decisions with their quotes, disposition and, where they open a position, how it ends.

    The state between two decisions is flat or the decision whose position is open. A decision that opens one leads on to just
    one other, whatever came before: the first one against it while the position is open (a reversal), else the first one from
    its end on that can enter from flat. A decision that can enter after all earlier positions have ended, had they been opened,
    does enter: what is opened is what these pointers reach from such decisions (``chains``). An intent that meets the next
    decision before its quote is an error.
    """
    rows = decisions.select("symbol", "signal_id", "decision_time", "action", (F.col("decision_time") + F.expr("interval 1 hour")).alias("target_time"))
    rows = asof.entry_and_exit(rows, ticks)
    after = _following(ticks).select("symbol", F.col("source_seq").alias("_seq"), "after")
    rows = rows.withColumn("_seq", F.col("entry.source_seq")).join(after, ["symbol", "_seq"], "left").drop("_seq")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(micros(f"{c}.time").alias("t"), F.col(f"{c}.source_seq").alias("s")))
    rows = rows.withColumns({"_at": micros("decision_time"), "_next": place("entry"), "_target": place("exit"), "_after": place("after")}).drop("exit", "after")
    # the first quote after the entry that is at or after the target
    rows = rows.withColumn("_own", F.when(F.col("_target") <= F.col("_next"), F.col("_after")).otherwise(F.col("_target")))
    rows = session.checkpointed(rows.drop("_target", "_after"))

    at, quoted = F.col("_at"), (F.col("action") != ABSTAIN) & F.col("_next").isNotNull()
    in_time = F.col("_next.t") - at <= config.max_entry_delay * 1_000_000
    until = F.coalesce("_own.t", F.lit(_FOREVER))
    first = lambda side: F.when(quoted & (F.col("action") == side), F.struct("_at", "_next"))
    graph = chains.before(rows, "_at", {"_ends": F.when(quoted, until), "_earlier": F.when(quoted & in_time, at)})
    graph = chains.after(graph, "_at", {"_long": first("long"), "_short": first("short")})
    against = F.when(F.col("action") == "long", F.col("_short")).otherwise(F.col("_long"))
    graph = graph.withColumn("_reversal", F.when(quoted & (against["_at"] < until), against)).drop("_long", "_short")
    graph = graph.withColumns({"_root": quoted & in_time & (F.col("_earlier").isNull() | (F.col("_ends") <= at)), "_from": F.when(quoted & F.col("_reversal").isNull(), F.col("_own.t"))})
    graph = session.checkpointed(graph.drop("_ends", "_earlier"))
    nodes = chains.next_at(graph, "_at", "_from", "_fresh", among=quoted & in_time).filter(quoted)
    opened = chains.reached(nodes.select("symbol", at.alias("at"), F.col("_root").alias("root"), F.coalesce("_reversal._at", "_fresh").alias("to")))
    opened = session.checkpointed(opened).select("symbol", F.col("at").alias("_at"), F.lit(True).alias("opens"))

    marked = graph.drop("_root", "_from").join(opened, ["symbol", "_at"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    marked = chains.before(marked, "_at", {"_open": F.when(F.col("opens"), F.struct("_at", "signal_id", "action", until.alias("until")))})
    held = F.coalesce(F.col("_open.until") > at, F.lit(False))
    disposition = (
        F.when(F.col("action") == ABSTAIN, F.when(held, "abstain_hold").otherwise("abstain_while_flat"))
        .when(held & (F.col("action") == F.col("_open.action")), "same_side_noop")
        .when(F.col("_next").isNull(), F.when(held, "reversal_queued").otherwise("entry_queued"))
        .when(held, "reversed_into")
        .when(in_time, "entered")
        .otherwise("entry_unfilled_delay_over_60s")
    )
    marked = marked.withColumns({"disposition": disposition, "side_at_decision": F.when(held, F.col("_open.action")).otherwise("flat"), "related": F.when(held, F.col("_open.signal_id")).otherwise("")})
    intent = ~F.col("disposition").isin("abstain_hold", "abstain_while_flat", "same_side_noop")
    marked = chains.before(marked, "_at", {"_prior": F.struct("_at", F.when(intent, F.coalesce("_next.t", F.lit(_FOREVER))).alias("queued"))})
    conflict = F.concat("symbol", F.lit(": decision "), "signal_id", F.lit(" comes before the last intent found a quote"))
    end = F.when(F.col("opens"), F.coalesce(F.col("_reversal._next"), F.col("_own")))
    out = marked.select(
        "symbol", "signal_id", "decision_time", "action", "target_time", "entry", "side_at_decision", "related", (intent & F.col("_next").isNotNull()).alias("executed"), "opens",
        (F.col("disposition") == "reversed_into").alias("reversed"), end.t.alias("end_t"), end.s.alias("end_s"),
        F.when(end.isNotNull(), F.when(F.col("_reversal").isNotNull(), "reversal").otherwise("target")).alias("reason"),
        F.when(F.coalesce(F.col("_prior.queued") > at, F.lit(False)), F.raise_error(conflict)).otherwise(F.col("disposition")).alias("disposition"),
    )
    return session.checkpointed(out)  # a row per decision, from which every output starts


def replay(decisions: DataFrame, ticks: DataFrame, config: DecisionReplay) -> Replay:
    units = F.lit(config.base_units).cast(S.UNITS)
    opening = F.lit(config.starting_balance).cast(S.CENTS)
    rows = folded(decisions, ticks, config)
    actions = rows.select(
        "symbol", "signal_id", "decision_time", "action", "side_at_decision", "disposition", "related",
        F.when(F.col("executed"), F.col("entry.time")).alias("execution_time"),
        F.when(F.col("executed"), F.col("entry.source_seq")).alias("execution_source_seq"),
        F.when(F.col("opens"), S.seconds(F.col("entry.time"), F.col("decision_time"))).alias("entry_delay_seconds"),
    )

    opened = rows.filter("opens")
    quote = F.struct(*asof.QUOTE)
    ends = ticks.select("symbol", F.col("source_seq").alias("end_s"), quote.alias("exit"))
    last = ticks.groupBy("symbol").agg(F.max(quote).alias("last"))
    closed = opened.join(ends, ["symbol", "end_s"], "left").join(last, "symbol").withColumn("end", F.coalesce("exit", "last"))
    side, entry, exit_ = F.col("action"), F.col("entry"), F.col("exit")
    price = S.entry_price(side, entry.bid, entry.ask)
    positions = closed.select(
        "symbol", "signal_id", side.alias("side"), "decision_time", "target_time", "entry", "end", "reversed",
        F.col("entry.time").alias("entry_time"), F.col("entry.source_seq").alias("entry_source_seq"), price.alias("entry_price"),
        F.col("exit.time").alias("exit_time"), F.col("exit.source_seq").alias("exit_source_seq"), S.exit_price(side, exit_.bid, exit_.ask).alias("exit_price"),
        F.when(exit_.isNotNull(), S.cents(S.liquidation(side, price, exit_.bid, exit_.ask, units))).alias("quote_pnl"),
        F.coalesce("reason", F.lit("open_at_period_end")).alias("exit_reason"),
        S.seconds(F.col("end.time"), F.col("entry.time")).alias("hold_seconds"),
        F.when(exit_.isNotNull(), F.greatest(F.lit(0.0), S.seconds(F.col("exit.time"), F.col("target_time")))).alias("target_lateness_seconds"),
        S.midnights_crossed(F.col("entry.time"), F.col("end.time")).alias("utc_midnights_crossed"),
    )

    before = Window.partitionBy("symbol").orderBy("entry_time", "entry_source_seq").rowsBetween(Window.unboundedPreceding, -1)
    prior = (opening + F.coalesce(F.sum("quote_pnl").over(before), F.lit(0).cast(S.CENTS))).cast(S.CENTS)
    booked = positions.withColumn("balance_before", prior).withColumn("balance_after", (F.col("balance_before") + F.coalesce("quote_pnl", F.lit(0).cast(S.CENTS))).cast(S.CENTS))
    begin, finish = (F.lit(naive(x)).cast("timestamp_ntz") for x in (config.period_start, config.period_end))
    symbols = decisions.select("symbol").distinct()
    balance = symbols.select("symbol", begin.alias("time"), F.lit("initial_balance").alias("event"), F.lit("").alias("signal_id"), opening.alias("value")).union(
        booked.filter("exit_time IS NOT NULL").select("symbol", "exit_time", F.lit("position_close"), "signal_id", "balance_after")
    )

    marks = asof.marks(booked, ticks, "entry", "end", ("signal_id", "side", "exit_reason", "reversed", "balance_before", "balance_after"))
    p = F.col("p")
    is_entry = F.col("source_seq") == p.entry.source_seq
    is_exit = (F.col("source_seq") == p.end.source_seq) & (p.exit_reason != "open_at_period_end")
    marked = S.cents(p.balance_before + S.liquidation(p.side, S.entry_price(p.side, p.entry.bid, p.entry.ask), F.col("bid"), F.col("ask"), units))
    equity = marks.select(
        "symbol", "time", F.col("source_seq").alias("seq"),
        F.when(is_entry & p.reversed, 1).otherwise(0).alias("sub"),
        F.when(is_entry, "position_open_mark").when(is_exit, p.exit_reason).otherwise("quote_mark").alias("event"),
        p.signal_id.alias("signal_id"),
        F.when(is_exit & ~is_entry, p.balance_after).otherwise(marked).alias("value"),
    )
    equity = equity.union(symbols.select("symbol", begin, F.lit(-1).cast("long"), F.lit(0), F.lit("initial_balance"), F.lit(""), opening))
    final = symbols.join(
        booked.groupBy("symbol").agg(F.sum("quote_pnl").alias("_sum"), F.count_if(F.col("exit_time").isNotNull()).alias("_closed"), F.count_if(F.col("exit_time").isNull()).alias("_open")), "symbol", "left"
    ).select("symbol", (opening + F.coalesce("_sum", F.lit(0).cast(S.CENTS))).cast(S.CENTS).alias("realized"), F.coalesce("_sum", F.lit(0).cast(S.CENTS)).alias("closed_pnl"), F.coalesce("_closed", F.lit(0)).alias("closed"), F.coalesce("_open", F.lit(0)).alias("open"))
    flat = final.filter("open = 0").select("symbol", finish, F.lit(2**62), F.lit(0), F.lit("period_end_flat"), F.lit(""), "realized")
    equity = equity.union(flat)

    falls = curves.drawdown(equity).select("symbol", F.coalesce(F.col("maximum_drawdown").cast("double"), F.lit(0.0)).alias("maximum_drawdown"), "trough_time")
    curve = equity.groupBy("symbol").agg(F.count("*").alias("equity_observations"), F.max_by("value", F.struct("time", "seq", "sub")).cast("double").alias("ending_equity"))
    rows_read = ticks.groupBy("symbol").agg(F.count("*").alias("quotes"))
    metrics = final.join(curve, "symbol").join(falls, "symbol").join(rows_read, "symbol").select(
        "symbol", F.col("closed").alias("closed_positions"), (F.col("open") > 0).alias("open_at_period_end"), "quotes", "equity_observations",
        F.col("closed_pnl").cast("double").alias("closed_quote_pnl"), F.col("realized").cast("double").alias("realized_balance"), "ending_equity", "maximum_drawdown", F.col("trough_time").alias("maximum_drawdown_time"),
    )
    return Replay(booked, actions, balance, equity, metrics)
