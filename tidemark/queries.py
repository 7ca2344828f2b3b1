"""Registered queries of the market operators, over tables adapted from ``events``.

Doubles are rounded to eight places; money leaves as doubles of exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.contracts import UTC, BarRequest, DecisionReplay, SignalReplay
from tidemark.functions import scalars as S
from tidemark.operators import asof, bars, curves, deals, decision_replay, features, learning, neural, signal_replay, target
from tidemark.sources import adapters, places
from tidemark.streaming import bars as bar_stream
from tidemark.streaming import replay as replay_stream

REQUEST = BarRequest("ALL", datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 1, 28, tzinfo=UTC), datetime(2024, 1, 27, 12, 30, tzinfo=UTC))
DEALS_FROM, DEALS_TO = datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC)
DELAY = 900
SIGNALS = SignalReplay(max_entry_delay=DELAY, max_exit_delay=10 * DELAY)
DECISIONS = DecisionReplay(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC), max_entry_delay=DELAY)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


#: Decimal places of doubles, where large values leave fewer than eight.
PLACES = {"features_15": 6, "learning_matrix": 6, "target_report": 6, "feature_corr_top10": 6, "mse_rmse_mae": 6, "drawdown": 6}


def query(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query over the events table; results get plain, comparable types."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.ship(spark)
        return plain(f(adapters.events(spark, sf_dir)), PLACES.get(f.__name__, 8))

    QUERIES[f.__name__] = run
    return run


def plain(df: DataFrame, places: int = 8) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "double":
            c = F.round(c, places)
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def _bars(rows: DataFrame) -> DataFrame:
    return adapters.bars(rows)


@query
def bars_h1(rows: DataFrame) -> DataFrame:
    return _bars(rows)


@query
def segment_ids(rows: DataFrame) -> DataFrame:
    return bars.segments(_bars(rows)).select("symbol", "timestamp", "segment_id")


@query
def target_direction(rows: DataFrame) -> DataFrame:
    return target.direction(_bars(rows))


@query
def target_report(rows: DataFrame) -> DataFrame:
    return target.report(target.direction(_bars(rows)))


@query
def features_15(rows: DataFrame) -> DataFrame:
    return features.build(_bars(rows))


@query
def feature_diagnostics(rows: DataFrame) -> DataFrame:
    found = features.build(_bars(rows))
    return features.diagnostics(found.select("symbol", "timestamp", *[F.round(c, 6).alias(c) for c in features.CANDIDATES]))


@query
def feature_corr_top10(rows: DataFrame) -> DataFrame:
    return features.correlations(features.build(_bars(rows)))


@query
def time_policy_bars(rows: DataFrame) -> DataFrame:
    return bars.time_policy(_bars(rows), REQUEST)


@query
def time_policy_exclusions(rows: DataFrame) -> DataFrame:
    return bars.exclusions(_bars(rows), REQUEST, ("symbol",))


@query
def time_policy_coverage(rows: DataFrame) -> DataFrame:
    return bars.coverage(_bars(rows), REQUEST, ("symbol",))


def broken(rows: DataFrame) -> DataFrame:
    """Bars with planted faults, by hour of day: duplicates, contradictions, negatives, missing numbers."""
    hour = F.hour("timestamp")
    bad = _bars(rows).select(
        "symbol", "timestamp", "open",
        F.when(hour == 3, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(hour == 5, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"),
        F.when(hour == 7, -F.col("tick_volume")).otherwise(F.col("tick_volume")).alias("tick_volume"),
        "spread", "real_volume",
    )
    again = bad.filter(F.hour("timestamp") == 11)
    return bad.union(again)


@query
def audit_issues(rows: DataFrame) -> DataFrame:
    return bars.audit(broken(rows))


@query
def unclassified_gaps(rows: DataFrame) -> DataFrame:
    return bars.gaps(_bars(rows))


@query
def learning_matrix(rows: DataFrame) -> DataFrame:
    return learning.samples(learning.matrix(_bars(rows)))


@query
def learning_accounting(rows: DataFrame) -> DataFrame:
    return learning.accounting(learning.matrix(_bars(rows)))


def parts(rows: DataFrame) -> DataFrame:
    return learning.split(learning.samples(learning.matrix(_bars(rows))))


@query
def chronological_split(rows: DataFrame) -> DataFrame:
    return parts(rows).groupBy("symbol", "partition", "validation_start", "test_start").agg(F.count("*").alias("rows"))


@query
def majority_label(rows: DataFrame) -> DataFrame:
    return learning.majority(parts(rows))


@query
def persistence_predictions(rows: DataFrame) -> DataFrame:
    return learning.predictions(parts(rows))


@query
def classification_metrics(rows: DataFrame) -> DataFrame:
    return learning.baseline_metrics(parts(rows))


@query
def logistic_baseline(rows: DataFrame) -> DataFrame:
    one = adapters.bars(rows, "ALL")
    split = learning.split(learning.samples(learning.matrix(one)))
    predicted = learning.logistic(split)(split.filter(F.col("partition").isin("train", "validation")))
    return learning.metrics(predicted, "target_h1_direction", "b2_logistic", ("partition",))


def _deals(rows: DataFrame) -> DataFrame:
    return deals.partitioned(adapters.deals(rows), DEALS_FROM, DEALS_TO)


@query
def deals_partitioned(rows: DataFrame) -> DataFrame:
    return _deals(rows).select("ticket", "type", "type_label", "time_utc", "in_interval", "partition", "subtotal")


@query
def deals_daily(rows: DataFrame) -> DataFrame:
    return deals.daily(_deals(rows))


@query
def deals_reconciliation(rows: DataFrame) -> DataFrame:
    return deals.reconciliation(_deals(rows))


@query
def deals_other_operations(rows: DataFrame) -> DataFrame:
    return deals.other_operations(_deals(rows))


@query
def deal_violations(rows: DataFrame) -> DataFrame:
    good = adapters.deals(rows)
    bad = good.withColumn("time", F.when(F.col("ticket") % 97 == 0, F.col("time") + 1).otherwise(F.col("time")))
    return deals.violations(bad.union(bad.filter("ticket % 501 = 0")))


def _quote(name: str) -> list:
    return [F.col(f"{name}.time").alias(f"{name}_time"), F.col(f"{name}.source_seq").alias(f"{name}_seq")]


@query
def asof_entry(rows: DataFrame) -> DataFrame:
    d = adapters.decisions(rows).select("symbol", "signal_id", "decision_time")
    return asof.forward(d, adapters.ticks(rows), "decision_time", "entry", strict=True).select("signal_id", "decision_time", *_quote("entry"), F.col("entry.bid").alias("bid"), F.col("entry.ask").alias("ask"))


@query
def asof_exit(rows: DataFrame) -> DataFrame:
    d = adapters.decisions(rows).select("symbol", "signal_id", (F.col("decision_time") + F.expr("interval 1 hour")).alias("target_time"))
    return asof.forward(d, adapters.ticks(rows), "target_time", "exit", strict=False).select("signal_id", "target_time", *_quote("exit"), F.col("exit.bid").alias("bid"), F.col("exit.ask").alias("ask"))


def _signals(rows: DataFrame) -> signal_replay.Replay:
    return signal_replay.replay(adapters.signals(rows), adapters.ticks(rows), SIGNALS)


@query
def v1_trades(rows: DataFrame) -> DataFrame:
    t = _signals(rows).trades
    return t.select(
        "signal_id", "side", "entry_time", "exit_time", "entry_price", "exit_price", "midpoint_pnl", "spread_cost", "quote_pnl", "slippage_cost", "commission_cost",
        "fee_cost", "tax_cost", "swap_cost", "net_pnl", "hold_seconds", "prediction_correct", "balance_after",
    )


@query
def v1_skipped(rows: DataFrame) -> DataFrame:
    return _signals(rows).skipped.select("signal_id", "decision_time", "reason")


@query
def v1_balance_curve(rows: DataFrame) -> DataFrame:
    return _signals(rows).balance.select("time", "event", "signal_id", "value")


@query
def v1_equity_curve(rows: DataFrame) -> DataFrame:
    return _signals(rows).equity.select("time", "seq", "event", "signal_id", "value")


@query
def v1_trade_summary(rows: DataFrame) -> DataFrame:
    return curves.trade_summary(_signals(rows).trades)


@query
def v1_side_summary(rows: DataFrame) -> DataFrame:
    return curves.side_summary(_signals(rows).trades)


@query
def v1_cost_decomposition(rows: DataFrame) -> DataFrame:
    return signal_replay.cost_decomposition(_signals(rows).trades)


@query
def v1_drawdown_trades(rows: DataFrame) -> DataFrame:
    return signal_replay.drawdown_trades(_signals(rows))


@query
def v1_headline(rows: DataFrame) -> DataFrame:
    return signal_replay.headline(_signals(rows), SIGNALS)


@query
def v1_classifier_accuracy(rows: DataFrame) -> DataFrame:
    return signal_replay.classifier_accuracy(adapters.signals(rows))


@query
def v1_time_in_market(rows: DataFrame) -> DataFrame:
    return signal_replay.time_in_market(_signals(rows))


@query
def rollover_swaps(rows: DataFrame) -> DataFrame:
    ends = F.col("timestamp") + F.expr("interval 50 hours")
    weight = S.rollover_weight(F.col("timestamp"), ends, SIGNALS.rollover_minutes, SIGNALS.triple_weekday)
    count = S.rollover_count(F.col("timestamp"), ends, SIGNALS.rollover_minutes)
    return adapters.bars(rows, "ALL").select("timestamp", count.alias("rollovers"), weight.alias("weight"))


@query
def max_consecutive_losses(rows: DataFrame) -> DataFrame:
    return curves.losing_streaks(_signals(rows).trades)


@query
def drawdown(rows: DataFrame) -> DataFrame:
    return curves.drawdown(_signals(rows).equity)


@query
def curve_gaps(rows: DataFrame) -> DataFrame:
    return curves.spacing(_signals(rows).equity)


def _decisions(rows: DataFrame) -> decision_replay.Replay:
    return decision_replay.replay(adapters.decisions(rows), adapters.ticks(rows), DECISIONS)


@query
def v2_positions(rows: DataFrame) -> DataFrame:
    return _decisions(rows).positions.select(
        "signal_id", "side", "entry_time", "entry_source_seq", "entry_price", "exit_time", "exit_source_seq", "exit_price", "quote_pnl", "exit_reason", "hold_seconds",
        "target_lateness_seconds", "utc_midnights_crossed", "balance_after",
    )


@query
def v2_signal_actions(rows: DataFrame) -> DataFrame:
    return _decisions(rows).actions.drop("symbol", "related")


@query
def v2_balance_curve(rows: DataFrame) -> DataFrame:
    return _decisions(rows).balance.select("time", "event", "signal_id", "value")


@query
def v2_equity_curve(rows: DataFrame) -> DataFrame:
    return _decisions(rows).equity.select("time", "seq", "sub", "event", "signal_id", "value")


@query
def v2_stream_equity(rows: DataFrame) -> DataFrame:
    out = replay_stream.run_in_slices(adapters.decisions(rows), adapters.ticks(rows), DELAY)
    return out.select(F.timestamp_micros("time_us").cast("timestamp_ntz").alias("time"), "seq", "event", "signal_id", "value")


@query
def v2_metrics(rows: DataFrame) -> DataFrame:
    return _decisions(rows).metrics


@query
def mse_rmse_mae(rows: DataFrame) -> DataFrame:
    return neural.errors(_bars(rows), "close", "open", ("symbol",))


def tick_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order checks of the events file as a file of quotes, with planted steps back, repeated and missing numbers."""
    session.ship(spark)
    rows = places.placed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    at = lambda n, k: F.col("event_id") % n == k
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.when(at(97, 5), 7_200_000_000).otherwise(0)
    number = F.when(~at(13, 0), F.when(at(101, 7), F.col("event_id") - 1).otherwise(F.col("event_id")))
    issues = places.order_issues(rows, places.Rule("time_steps_back", micros), places.Rule("number_not_increasing", number, strict=True))
    return plain(places.numbered(issues, rows).select("ingest", "code", "value", "prior"))


QUERIES["tick_order_issues"] = tick_order_issues


def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)
    return plain(bar_stream.run_once(spark, f"{sf_dir}/events.parquet"))


QUERIES["streaming_bars"] = streaming_bars
