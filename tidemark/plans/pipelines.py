"""The end-to-end runs: data gate, reports, baselines, cost report, replay."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import BarRequest, DecisionReplay, SignalReplay
from tidemark.operators import bars, curves, deals, decision_replay, features, learning, neural, signal_replay, target
from tidemark.sinks.evidence import RunFolder, file_hashes
from tidemark.sources import csv
from tidemark.sources.terminal import fetch_ticks


def gate(spark: SparkSession, raw: DataFrame, request: BarRequest, path: str, provenance: dict[str, Any] | None = None, order_col: str | None = None) -> str:
    """Raw bars to an accepted table or rejection evidence, in a create-only folder; returns the status.

    The raw answer is kept before anything is filtered. Any issue, also one for review, rejects.
    """
    folder = RunFolder(spark, path)
    folder.document("request", request.as_dict())
    kept = folder.table("raw_response", raw)
    candidates = bars.time_policy(kept, request)
    counts = bars.exclusions(kept, request).first().asDict()
    cover = bars.coverage(kept, request).first().asDict()
    issues = [r.asDict() for r in bars.audit(candidates, order_col).collect()]  # a row for each rule and symbol
    if not (cover["covers_start"] and cover["covers_end"]):
        issues.append({"symbol": request.symbol, "code": "requested_coverage_incomplete", "severity": "review", "rows": 0})
    folder.document("validation_report", {"exclusions": counts, "coverage": cover, "issues": issues})
    if issues:
        folder.document("rejection_report", issues)
        status = "rejected"
    else:
        accepted = folder.table("accepted", candidates)
        span = accepted.agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first().asDict()
        folder.document("dataset", span | {"columns": accepted.columns})
        status = "accepted"
    folder.finish(status, provenance=provenance or {})
    return status


def baseline_run(accepted: DataFrame, fractions: learning.Fractions = learning.Fractions(), with_logistic: bool = True) -> dict[str, Any]:  # noqa: B008
    """Train and validation metrics of the three baselines of one series; the test rows are only counted."""
    matrix = learning.matrix(accepted)
    parts = learning.check_split(learning.split(learning.samples(matrix), fractions)).persist()
    out: dict[str, Any] = {"accounting": [r.asDict() for r in learning.accounting(matrix).collect()]}
    out["rows"] = {r.partition: r["count"] for r in parts.groupBy("partition").count().collect()}
    out["metrics"] = [r.asDict() for r in learning.baseline_metrics(parts).collect()]
    if with_logistic:
        seen = parts.filter(F.col("partition").isin("train", "validation"))
        predicted = learning.logistic(parts)(seen)
        found = learning.metrics(predicted, "target_h1_direction", "b2_logistic", ("symbol", "partition")).withColumn("model", F.lit("b2_logistic"))
        out["metrics"] += [r.asDict() for r in found.collect()]
    parts.unpersist()
    return out


def target_report(accepted: DataFrame) -> DataFrame:
    return target.report(target.direction(accepted))


def feature_report(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    built = features.build(accepted)
    return features.diagnostics(built), features.correlations(built, features.SELECTED)


def cost_report(spark: SparkSession, ledger: DataFrame, start: datetime, end: datetime, path: str) -> str:
    rows = deals.partitioned(deals.checked(ledger), start, end)
    total = deals.reconciliation(rows).first()
    if not total.balanced:
        raise AssertionError("deals are not partitioned exactly once")
    folder = RunFolder(spark, path)
    folder.table("deals", rows)
    folder.table("daily", deals.daily(rows))
    folder.table("review", rows.filter("partition <> 'trade'"))
    folder.document("reconciliation", total.asDict())
    return folder.finish("complete")


_TIMES = ("decision_time", "target_time", "entry_time", "exit_time")


def source_audit(name: str, rows: DataFrame, time: str) -> dict[str, Any]:
    """How many rows an input has, and its first and last time."""
    return {"input": name} | rows.agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")).first().asDict()


def _inputs(spark: SparkSession, paths: dict[str, str] | None) -> dict[str, Any]:
    return {name: [r.asDict() for r in file_hashes(spark, path).orderBy("file").collect()] for name, path in (paths or {}).items()}


def replay_run(spark: SparkSession, decisions: DataFrame, ticks: DataFrame, config: DecisionReplay, path: str, inputs: dict[str, str] | None = None) -> str:
    """The decision replay's tables in a create-only folder, times named as UTC, with an audit of its sources and their hashes.

    ``inputs``: the files that decisions and ticks come from, by name.
    """
    folder = RunFolder(spark, path)
    decision_replay.check(decisions, ticks, config)
    folder.document("source_audit", [source_audit("decisions", decisions, "decision_time"), source_audit("ticks", ticks, "time")])
    result = decision_replay.replay(decisions, ticks, config)
    positions = result.positions.drop("entry", "end", "reversed").withColumnsRenamed({c: f"{c}_utc" for c in _TIMES})
    for name, df in (("positions", positions), ("signal_actions", result.actions), ("balance_curve", result.balance), ("equity_curve", result.equity)):
        folder.table(name, df)
    folder.document("metrics", [r.asDict() for r in result.metrics.collect()])
    return folder.finish("complete", period=[config.period_start, config.period_end], inputs=_inputs(spark, inputs))


def signal_run(spark: SparkSession, predictions: str, quotes: str, config: SignalReplay, path: str, symbol: str = "") -> str:
    """The per-signal replay of two files, frozen predictions and the terminal's quotes, in a create-only folder.

    The predictions' partition, model hash and thresholds are checked, and so is the order of both files.
    """
    folder = RunFolder(spark, path)
    lower, upper = str(config.lower_threshold), str(config.upper_threshold)
    signals, audit = csv.frozen_predictions(spark, predictions, config.model_sha256, lower=lower, upper=upper, symbol=symbol)
    ticks = csv.terminal_ticks(spark, quotes, symbol)
    folder.document("source_audit", [audit.first().asDict() | {"input": "predictions"}, source_audit("ticks", ticks, "time")])
    signal_replay.check(signals, ticks, config)
    result = signal_replay.replay(signals, ticks, config)
    for name, df in (("trades", result.trades.drop("entry", "exit")), ("skipped", result.skipped), ("open_positions", result.open_positions), ("balance_curve", result.balance), ("equity_curve", result.equity)):
        folder.table(name, df)
    metrics = {
        "headline": signal_replay.headline(result, config), "trades": curves.trade_summary(result.trades), "sides": curves.side_summary(result.trades),
        "costs": signal_replay.cost_decomposition(result.trades), "drawdown": curves.drawdown(result.equity), "spacing": curves.spacing(result.equity),
        "losing_streaks": curves.losing_streaks(result.trades), "classifier": signal_replay.classifier_accuracy(signals), "time_in_market": signal_replay.time_in_market(result),
    }
    folder.document("metrics", {k: [r.asDict() for r in df.collect()] for k, df in metrics.items()})  # a row or two a series
    return folder.finish("complete", inputs=_inputs(spark, {"predictions": predictions, "ticks": quotes}))


def export_ticks(spark: SparkSession, terminal: Any, symbol: str, start: datetime, end: datetime, path: str) -> str:
    """The terminal's quotes in [start, end), repeated ones included, in a create-only folder."""
    folder = RunFolder(spark, path)
    folder.table("ticks", fetch_ticks(spark, terminal, symbol, start, end))
    return folder.finish("complete", symbol=symbol, period=[start, end])


def neural_run(spark: SparkSession, path: str, seed: int = 20261015) -> str:
    folder = RunFolder(spark, path)
    folder.table("data", neural.synthetic(spark, seed))
    folder.table("metrics", neural.run(spark, seed))
    return folder.finish("complete", seed=seed)
