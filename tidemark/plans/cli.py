"""Command line: ``python -m tidemark.plans.cli COMMAND ...``; exit code 2 on a broken contract."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from tidemark import session
from tidemark.contracts import UTC, BarRequest, ContractError, DecisionReplay, SignalReplay
from tidemark.plans import pipelines
from tidemark.sources import csv


def _time(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise argparse.ArgumentTypeError("a time needs its zone")
    return at.astimezone(UTC)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)
    gate = commands.add_parser("gate", help="raw bars to an accepted table or rejection evidence")
    for name in ("symbol", "input", "run-dir"):
        gate.add_argument(f"--{name}", required=True)
    for name in ("start", "end", "cutoff"):
        gate.add_argument(f"--{name}", type=_time, required=True)
    for name in ("target-report", "feature-report", "baselines"):
        report = commands.add_parser(name)
        report.add_argument("--input", required=True, help="accepted bars, a Parquet folder or a CSV file")
        report.add_argument("--symbol", default="")
        report.add_argument("--output", required=True)
    replay = commands.add_parser("replay")
    for name in ("decisions", "ticks", "out"):
        replay.add_argument(f"--{name}", required=True)
    for name in ("start", "end"):
        replay.add_argument(f"--{name}", type=_time, required=True)
    replay.add_argument("--max-entry-delay", type=int, default=60)
    signals = commands.add_parser("signals", help="per-signal replay of frozen predictions over the terminal's quotes")
    for name in ("predictions", "ticks", "model-sha256", "out"):
        signals.add_argument(f"--{name}", required=True)
    for name in ("max-entry-delay", "max-exit-delay"):
        signals.add_argument(f"--{name}", type=int, default=60)
    net = commands.add_parser("neural")
    net.add_argument("--output-dir", required=True)
    costs = commands.add_parser("cost-report")
    for name in ("deals", "out"):
        costs.add_argument(f"--{name}", required=True)
    for name in ("start", "end"):
        costs.add_argument(f"--{name}", type=_time, required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session.session()
    session.ship(spark)
    try:
        if a.command == "gate":
            request = BarRequest(a.symbol, a.start, a.end, a.cutoff)
            print(pipelines.gate(spark, csv.raw_bars(spark, a.input, a.symbol), request, a.run_dir, {"input": a.input}, "ingest"))
        elif a.command == "replay":
            config = DecisionReplay(a.start, a.end, a.max_entry_delay)
            print(pipelines.replay_run(spark, csv.decisions(spark, a.decisions, a.start, a.end), csv.ticks(spark, a.ticks, a.start, a.end), config, a.out, {"decisions": a.decisions, "ticks": a.ticks}))
        elif a.command == "signals":
            config = SignalReplay(model_sha256=a.model_sha256, max_entry_delay=a.max_entry_delay, max_exit_delay=a.max_exit_delay)
            print(pipelines.signal_run(spark, a.predictions, a.ticks, config, a.out))
        elif a.command == "neural":
            print(pipelines.neural_run(spark, a.output_dir))
        elif a.command == "cost-report":
            print(pipelines.cost_report(spark, spark.read.parquet(a.deals), a.start, a.end, a.out))
        else:
            accepted = csv.snapshot(spark, a.input, a.symbol) if a.input.endswith(".csv") else spark.read.parquet(a.input)
            if a.command == "target-report":
                result = [r.asDict() for r in pipelines.target_report(accepted).collect()]
            elif a.command == "feature-report":
                result = [[r.asDict() for r in x.collect()] for x in pipelines.feature_report(accepted)]
            else:
                result = pipelines.baseline_run(accepted)
            with open(a.output, "x", encoding="utf-8") as out:
                json.dump(result, out, sort_keys=True, indent=2, default=str)
    except ContractError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
