"""CSV and terminal sources, evidence folders, end-to-end runs, streams."""

import hashlib
import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_operators import T0, make_bars, request
from tidemark.contracts import UTC, ContractError, DecisionReplay
from tidemark.plans import pipelines
from tidemark.sources import csv, terminal
from tidemark.streaming import bars as bar_stream
from tidemark.streaming import replay as replay_stream

START, END = datetime(2026, 1, 5, tzinfo=UTC), datetime(2026, 1, 6, tzinfo=UTC)
HEAD = "timestamp,open,high,low,close,tick_volume,spread,real_volume\n"
GOOD = "".join(f"2026-01-05T{h:02}:00:00Z,1.1,1.2,1.0,1.15,10,1,0\n" for h in range(8, 12))


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_snapshot(spark, tmp_path):
    good = csv.snapshot(spark, put(tmp_path, "good.csv", HEAD + GOOD), "S")
    assert good.count() == 4 and good.first().timestamp == datetime(2026, 1, 5, 8)
    for bad in (HEAD + GOOD + GOOD.splitlines()[1] + "\n", HEAD + GOOD.replace("1.2", "1.0"), HEAD + GOOD.replace("1.15", "x"), HEAD + "".join(GOOD.splitlines(True)[::2]), "timestamp,open\n"):
        with pytest.raises(ContractError):
            csv.snapshot(spark, put(tmp_path, "bad.csv", bad), "S")


def test_decisions_and_ticks(spark, tmp_path):
    text = "signal_id,decision_time_utc,action\na,2026-01-05T00:00:00Z,long\nb,2026-01-05T00:30:00Z,ABSTAIN\n"
    assert [r.action for r in csv.decisions(spark, put(tmp_path, "d.csv", text), START, END).collect()] == ["long", "ABSTAIN"]
    for bad in (text.replace("b,", "a,"), text.replace("00:30", "00:00"), text.replace("ABSTAIN", "flat"), text.replace("05T00:30:00Z", "06T00:00:00Z"), text.replace("00:30:00Z", "00:30:00+02:00"), text.splitlines()[0] + "\n"):
        with pytest.raises(ContractError):
            csv.decisions(spark, put(tmp_path, "d2.csv", bad), START, END)
    ms = int(START.timestamp() * 1000)
    ticks = f"time_msc,bid,ask\n{ms},1.1,1.2\n{ms},1.1,1.2\n{ms + 5},1.15,1.15\n"
    got = csv.ticks(spark, put(tmp_path, "t.csv", ticks), START, END).orderBy("source_seq").collect()
    assert [r.bid for r in got] == [Decimal("1.1"), Decimal("1.1"), Decimal("1.15")]
    day = ms + 86_400_000
    for bad in (f"{day},1.1,1.2\n", f"{ms - 1},1.1,1.2\n", f"{ms + 9},NaN,1.2\n", f"{ms + 9},1.3,1.2\n", f"{ms + 9},0,1.2\n", f"{ms + 2},1.1,1.2\n", f"{ms}.5,1.1,1.2\n"):
        with pytest.raises(ContractError):
            csv.ticks(spark, put(tmp_path, "t2.csv", ticks + bad), START, END).collect()


def test_frozen_predictions(spark, tmp_path):
    names = "decision_timestamp,target_available_timestamp,partition,candidate_signal,B2_raw_probability_up_not_calibrated,target_h1_direction,model_sha256\n"
    row = lambda h, p, c, part="final_confirmation", m="f" * 64: f"2026-01-05T{h:02}:00:00Z,2026-01-05T{h + 1:02}:00:00Z,{part},{c},{p},UP,{m}\n"
    text = names + row(1, "0.45", "DOWN") + row(2, "0.5", "ABSTAIN") + row(3, "0.9", "UP") + row(2, "0.9", "UP", "test")
    signals, audit = csv.frozen_predictions(spark, put(tmp_path, "p.csv", text), "f" * 64)
    assert [r.side for r in signals.orderBy("decision_time").collect()] == ["short", "long"]
    assert (audit.first().rows, audit.first().abstained) == (3, 1)
    for bad in (row(4, "0.9", "DOWN"), row(4, "1.9", "UP"), row(4, "0.9", "UP", m="e" * 64), row(1, "0.9", "UP")):
        with pytest.raises(ContractError):
            csv.frozen_predictions(spark, put(tmp_path, "p2.csv", text + bad), "f" * 64)


def test_terminal_ticks(spark, tmp_path):
    text = "time,time_msc,bid,ask,last,flags,volume,volume_real\n10,10001,1.1,1.2,0,6,0,0\n10,10002,1.1,1.2,0,6,0,0\n"
    assert csv.terminal_ticks(spark, put(tmp_path, "m.csv", text)).count() == 2
    for bad in ("11,10003,1.1,1.2,0,6,0,0\n", "10,10003,1.1,1.2,x,6,0,0\n", "10,10000,1.1,1.2,0,6,0,0\n"):
        with pytest.raises(ContractError):
            csv.terminal_ticks(spark, put(tmp_path, "m2.csv", text + bad))


class Fake:
    def __init__(self, answer, account=None, up=True):
        self.answer, self.closed, self.up = answer, False, up
        self.me = account or {"login": 7, "server": "demo", "trade_mode": "demo"}

    def initialize(self):
        return self.up

    def shutdown(self):
        self.closed = True

    def account(self):
        return self.me

    def last_error(self):
        return "no"

    def bars(self, *_):
        return self.answer

    deals = ticks = bars


def test_terminal(spark):
    bar = {"time": 1767600000, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "tick_volume": 1, "spread": 0, "real_volume": 0}
    assert terminal.fetch_bars(spark, Fake([bar]), "S", START, END).first().timestamp == datetime(2026, 1, 5, 8)
    assert terminal.fetch_bars(spark, Fake([]), "S", START, END).count() == 0
    for fake in (Fake(None), Fake([], up=False)):
        with pytest.raises(ContractError):
            terminal.fetch_bars(spark, fake, "S", START, END)
        assert fake.closed
    with pytest.raises(ContractError):
        terminal.fetch_demo_deals(spark, Fake([], {"login": 7, "server": "x", "trade_mode": "real"}), START, END)
    with pytest.raises(ContractError):
        terminal.fetch_demo_deals(spark, Fake([]), START, END, login="8")
    assert terminal.fetch_demo_deals(spark, Fake([]), START, END)[0].count() == 0
    ms = int(START.timestamp() * 1000)
    tick = lambda at: {"time_msc": at, "bid": Decimal(1), "ask": Decimal(1), "flags": 0}
    got = terminal.fetch_ticks(spark, Fake([tick(ms - 1), tick(ms), tick(ms), tick(ms + 86_400_000)]), "S", START, END)
    assert [r.source_seq for r in got.orderBy("source_seq").collect()] == [1, 2]
    with pytest.raises(ContractError):
        terminal.fetch_ticks(spark, Fake([tick(ms), tick(ms - 1)]), "S", START, END)


def test_gate(spark, tmp_path):
    at = datetime(2026, 1, 5, 8)
    good = make_bars(spark, [10.0] * 4, [at + timedelta(hours=k) for k in range(4)])
    assert pipelines.gate(spark, good, request(), str(tmp_path / "a")) == "accepted"
    manifest = json.loads((tmp_path / "a/manifest.json").read_text())
    assert manifest["status"] == "accepted" and manifest["files"]["accepted"]["rows"] == 4
    with pytest.raises(ContractError):
        pipelines.gate(spark, good, request(), str(tmp_path / "a"))
    assert pipelines.gate(spark, good.filter(F.hour("timestamp") != 9), request(), str(tmp_path / "b")) == "rejected"
    assert (tmp_path / "b/rejection_report.json").exists() and not (tmp_path / "b/accepted").exists()
    assert pipelines.gate(spark, good.union(good.limit(1)), request(), str(tmp_path / "c")) == "rejected"


def test_baseline_run(spark):
    import math

    closes = [100 + 0.01 * t + 0.8 * math.sin(t / 3) + 0.25 * math.sin(t / 11) for t in range(240)]
    out = pipelines.baseline_run(make_bars(spark, closes))
    assert out["rows"]["test"] > 0
    assert {m["partition"] for m in out["metrics"]} == {"train", "validation"}  # the test rows stay locked
    assert {m["model"] for m in out["metrics"]} == {"b0_majority", "b1_persistence", "b2_logistic"}


def test_replay_run(spark, tmp_path):
    decisions = put(tmp_path, "d.csv", "signal_id,decision_time_utc,action\na,2026-01-05T00:00:00Z,long\n")
    ms = int(START.timestamp() * 1000)
    ticks = put(tmp_path, "t.csv", "time_msc,bid,ask\n" + "".join(f"{ms + 1000 * s},1.10000,1.10020\n" for s in (0, 1, 1800, 3600, 3601)))
    config = DecisionReplay(START, END)
    pipelines.replay_run(spark, csv.decisions(spark, decisions, START, END), csv.ticks(spark, ticks, START, END), config, str(tmp_path / "out"), {"decisions": decisions, "ticks": ticks})
    audit = json.loads((tmp_path / "out/source_audit.json").read_text())
    assert [(a["input"], a["rows"]) for a in audit] == [("decisions", 1), ("ticks", 5)]
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert [x["sha256"] for x in manifest["inputs"]["ticks"]] == [sha(ticks)] and len(manifest["environment"]["code_sha256"]) == 64
    assert {"entry_time_utc", "exit_time_utc", "decision_time_utc", "target_time_utc"} <= set(spark.read.parquet(str(tmp_path / "out/positions")).columns)
    assert json.loads((tmp_path / "out/metrics.json").read_text())[0]["realized_balance"] == 9980.0
    assert spark.read.parquet(str(tmp_path / "out/positions")).count() == 1


def sha(path):
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_signal_run(spark, tmp_path):
    from tidemark.plans import cli

    names = "decision_timestamp,target_available_timestamp,partition,candidate_signal,B2_raw_probability_up_not_calibrated,target_h1_direction,model_sha256\n"
    row = lambda h, p, c: f"2026-01-05T{h:02}:00:00Z,2026-01-05T{h + 1:02}:00:00Z,final_confirmation,{c},{p},UP,{'f' * 64}\n"
    predictions = put(tmp_path, "p.csv", names + row(1, "0.9", "UP") + row(2, "0.5", "ABSTAIN") + row(3, "0.1", "DOWN") + row(5, "0.2", "DOWN"))
    second = int(START.timestamp())
    at = [second + x for h in (1, 2, 3, 4) for x in (3600 * h + 5, 3600 * h + 1800)]
    text = "time,time_msc,bid,ask,last,flags,volume,volume_real\n" + "".join(f"{s},{1000 * s + 7},1.1000,1.1002,0,6,0,0\n" for s in at)
    args = ["signals", "--predictions", predictions, "--ticks", put(tmp_path, "q.csv", text), "--model-sha256", "f" * 64]
    assert cli.main([*args, "--out", str(tmp_path / "s")]) == 0
    assert sorted(r.signal_id for r in spark.read.parquet(str(tmp_path / "s/trades")).collect()) == ["s2026010501", "s2026010503"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "s/skipped")).collect()] == ["no_entry_quote_after_decision"]
    metrics = json.loads((tmp_path / "s/metrics.json").read_text())
    assert metrics["headline"][0]["closed_trades"] == 2 and metrics["losing_streaks"][0]["max_consecutive_losses"] == 2
    assert json.loads((tmp_path / "s/manifest.json").read_text())["inputs"]["predictions"][0]["sha256"] == sha(predictions)
    assert cli.main([*args, "--out", str(tmp_path / "s")]) == 2  # create-only
    wrong = [*args[:-1], "e" * 64]
    assert cli.main([*wrong, "--out", str(tmp_path / "s2")]) == 2


def test_file_hashes(spark, tmp_path):
    from tidemark.sinks.evidence import RunFolder, file_hashes

    paths = [put(tmp_path, f"x{k}.bin", "z" * n) for k, n in enumerate((1, 10, 5000, 70_000))]
    for most in (1 << 30, 4000, 0):  # read whole, some of both, and streamed
        got = file_hashes(spark, str(tmp_path), "*.bin", most).collect()
        assert {(r.file.rpartition("/")[2], r.bytes, r.sha256) for r in got} == {(p.rpartition("/")[2], n, sha(p)) for p, n in zip(paths, (1, 10, 5000, 70_000), strict=True)}
    first, second, third = (RunFolder(spark, str(tmp_path / "run")) for _ in range(3))
    first.document("a", 1)
    second.document("a", 2)
    (tmp_path / "run.claim").write_text("")
    with pytest.raises(ContractError):
        first.finish("complete")
    (tmp_path / "run.claim").unlink()
    second.finish("complete")
    with pytest.raises(ContractError):
        third.finish("complete")
    assert json.loads((tmp_path / "run/a.json").read_text()) == 2


def test_cli(spark, tmp_path, monkeypatch):
    from tidemark.plans import cli

    path = put(tmp_path, "good.csv", HEAD + GOOD)
    assert cli.main(["gate", "--symbol", "S", "--input", path, "--run-dir", str(tmp_path / "r"), "--start", "2026-01-05T08:00Z", "--end", "2026-01-05T12:00Z", "--cutoff", "2026-01-05T12:00Z"]) == 0
    assert cli.main(["target-report", "--input", str(tmp_path / "r/accepted"), "--output", str(tmp_path / "t.json")]) == 0
    assert cli.main(["target-report", "--input", put(tmp_path, "x.csv", "timestamp\n"), "--output", str(tmp_path / "u.json")]) == 2


def test_streaming_replay(spark, tmp_path):
    schema = "symbol string, time_us long, kind int, seq long, bid decimal(18,8), ask decimal(18,8), signal_id string, action string"
    q = lambda s, k: ("S", s * 1_000_000, 0, k, Decimal("1.1"), Decimal("1.1002"), None, None)
    batches = [[q(0, 0), ("S", 0, 1, 0, None, None, "a", "long"), q(1, 1)], [q(1800, 2), q(3600, 3), q(3601, 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = replay_stream.equity(source).writeStream.format("memory").queryName("equity_rows").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    got = [(r.event, r.value) for r in spark.table("equity_rows").orderBy("time_us", "seq").collect()]
    assert got == [("position_open_mark", Decimal("9980.00")), ("quote_mark", Decimal("9980.00")), ("target", Decimal("9980.00"))]


def test_streaming_bars(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=20 * k), "x", float(k)) for k in range(12)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    out = bar_stream.run_once(spark, str(tmp_path / "ev")).orderBy("timestamp").collect()
    assert [(r.open, r.close, r.tick_volume) for r in out] == [(0, 2, 3), (3, 5, 3), (6, 8, 3), (9, 11, 3)]
    late = [(T0 + timedelta(minutes=1), "x", 50.0)]  # after the last hour: it counts in its own
    spark.createDataFrame(late, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    out = bar_stream.run_once(spark, str(tmp_path / "ev")).orderBy("timestamp").collect()
    assert [(r.high, r.tick_volume) for r in out] == [(50, 4), (5, 3), (8, 3), (11, 3)]


def test_contract_documents(tmp_path):
    from tidemark.sources import toml

    good = 'uses_target_statistics = false\nuses_validation_statistics = false\nuses_test_statistics = false\ncandidate_features = ["return_1h", "return_3h"]\nselected_features = ["return_1h"]\n[exclusion_reasons]\nreturn_3h = "x"\n'
    assert toml.feature_contract(put(tmp_path, "f.toml", good))["selected_features"] == ["return_1h"]
    for bad in (good.replace("test_statistics = false", "test_statistics = true"), good.replace('selected_features = ["return_1h"]', 'selected_features = ["x"]'), good.replace('return_3h = "x"\n', "")):
        with pytest.raises(ContractError):
            toml.feature_contract(put(tmp_path, "g.toml", bad))
    split = "[split]\ntrain_fraction = 0.6\nvalidation_fraction = 0.2\ntest_fraction = 0.2\n"
    assert toml.fractions(put(tmp_path, "s.toml", split)).train == 0.6
    with pytest.raises(ContractError):
        toml.fractions(put(tmp_path, "s2.toml", split.replace("test_fraction = 0.2", "test_fraction = 0.3")))


def test_export_and_neural_runs(spark, tmp_path):
    ms = int(START.timestamp() * 1000)
    tick = {"time_msc": ms, "bid": Decimal(1), "ask": Decimal(1), "flags": 0}
    pipelines.export_ticks(spark, Fake([tick, tick]), "S", START, END, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/ticks")).count() == 2
    pipelines.neural_run(spark, str(tmp_path / "n"))
    losses = {(r.epoch, r.split): r.mse for r in spark.read.parquet(str(tmp_path / "n/metrics")).collect()}
    assert losses[400, "train"] < losses[0, "train"] / 5 and (400, "test") in losses and (0, "test") not in losses
