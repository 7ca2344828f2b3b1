"""A stream's table: every batch once, through failures and restarts; late rows are errors."""

import tracemalloc
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from tests.test_operators import DECISION, T0, TICK
from tidemark.contracts import ContractError
from tidemark.sinks.batches import BatchTable
from tidemark.streaming import replay
from tidemark.streaming.replay import Machine


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "k long")
    assert table.read().collect() == [] and table.committed() == []
    table(spark.range(5).toDF("k"), 0)
    table(spark.range(7).toDF("k"), 0)
    table(spark.range(3).toDF("k"), 1)
    assert table.committed() == [0, 1] and table.read().count() == 8 == table.verify()
    spark.range(9).toDF("k").write.parquet(str(tmp_path / "t/data/batch=000000000002"))  # an attempt that died before its entry
    assert table.read().count() == 8
    table(spark.range(1).toDF("k"), 2)
    assert table.read().count() == 9 == table.verify()
    spark.range(2).toDF("k").write.mode("append").parquet(str(tmp_path / "t/data/batch=000000000001"))
    with pytest.raises(ContractError):
        table.verify()
    whole = BatchTable(spark, str(tmp_path / "w"), "k long", whole=True)
    for n in (4, 6):
        whole(spark.range(n).toDF("k"), n)
    assert whole.read().count() == 6


def test_a_stream_that_dies_after_writing(spark, tmp_path):
    rows = str(tmp_path / "rows")
    spark.range(100).toDF("k").write.parquet(rows)
    table, attempts = BatchTable(spark, str(tmp_path / "t"), "k long"), []

    def sink(df, batch):
        attempts.append(batch)
        if len(attempts) == 1:
            df.write.mode("overwrite").parquet(table._data(batch))
            raise OSError("dies between the data and the ledger")
        table(df, batch)
        if len(attempts) == 3:
            raise OSError("dies between the ledger and the stream's own commit")

    def run():
        stream = spark.readStream.schema("k long").parquet(rows).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        stream.awaitTermination()

    with pytest.raises(Exception, match="dies"):
        run()
    assert table.read().count() == 0
    run()
    assert table.read().count() == 100
    spark.range(100, 130).toDF("k").write.mode("append").parquet(rows)
    with pytest.raises(Exception, match="dies"):
        run()
    run()
    assert attempts == [0, 0, 1, 1] and sorted(r.k for r in table.read().collect()) == list(range(130)) and table.verify() == 130


def test_numbers_must_rise_with_time():
    for quotes in ([(0, 5), (1, 4)], [(0, 5), (1, 5)], [(0, 1), (3, 3), (4, 2)]):
        machine = Machine(60_000_000)
        with pytest.raises(ContractError, match="late or out of order"):
            for us, seq in quotes:
                list(machine.feed(us, 0, seq, Decimal(1), Decimal(1), None, None))


def test_a_late_row_within_one_batch(spark):
    tick = lambda seconds, seq: ("S", T0 + timedelta(seconds=seconds), seq, Decimal(1), Decimal(1))
    asked = spark.createDataFrame([("S", "a", T0, "long")], DECISION)
    good = [tick(s, k) for k, s in enumerate((1, 5, 5, 9))]
    out = replay.run_in_slices(asked, spark.createDataFrame(good, TICK), 60, slices=2)
    assert sorted((r.seq, r.event) for r in out.collect()) == [(0, "position_open_mark"), (1, "quote_mark"), (2, "quote_mark"), (3, "quote_mark")]
    late = [tick(1, 0), tick(9, 1), tick(5, 2)]  # number 2 arrived after number 1, with an earlier time
    with pytest.raises(Exception, match="late or out of order"):
        replay.run_in_slices(asked, spark.createDataFrame(late, TICK), 60, slices=1)


def test_slices_stay_bounded_as_a_series_grows(spark, monkeypatch):
    streams, start = [], replay.to_sink
    monkeypatch.setattr(replay, "to_sink", lambda *a, **k: streams.append(start(*a, **k)) or streams[-1])
    tick = lambda s: ("S", T0 + timedelta(seconds=s), s, Decimal("1.1") + s % 7, Decimal("1.1002") + s % 7)
    quotes = spark.createDataFrame([tick(s) for s in (*range(50), *range(3600, 3630))], TICK)
    asked = spark.createDataFrame([("S", "a", T0, "long"), ("S", "b", T0 + timedelta(seconds=20), "short")], DECISION)
    rows = lambda: sorted(tuple(r) for r in replay.run_in_slices(asked, quotes, 60, slices=1).collect())
    whole, kept = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    streams.clear()
    monkeypatch.setattr(replay, "SLICE_ROWS", 12, raising=False)
    assert rows() == whole and len(whole) == 71 and spark.conf.get("spark.sql.shuffle.partitions") == kept
    taken = [p["numInputRows"] for s in streams for p in s.recentProgress]
    assert sum(taken) == 82 and max(taken) <= 12


def test_a_micro_batch_is_held_as_numbers():
    n = 60_000
    when = np.arange(n, 0, -1) * 1_000
    none = np.full(n, None)
    frame = pd.DataFrame({"time_us": when, "kind": 0, "seq": when + 2**53, "bid": 123_456_789_012_345_678, "ask": 123_456_789_012_345_679, "signal_id": none, "action": none})
    asked = frame.iloc[:1].assign(time_us=0, kind=1, seq=0, bid=-(2**63), ask=-(2**63), signal_id="a", action="short")
    machine, seen = Machine(60_000_000), 0
    tracemalloc.start()
    for part in replay.advance(machine, "S", [frame.iloc[:777], asked, frame.iloc[777:]]):
        seen += len(part)
        last = part.iloc[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak / n < 300
    assert (last.time_us, last.seq, last.value) == (n * 1_000, n * 1_000 + 2**53, Decimal("10000.00"))
    assert machine.s["entry_price"] == "1234567890.12345678"
